"""Step 8: sources and sinks as round trips through a scratch folder under
the session's shared checkpoint directory (never a machine-local path on a
cluster: the checkpoint dir is the cluster's shared folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linesight.operators import overlap as O
from linesight.operators.sampling import positional_split
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.evaluation import records
from linesight.plans.registry import ORACLES, register
from linesight.session import ensure_checkpoint_dir
from linesight.sources import readers as Rd
from linesight.sources import sinks as Sk


def scratch(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/linesight-io/{name}-{uuid.uuid4().hex}"


def _function_table(spark, sf_dir):
    t = B.test_set(spark, sf_dir)
    return t.select(F.col("doc_id").alias("index"), "project", "target",
                    F.col("text").alias("processed_func"),
                    F.array_join("flaw_lines", "/~/").alias("flaw_line"), "flaw_line_index")


@register("scan_splits", sql=S.TEST + """,
sp AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ri, count(*) OVER () AS n FROM testset
),
lab AS (
  SELECT doc_id, CASE WHEN ri >= n - CAST(floor(0.1 * n) AS BIGINT) THEN 'test'
                      WHEN ri >= n - 2 * CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'train' END AS split
  FROM sp
)
SELECT split, CAST(row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END,
                                        doc_id) - 1 AS BIGINT) AS "index",
       doc_id AS orig_index FROM lab""")
def q_scan_splits(spark, sf_dir):
    """Write the function table as train/val/test CSV files (multi-line code,
    quotes) and read them back concatenated with a fresh index."""
    ft = positional_split(_function_table(spark, sf_dir), "index")
    root = scratch(spark, "splits")
    paths = {}
    for name in ("train", "val", "test"):
        paths[name] = f"{root}/{name}.csv"
        Sk.write_table(ft.where(F.col("split") == name).drop("split"), paths[name])
    back = Rd.read_splits(spark, paths)
    return back.select("split", "index", "orig_index")


@register("scan_dataset", sql="SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def q_scan_dataset(spark, sf_dir):
    """CSV round trip of the documents (multi-line, quoted) keeps every text."""
    path = scratch(spark, "dataset")
    Sk.write_table(B.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    schema = Ty.StructType([Ty.StructField("doc_id", Ty.LongType()),
                            Ty.StructField("text", Ty.StringType())])
    back = Rd.read_dataset(spark, path, "csv", schema)
    return back.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


@register("scan_pruned", sql="SELECT doc_id, source FROM documents")
def q_scan_pruned(spark, sf_dir):
    return Rd.read_columns(spark, f"{sf_dir}/documents.parquet", ["doc_id", "source"])


@register("scan_json_array", sql="SELECT doc_id, source, lang FROM documents")
def q_scan_json_array(spark, sf_dir):
    path = scratch(spark, "json-array")
    Sk.write_json_arrays(B.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), path)
    schema = Ty.StructType([Ty.StructField("doc_id", Ty.LongType()),
                            Ty.StructField("source", Ty.StringType()),
                            Ty.StructField("lang", Ty.StringType())])
    return Rd.read_json_records(spark, path, schema).select("doc_id", "source", "lang")


@register("scan_json_keyed", sql="""
SELECT CAST(doc_id AS VARCHAR) AS key, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents""")
def q_scan_json_keyed(spark, sf_dir):
    path = scratch(spark, "json-keyed")
    Sk.write_json_keyed(B.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"),
                        path, "doc_id")
    vs = Ty.StructType([Ty.StructField("source", Ty.StringType()),
                        Ty.StructField("n_chars", Ty.LongType())])
    return Rd.read_json_keyed(spark, path, vs)


@register("scan_runs", sql=S.RUNS + """
SELECT method, run AS seed, round(accuracy, 6) AS accuracy, round(mrr, 6) AS mrr FROM runs""")
def q_scan_runs(spark, sf_dir):
    """Per-run result files (one directory per method and run) plus a stored
    average that the reader skips; the run key comes from the path."""
    from linesight.plans.runs import run_table
    runs = run_table(spark, sf_dir).select("method", "run", "accuracy", "mrr")
    root = scratch(spark, "runs")
    Sk.write_partitioned(runs, root, ["method", "run"], fmt="csv", header="true")
    avg = runs.groupBy("method").agg(F.avg("accuracy").alias("accuracy"), F.avg("mrr").alias("mrr"))
    avg.write.mode("overwrite").option("header", "true").csv(f"{root}/avg.csv")
    back = Rd.read_runs(spark, root, "accuracy double, mrr double", key_pattern=r"run=([^/]+)/",
                        key="seed")
    back = back.withColumn("method", F.regexp_extract(F.col("_metadata.file_path"), r"method=([^/]+)/", 1))
    return back.select("method", "seed", F.col("accuracy").cast("double"), F.col("mrr").cast("double"))


@register("sink_by_category", sql="SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def q_sink_by_category(spark, sf_dir):
    """One directory per project, every one read back (a filter on the project
    prunes the others, see the plan test)."""
    path = scratch(spark, "by-project")
    Sk.write_partitioned(B.table(spark, sf_dir, "documents").select("doc_id", "source", "text"),
                         path, ["source"])
    return spark.read.parquet(path).select("doc_id", "source", F.length("text").alias("n_chars"))


@register("sink_table", sql=S.METRICS + """
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS "index", CAST(ifa AS DOUBLE) AS "IFA"
FROM metrics""")
def q_sink_table(spark, sf_dir):
    """The per-function IFA series written as a CSV table with a row index."""
    from linesight.plans.localization import doc_metrics
    m = doc_metrics(spark, sf_dir).select("doc_id", F.col("ifa").cast("double").alias("IFA"))
    path = scratch(spark, "ifa")
    Sk.write_table(m, path, index="index", order=["doc_id"])
    back = spark.read.options(**Rd.CSV_OPTIONS).schema("index long, doc_id long, IFA double").csv(path)
    return back.select("index", "IFA")


@register("sink_json_summary", sql=ORACLES["length_group_metrics"])
def q_sink_json_summary(spark, sf_dir):
    """Grouped length metrics as one nested JSON document (slice -> group ->
    metrics), written, read back and taken apart again."""
    lm = O.length_group_metrics(records(spark, sf_dir))
    names = [c for c in lm.columns if c not in ("slice", "group")]
    path = scratch(spark, "summary")
    Sk.write_summary_json(lm, path, "slice", "group", names)
    record = Ty.StructType([lm.schema[c] for c in names])
    nested = Ty.MapType(Ty.StringType(), Ty.MapType(Ty.StringType(), record))
    outer = spark.read.text(path).select(F.explode(F.from_json("value", nested)).alias("slice", "m"))
    inner = outer.select("slice", F.explode("m").alias("group", "r"))
    return inner.select("slice", "group", "r.*")


@register("sink_report", sql=S.GEN + """,
pt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pred_pos) AS t FROM preds GROUP BY doc_id),
lt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_idx) FILTER (WHERE hit = 1 AND target = 1) AS t
       FROM plines GROUP BY doc_id),
block AS (
  SELECT 'Source Code:' || chr(10) || d.text || chr(10) || repeat('-', 50) || chr(10) || 'Actual Vulnerable Lines:'
         || chr(10) || coalesce(lt.t, '') || chr(10) || repeat('=', 50) || chr(10) || chr(10)
         || 'Predicted Vulnerable Lines:' || chr(10) || coalesce(pt.t, '') || chr(10) || repeat('-', 50) AS b
  FROM lt JOIN documents d USING (doc_id) LEFT JOIN pt USING (doc_id))
SELECT value, CAST(count(*) AS BIGINT) AS lines FROM (SELECT unnest(string_split(b, chr(10))) AS value FROM block)
GROUP BY value""")
def q_sink_report(spark, sf_dir):
    """One text block per predicted-positive document (source, actual,
    predicted lines), written and read back as text lines: every distinct line
    with its number."""
    from linesight.operators import generated as Gn
    pos = B.generated_positives(spark, sf_dir).select("doc_id", "text", "label_text")
    pt = Gn.pred_text(B.positive_preds(spark, sf_dir), out="pred_text")
    df = pos.join(pt, "doc_id", "left")
    path = scratch(spark, "report")
    Sk.write_report(df, path, "text", "label_text", "pred_text")
    return spark.read.option("lineSep", "\n").text(path).groupBy("value").agg(F.count(F.lit(1)).alias("lines"))
