"""Readers for the study's file layouts.

CSV function tables hold multi-line code, so they need ``multiLine`` and
``escape='"'``; a multiLine CSV file cannot be split, so convert once to
Parquet for pushdown and parallel scans (``to_parquet``).  Empty strings are
null after a CSV round trip; Parquet keeps ``""``, so scans apply
``nullif(col, '')`` on the label columns to give both the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}

# Fixed schema of a function table split file.
FUNCTION_SCHEMA = Ty.StructType([
    Ty.StructField("index", Ty.LongType()), Ty.StructField("project", Ty.StringType()),
    Ty.StructField("target", Ty.IntegerType()), Ty.StructField("processed_func", Ty.StringType()),
    Ty.StructField("flaw_line", Ty.StringType()), Ty.StructField("flaw_line_index", Ty.StringType()),
])
SPLIT_ORDER = ["train", "val", "test"]


def _blank_to_null(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return df


def read_dataset(spark: SparkSession, path: str, fmt: str = "csv",
                 schema: Ty.StructType | None = None) -> DataFrame:
    if fmt == "csv":
        r = spark.read.options(**CSV_OPTIONS)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", "false")
        df = r.csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return _blank_to_null(df, ["flaw_line", "flaw_line_index"])


def read_columns(spark: SparkSession, path: str, cols: list[str], fmt: str = "parquet") -> DataFrame:
    """Only the named columns reach the scan (ReadSchema shows the pruning)."""
    return spark.read.format(fmt).load(path).select(*cols)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: Ty.StructType = FUNCTION_SCHEMA,
                fmt: str = "csv") -> DataFrame:
    """train / val / test concatenated in that order with a literal ``split``
    and a fresh dense index over (split order, original index)."""
    from linesight.operators.matching import with_row_index
    parts = []
    for rank, name in enumerate(n for n in SPLIT_ORDER if n in paths):
        df = read_dataset(spark, paths[name], fmt, schema)
        parts.append(df.withColumn("split", F.lit(name)).withColumn("_split_rank", F.lit(rank)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumnRenamed("index", "orig_index")
    out = with_row_index(out, ["_split_rank", "orig_index"], "index")
    return out.drop("_split_rank")


def read_json_records(spark: SparkSession, path: str, schema: Ty.StructType | None = None) -> DataFrame:
    """JSON files each holding an array of records."""
    r = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true")
    return (r.schema(schema) if schema is not None else r).json(path)


def read_json_keyed(spark: SparkSession, path: str, value_schema: Ty.DataType,
                    key: str = "key") -> DataFrame:
    """JSON files each holding one object keyed by record id -> one row per
    record (key column + the record's fields).  A file is one JSON value, so
    it is read whole (one task per file)."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    m = F.from_json("value", Ty.MapType(Ty.StringType(), value_schema))
    return raw.select(F.explode(m).alias(key, "_v")).select(key, "_v.*")


def read_runs(spark: SparkSession, path: str, schema: Ty.StructType | str,
              key_pattern: str = r"([^/]+)\.csv$", skip: str = "avg.csv",
              key: str = "seed") -> DataFrame:
    """Every per-run CSV below ``path`` (recursive), the run key taken from the
    file path, files named ``skip`` (the stored average) left out.  The
    schema is explicit: the stored average has other columns, and schema
    inference would read whichever file comes first."""
    df = (spark.read.option("header", "true").schema(schema)
          .option("recursiveFileLookup", "true").csv(path)
          .withColumn("_path", F.col("_metadata.file_path")))
    df = df.where(~F.col("_path").rlike(r"(^|/)" + skip.replace(".", r"\.") + r"(/|$)"))
    return df.withColumn(key, F.regexp_extract("_path", key_pattern, 1)).drop("_path")


def to_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
