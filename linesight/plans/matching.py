"""Step 5: ground-truth matching, positional verification, row index and
the row filters of the function table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from linesight.operators import filters as Fl
from linesight.operators import matching as M
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register
from linesight.session import materialize


@register("match_exact", sql=S.MATCH + """
SELECT row_id, gt_idx FROM ex""")
def q_match_exact(spark, sf_dir):
    return M.match_exact(B.split_records(spark, sf_dir), B.ground_truth(spark, sf_dir))


def _match_inputs(spark, sf_dir):
    """Both sides are read several times by the matching: computed once."""
    return materialize(B.split_records(spark, sf_dir)), materialize(B.ground_truth(spark, sf_dir))


@register("match_prefix", sql=S.MATCH + """
SELECT row_id, gt_idx FROM px""")
def q_match_prefix(spark, sf_dir):
    left, gt = _match_inputs(spark, sf_dir)
    rest = left.join(M.match_exact(left, gt).select("row_id"), "row_id", "left_anti")
    return M.match_prefix(rest, gt)


@register("match_ground_truth", sql=S.MATCH + """
SELECT l.row_id, CAST(l.t AS BIGINT) AS target, coalesce(g.project, 'unknown') AS project,
       coalesce(gl.code, '') AS flaw_line, coalesce(gl.nos, '') AS flaw_line_index, '' AS metadata
FROM lft l LEFT JOIN resolved r USING (row_id) LEFT JOIN gt g ON g.gt_idx = r.gt_idx
LEFT JOIN gtlines gl ON gl.doc_id = r.gt_idx""")
def q_match_gt(spark, sf_dir):
    out = M.match_ground_truth(*_match_inputs(spark, sf_dir))
    return out.select("row_id", "target", "project", "flaw_line", "flaw_line_index", "metadata")


@register("zip_verified", sql="""
WITH a AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos
           FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
b AS (SELECT l.quality AS label, row_number() OVER (ORDER BY l.doc_id) - 1 AS pos
      FROM labels l JOIN documents d USING (doc_id))
SELECT CAST(a.pos AS BIGINT) AS pos, a.doc_id, CAST(b.label AS BIGINT) AS label
FROM a JOIN b USING (pos)""")
def q_zip(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    a = M.with_row_index(docs.join(lab.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], "pos", key="doc_id")
    b = M.with_row_index(lab.join(docs, "doc_id"), ["doc_id"], "pos", key="doc_id") \
        .select("pos", "text", F.col("quality").alias("label"))
    return M.zip_verified(a, b).select("pos", "doc_id", "label")


@register("row_index", sql="""
SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS BIGINT) AS row_index
FROM documents""")
def q_row_index(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return M.with_row_index(d, [F.col("n_chars").desc(), F.col("doc_id").asc()]) \
        .select("doc_id", "row_index")


def _fn_table(spark, sf_dir):
    """Function table as a split file stores it: index, project, target,
    processed_func, flaw_line, flaw_line_index (null when empty)."""
    t = B.test_set(spark, sf_dir)
    return t.select(F.col("doc_id").alias("index"), "project", "target", "pred",
                    F.col("text").alias("processed_func"),
                    F.nullif(F.array_join("flaw_lines", "/~/"), F.lit("")).alias("flaw_line"),
                    F.nullif(F.col("flaw_line_index"), F.lit("")).alias("flaw_line_index"))


_FN = S.TEST + """,
fl AS (
  SELECT t.doc_id, t.target, t.pred,
         nullif(coalesce(string_agg(CAST(s.line_idx AS VARCHAR), ',' ORDER BY s.line_idx)
                         FILTER (WHERE s.hit = 1), ''), '') AS flaw_line_index
  FROM testset t JOIN tscored s USING (doc_id) GROUP BY t.doc_id, t.target, t.pred
)"""


@register("project_rename", sql=_FN + """
SELECT doc_id AS "index", CAST(target AS BIGINT) AS "Labels", flaw_line_index AS "Line_Index" FROM fl""")
def q_project_rename(spark, sf_dir):
    m = {"index": "index", "target": "Labels", "flaw_line_index": "Line_Index"}
    return Fl.to_model_columns(_fn_table(spark, sf_dir), m)


@register("drop_missing_text", sql="SELECT doc_id FROM documents WHERE text IS NOT NULL")
def q_drop_missing(spark, sf_dir):
    return Fl.drop_missing(B.table(spark, sf_dir, "documents"), ["text"]).select("doc_id")


@register("positives_with_lines", sql=_FN + """
SELECT doc_id AS "index" FROM fl WHERE target = 1 AND flaw_line_index IS NOT NULL""")
def q_pos_lines(spark, sf_dir):
    return Fl.positives_with_lines(_fn_table(spark, sf_dir)).select("index")


@register("drop_unlabelled_positives", sql=_FN + """
SELECT doc_id AS "index" FROM fl WHERE NOT (target = 1 AND flaw_line_index IS NULL)""")
def q_drop_unlabelled(spark, sf_dir):
    return Fl.drop_unlabelled_positives(_fn_table(spark, sf_dir)).select("index")


@register("category_filter", sql="SELECT doc_id FROM documents WHERE source = 'src3'")
def q_category_filter(spark, sf_dir):
    return Fl.filter_category(B.table(spark, sf_dir, "documents"), "source", "src3").select("doc_id")


@register("category_top1_filter", sql="""
SELECT doc_id FROM documents WHERE lang = (
  SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)""")
def q_top1(spark, sf_dir):
    return Fl.filter_modal(B.table(spark, sf_dir, "documents"), "lang").select("doc_id")


@register("category_holdout", sql="""
SELECT doc_id, CASE WHEN coalesce(source IN ('src1', 'src2'), false) THEN 'test' ELSE 'train' END AS split
FROM documents""")
def q_holdout(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    train, test = Fl.holdout_split(d, "source", ["src1", "src2"])
    return (train.select("doc_id", F.lit("train").alias("split"))
            .unionByName(test.select("doc_id", F.lit("test").alias("split"))))


@register("select_cells", sql=_FN + """
SELECT 'positives' AS mode, doc_id AS "index" FROM fl WHERE pred = 1
UNION ALL SELECT 'tp_only', doc_id FROM fl WHERE pred = 1 AND target = 1
UNION ALL SELECT 'negatives', doc_id FROM fl WHERE pred = 0
UNION ALL SELECT 'actual_positives', doc_id FROM fl WHERE target = 1""")
def q_select_cells(spark, sf_dir):
    """All four modes, stacked."""
    t = _fn_table(spark, sf_dir).select("index", "pred", "target")
    parts = [Fl.select_cells(t, mode).select(F.lit(mode).alias("mode"), "index")
             for mode in ("positives", "tp_only", "negatives", "actual_positives")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("smoke_head", sql="""
SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 5""")
def q_smoke_head(spark, sf_dir):
    return Fl.head(B.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 5)


@register("before_after_flatten", sql=S.TEST + """,
fixed AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_idx) FILTER (WHERE hit = 0), '') AS after
  FROM tscored GROUP BY doc_id
)
SELECT length(CASE WHEN k.v = 1 THEN t.text ELSE f.after END) AS func_len, CAST(k.v AS BIGINT) AS vul
FROM testset t JOIN fixed f USING (doc_id),
     (SELECT 1 AS v UNION ALL SELECT 0) k
WHERE k.v = 0 OR t.target <> 0""")
def q_flatten(spark, sf_dir):
    """Before/after pairs: the document (before) and the document without its
    flawed lines (after), vul = labels.toxic."""
    t = B.test_set(spark, sf_dir)
    parts = F.split("text", "\n", -1)
    fixed = F.filter(parts, lambda l: ~l.rlike(B.FLAW_PATTERN))
    after = F.when(F.col("target") == 1, F.array_join(fixed, "\n")).otherwise(F.col("text"))
    pairs = t.select(F.col("target").alias("vul"), F.col("text").alias("func_before"),
                     after.alias("func_after"))
    flat = Fl.flatten_pairs(pairs)
    return flat.select(F.length("func").alias("func_len"), "vul")
