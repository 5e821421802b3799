"""Step 1: global orders, effort@recall, recall@LOC, totals, negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.operators import global_order as G
from linesight.operators import lines as L
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register
from linesight.session import materialize


def _totals(spark, sf_dir):
    t = B.test_set.plain(spark, sf_dir)
    row = t.agg(F.coalesce(F.sum("n_loc"), F.lit(0)).alias("loc"),
                F.coalesce(F.sum(F.when(F.col("target") == 1, F.size("flaw_idx"))), F.lit(0))
                .alias("flaws")).first()
    return float(row["flaws"]), float(row["loc"])


@register("total_loc", sql=S.TEST + """
SELECT CAST(total_loc AS BIGINT) AS total_loc FROM totals""")
def q_total_loc(spark, sf_dir):
    return G.total_loc(B.test_set(spark, sf_dir))


@register("total_flaw_lines", sql=S.TEST + """,
raw AS (
  SELECT doc_id, string_agg(CAST(line_idx AS VARCHAR), ',' ORDER BY line_idx) AS idx
  FROM tscored WHERE target = 1 AND hit = 1 GROUP BY doc_id
)
SELECT CAST(total_flaws AS BIGINT) AS total_flaws,
       CAST((SELECT coalesce(sum(length(idx)), 0) FROM raw) AS BIGINT) AS total_flaws_chars
FROM totals""")
def q_total_flaws(spark, sf_dir):
    return G.total_flaw_lines(B.test_set(spark, sf_dir), raw="flaw_line_index")


@register("order_lines_global", sql=S.TEST + """
SELECT doc_id, line_idx, CAST(pos AS BIGINT) AS pos, CAST(cum_hits AS BIGINT) AS cum_hits
FROM lorder""")
def q_order_lines(spark, sf_dir):
    o = G.line_order_positions(B.ranked_test_lines(spark, sf_dir))
    return o.select("doc_id", "line_idx", "pos", "cum_hits")


@register("order_functions_global", sql=S.TEST + """
SELECT doc_id, line_idx, CAST(pos AS BIGINT) AS pos, CAST(cum_hits AS BIGINT) AS cum_hits
FROM forder""")
def q_order_functions(spark, sf_dir):
    o = G.function_order_positions(B.ranked_test_lines(spark, sf_dir))
    return o.select("doc_id", "line_idx", "pos", "cum_hits")


_EFFORT_SQL = S.TEST + """,
stacked AS (
  SELECT 'lines' AS ordering, pos, cum_hits, hit FROM lorder
  UNION ALL SELECT 'functions', pos, cum_hits, hit FROM forder
)
SELECT ordering,
  round(CASE WHEN max(t.total_flaws) = 0 THEN 1.0 ELSE
    coalesce(min(CASE WHEN cum_hits >= greatest(1.0, CAST(0.2 AS DOUBLE)
                                      * CAST(t.total_flaws AS DOUBLE)) THEN pos END),
             count(*)) / CAST(max(t.total_loc) AS DOUBLE) END, 6) AS effort
FROM stacked, totals t GROUP BY ordering"""


ORDERS = {"lines": G.LINES_ORDER, "functions": G.FUNCTIONS_ORDER}


def _keyed_lines(spark, sf_dir):
    """Sort keys and hits of the test lines, computed once, and their totals."""
    score, proba = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("score", "proba"))
    lines = materialize(B.ranked_test_lines(spark, sf_dir).select("doc_id", "rank", score, proba, "hit"))
    r = lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("h")).first()
    return lines, (r["n"], r["h"])


@register("effort_at_recall", sql=_EFFORT_SQL)
def q_effort(spark, sf_dir):
    """Effort@20%Recall in lines order and functions order (index variant)."""
    flaws, loc = _totals(spark, sf_dir)
    lines, totals = _keyed_lines(spark, sf_dir)
    rows = [(name, G.effort_of_order(lines, order, flaws, loc, 20.0, totals=totals)) for name, order in ORDERS.items()]
    return spark.createDataFrame(rows, "ordering string, effort double")


_RECALL_SQL = S.TEST + """,
stacked AS (
  SELECT 'lines' AS ordering, pos, cum_hits, hit FROM lorder
  UNION ALL SELECT 'functions', pos, cum_hits, hit FROM forder
)
SELECT ordering,
  round(sum(CASE WHEN pos <= ceil(greatest(1.0, CAST(0.01 AS DOUBLE) * CAST(t.total_loc AS DOUBLE)))
                 THEN hit ELSE 0 END) / CAST(nullif(max(t.total_flaws), 0) AS DOUBLE), 6) AS recall
FROM stacked, totals t GROUP BY ordering"""


@register("recall_at_loc", sql=_RECALL_SQL)
def q_recall(spark, sf_dir):
    """Recall@1%LOC in lines order and functions order (index variant)."""
    flaws, loc = _totals(spark, sf_dir)
    lines, totals = _keyed_lines(spark, sf_dir)
    rows = [(name, G.recall_of_order(lines, order, flaws, loc, 1.0, totals=totals)) for name, order in ORDERS.items()]
    return spark.createDataFrame(rows, "ordering string, recall double")


@register("append_negatives", sql=S.TEST + """,
neg AS (
  SELECT doc_id, line_idx, 0 AS hit,
         (SELECT count(*) FROM lorder) + row_number() OVER (ORDER BY doc_id, line_idx) AS pos,
         (SELECT coalesce(sum(hit), 0) FROM lorder) AS cum_hits
  FROM tlines WHERE pred = 0
)
SELECT doc_id, line_idx, CAST(hit AS BIGINT) AS hit, CAST(pos AS BIGINT) AS pos,
       CAST(cum_hits AS BIGINT) AS cum_hits FROM lorder
UNION ALL
SELECT doc_id, line_idx, CAST(hit AS BIGINT), CAST(pos AS BIGINT), CAST(cum_hits AS BIGINT) FROM neg""")
def q_append_negatives(spark, sf_dir):
    ordered = G.line_order_positions(B.ranked_test_lines(spark, sf_dir))
    negs = L.split_lines(B.test_set(spark, sf_dir).where(F.col("pred") == 0))
    return G.append_negatives(ordered, negs)
