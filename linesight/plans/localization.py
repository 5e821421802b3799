"""Step 0: lines -> ranking -> labels -> per-document metrics -> summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.operators import document_metrics as D
from linesight.operators import lines as L
from linesight.operators import ranking as R
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register

METRIC_SELECT = ("doc_id, top_x_accuracy, top_x_precision, top_x_recall, rr, ap, ar, ifa")


@register("split_lines", sql=S.LINES + """
SELECT doc_id, line_idx, line FROM lines""")
def q_split_lines(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.split_lines(docs)


@register("label_lines_by_index", sql=S.LINES + """
SELECT doc_id, line_idx, CAST(regexp_matches(line, '[0-9@]') AS BIGINT) AS hit FROM lines""")
def q_label_by_index(spark, sf_dir):
    f = B.function_table(spark, sf_dir)
    ln = L.split_labelled_lines(f)
    return ln.select("doc_id", "line_idx", "hit")


@register("rank_lines_by_score", sql=S.SCORED + """
SELECT doc_id, line_idx, score, CAST(rnk AS BIGINT) AS rank FROM ranked""")
def q_rank_by_score(spark, sf_dir):
    ranked = R.rank_lines_by_score(B.scored_lines(spark, sf_dir))
    return ranked.select("doc_id", "line_idx", "score", "rank")


def doc_metrics(spark, sf_dir, x=B.TOP_X):
    """Row-local metrics: every document is ranked inside its own row (no
    exchange at all); line score = line length."""
    f = B.function_table(spark, sf_dir).select("doc_id", "text", "flaw_idx")
    return D.document_metrics(f, lambda line: F.length(line), x=x)


@register("localization_metrics", sql=S.METRICS + f"""
SELECT {METRIC_SELECT} FROM metrics""")
def q_localization_metrics(spark, sf_dir):
    """Flagship: the seven per-document metrics (index variant, X=10)."""
    return doc_metrics(spark, sf_dir)


@register("line_relation_metrics", sql=S.METRICS + f"""
SELECT {METRIC_SELECT} FROM metrics""")
def q_line_relation_metrics(spark, sf_dir):
    """The same metrics from the exploded line relation (the plan for line
    scores that arrive as a separate table): one exchange on doc_id shared by
    the ranking window and the per-document aggregate."""
    ranked = R.rank_lines_by_score(B.scored_lines(spark, sf_dir))
    return R.localization_metrics(ranked, x=B.TOP_X)


_SUMMARY_SQL = S.METRICS + """
SELECT 'Individual' AS type, CAST(doc_id AS DOUBLE) AS doc_id,
       CAST(top_x_accuracy AS DOUBLE) AS top_x_accuracy, top_x_precision, top_x_recall, rr, ap, ar,
       CAST(ifa AS DOUBLE) AS ifa
FROM metrics
UNION ALL
SELECT 'Average', NULL, round(avg(top_x_accuracy), 6), round(avg(top_x_precision), 6),
       round(avg(top_x_recall), 6), round(avg(rr), 6), round(avg(ap), 6), round(avg(ar), 6),
       round(avg(ifa), 6) FROM metrics
UNION ALL
SELECT 'Median', NULL, round(quantile_cont(top_x_accuracy, 0.5), 6),
       round(quantile_cont(top_x_precision, 0.5), 6), round(quantile_cont(top_x_recall, 0.5), 6),
       round(quantile_cont(rr, 0.5), 6), round(quantile_cont(ap, 0.5), 6),
       round(quantile_cont(ar, 0.5), 6), round(quantile_cont(ifa, 0.5), 6) FROM metrics"""


@register("metric_summary", sql=_SUMMARY_SQL)
def q_metric_summary(spark, sf_dir):
    """Individual rows plus Average / Median: the per-document metrics (one
    small row per document) are computed once and read twice."""
    from linesight.session import materialize
    return R.metric_summary(materialize(doc_metrics(spark, sf_dir)))


@register("top_x_accuracy", sql=S.METRICS + """
SELECT doc_id, top_x_accuracy FROM metrics""")
def q_top_x_accuracy(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "top_x_accuracy")


@register("top_x_precision", sql=S.METRICS + """
SELECT doc_id, top_x_precision FROM metrics""")
def q_top_x_precision(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "top_x_precision")


@register("top_x_recall", sql=S.METRICS + """
SELECT doc_id, top_x_recall FROM metrics""")
def q_top_x_recall(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "top_x_recall")


@register("reciprocal_rank", sql=S.METRICS + """
SELECT doc_id, rr FROM metrics""")
def q_rr(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "rr")


@register("average_precision_at_k", sql=S.METRICS + """
SELECT doc_id, ap FROM metrics""")
def q_ap(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "ap")


@register("average_recall_at_k", sql=S.METRICS + """
SELECT doc_id, ar FROM metrics""")
def q_ar(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "ar")


@register("initial_false_alarm", sql=S.METRICS + """
SELECT doc_id, ifa FROM metrics""")
def q_ifa(spark, sf_dir):
    return doc_metrics(spark, sf_dir).select("doc_id", "ifa")


def flagship_summary(spark, sf_dir):
    """Average and Median rows of the seven metrics."""
    return R.metric_summary(doc_metrics(spark, sf_dir), individual=False)

