"""Per-document line ranking and the seven per-document localization metrics.

Plan shape: one hash exchange on ``doc_id`` feeds the ranking window and the
per-document aggregate (the aggregate's clustering is already satisfied, so
no second exchange).  A document is the unit of work, so a task holds at
most one document's lines at a time per window frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRIC_COLS = ["top_x_accuracy", "top_x_precision", "top_x_recall", "rr", "ap", "ar", "ifa"]


def rank_lines_by_score(lines: DataFrame, score: str = "score", id_col: str = "doc_id",
                        out: str = "rank") -> DataFrame:
    """rank 1.. per document by score desc; ties keep line order (stable sort);
    a missing score counts as 0."""
    w = Window.partitionBy(id_col).orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(),
                                           F.col("line_idx").asc())
    return lines.withColumn(out, F.row_number().over(w))


def rank_lines_generated(lines: DataFrame, preds: DataFrame, id_col: str = "doc_id",
                         out: str = "rank") -> DataFrame:
    """Generated-line ranking.

    ``preds(doc_id, pred_pos, line)`` are the emitted lines in order; they come
    first (duplicates and hallucinations included), then every document line
    whose text was not predicted, in document order (all copies removed).
    Output: (doc_id, rank, line, is_predicted).
    """
    p = preds.select(id_col, F.col("pred_pos").alias("pos"), "line",
                     F.lit(1).alias("is_predicted"))
    rest = (lines.select(id_col, F.col("line_idx").alias("pos"), "line")
            .join(preds.select(id_col, "line"), [id_col, "line"], "left_anti")
            .withColumn("is_predicted", F.lit(0)))
    both = p.unionByName(rest)
    w = Window.partitionBy(id_col).orderBy(F.col("is_predicted").desc(), F.col("pos").asc())
    return both.withColumn(out, F.row_number().over(w)).drop("pos")


def localization_metrics(ranked: DataFrame, x: int = 10, id_col: str = "doc_id",
                         n_labels: str = "n_labels", hit: str = "hit",
                         recall_guard: bool = True, carry: list[str] | tuple = ()) -> DataFrame:
    """Seven metrics per document from ranked lines.

    ``ranked`` has (doc_id, rank, hit 0/1, n_labels).  Semantics:
    Top-X accuracy = any hit in the first X; precision = hits/X (even for
    shorter documents); recall = hits/n_labels (0 when no labels and
    ``recall_guard``); RR = 1/first hit rank within X; AP@X / AR@X = mean of
    running precision / recall over the hits found in the first X (divided by
    the hits found); IFA = lines before the first hit over the whole ranking,
    the ranking length when there is none.

    The hit ranks inside the first X are collected per document (at most X
    values), so AP needs no second window.  ``carry`` columns are constant per
    document (e.g. project, method) and are kept as extra group keys.
    """
    in_top = (F.col(hit) == 1) & (F.col("rank") <= x)
    agg = ranked.groupBy(id_col, *carry).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col(hit) == 1, F.col("rank"))).alias("_first"),
        F.array_sort(F.collect_list(F.when(in_top, F.col("rank")))).alias("_top"),
        F.max(F.col(n_labels)).cast("double").alias("_labels"),
    )
    found = F.size("_top").cast("double")
    labels = F.col("_labels")
    ap_sum = F.aggregate(F.transform("_top", lambda r, i: (i + 1) / r.cast("double")),
                         F.lit(0.0), lambda a, v: a + v)
    if recall_guard:
        recall = F.when(labels > 0, found / labels).otherwise(F.lit(0.0))
        ar = F.when((found > 0) & (labels > 0), (found + 1.0) / (2.0 * labels)).otherwise(0.0)
    else:
        recall = found / labels
        ar = F.when(found > 0, (found + 1.0) / (2.0 * labels)).otherwise(0.0)
    return agg.select(
        F.col(id_col), *carry,
        (found > 0).cast("int").alias("top_x_accuracy"),
        (found / float(x)).alias("top_x_precision"),
        recall.alias("top_x_recall"),
        F.when(F.col("_first") <= x, 1.0 / F.col("_first")).otherwise(F.lit(0.0)).alias("rr"),
        F.when(found > 0, ap_sum / found).otherwise(F.lit(0.0)).alias("ap"),
        ar.alias("ar"),
        F.coalesce(F.col("_first") - 1, F.col("_n")).cast("long").alias("ifa"),
    )


def metric_summary(metrics: DataFrame, id_col: str = "doc_id",
                   cols: list[str] | None = None, individual: bool = True) -> DataFrame:
    """Per-document rows (Type=Individual) plus an Average and a Median row.

    Median is the exact interpolated median (``percentile``); its buffer holds
    one entry per distinct metric value, which is small for these bounded
    metrics (0/1, k/X, 1/k, integer IFA).
    """
    cols = cols or METRIC_COLS
    # one aggregation pass gives both summary rows; doc_id is null on them,
    # hence a double column
    stats = metrics.agg(*[F.avg(c).alias(f"a_{c}") for c in cols],
                        *[F.percentile(F.col(c), 0.5).alias(f"m_{c}") for c in cols])
    rows = F.array(
        F.struct(F.lit("Average").alias("type"), *[F.col(f"a_{c}").alias(c) for c in cols]),
        F.struct(F.lit("Median").alias("type"), *[F.col(f"m_{c}").cast("double").alias(c) for c in cols]))
    out = stats.select(F.inline(rows)).select(
        "type", F.lit(None).cast("double").alias(id_col), *cols)
    if individual:
        ind = metrics.select(F.lit("Individual").alias("type"), F.col(id_col).cast("double"),
                             *[F.col(c).cast("double").alias(c) for c in cols])
        out = ind.unionByName(out)
    return out.select("type", id_col, *[F.col(c).cast("double").alias(c) for c in cols])
