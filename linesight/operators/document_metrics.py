"""Per-document localization metrics without a shuffle.

When line scores are a function of the line text (or arrive as a
per-document array), a document's whole ranking fits in its own row, so the
seven metrics are a narrow projection: split -> mark labelled lines ->
sort -> metrics, all with array functions.  No exchange, no window, and it
runs unchanged on a streaming DataFrame.

Labelled lines are marked by a sort-merge inside the row: index markers and
line entries are sorted together by line index (a marker sorts before its
line), and a line is a hit when its predecessor is a marker of the same
index.  Every lambda reads only its own arguments (an outer array inside a
lambda would be re-evaluated per element).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesight.functions import text as T

_ENTRY = "struct<idx:int,kind:int,k:double>"


def ranked_lines_inrow(text: Column, flaw_idx: Column, score: Callable[[Column], Column]) -> Column:
    """array<struct<k, idx, hit>> sorted by score desc, then line order."""
    lines = T.split_lines(text)
    entries = F.transform(lines, lambda l, i: F.struct(
        i.alias("idx"), F.lit(1).alias("kind"),
        (-F.coalesce(score(l).cast("double"), F.lit(0.0))).alias("k")))
    marks = F.transform(F.coalesce(flaw_idx, F.array().cast("array<int>")), lambda f: F.struct(
        f.cast("int").alias("idx"), F.lit(0).alias("kind"), F.lit(0.0).alias("k")))
    merged = F.array_sort(F.concat(marks.cast(f"array<{_ENTRY}>"), entries.cast(f"array<{_ENTRY}>")))
    prev = F.concat(F.array(F.lit(None).cast(_ENTRY)),
                    F.slice(merged, 1, F.greatest(F.size(merged) - 1, F.lit(0))))
    flagged = F.zip_with(merged, prev, lambda x, y: F.struct(
        x["k"].alias("k"), x["idx"].alias("idx"), x["kind"].alias("kind"),
        F.coalesce((x["kind"] == 1) & (y["kind"] == 0) & (y["idx"] == x["idx"]), F.lit(False))
        .alias("hit")))
    only_lines = F.filter(flagged, lambda e: e["kind"] == 1)
    return F.array_sort(F.transform(only_lines, lambda e: F.struct(
        e["k"].alias("k"), e["idx"].alias("idx"), e["hit"].alias("hit"))))


def hit_ranks(ranked: Column) -> Column:
    """1-based ranks of the hits, ascending."""
    return F.filter(F.transform(ranked, lambda e, i: F.when(e["hit"], i + 1).otherwise(-1)),
                    lambda r: r > 0)


def metrics_from_hit_ranks(hr: Column, n: Column, n_labels: Column, x: int = 10,
                           recall_guard: bool = True) -> list[Column]:
    """The seven metrics from the ascending hit ranks and the ranking length."""
    top = F.filter(hr, lambda r: r <= x)
    found = F.size(top).cast("double")
    first = F.try_element_at(hr, F.lit(1))
    labels = n_labels.cast("double")
    ap_sum = F.aggregate(F.transform(top, lambda r, i: (i + 1) / r.cast("double")),
                         F.lit(0.0), lambda a, v: a + v)
    if recall_guard:
        recall = F.when(labels > 0, found / labels).otherwise(F.lit(0.0))
        ar = F.when((found > 0) & (labels > 0), (found + 1.0) / (2.0 * labels)).otherwise(0.0)
    else:
        recall = found / labels
        ar = F.when(found > 0, (found + 1.0) / (2.0 * labels)).otherwise(0.0)
    return [
        (found > 0).cast("int").alias("top_x_accuracy"),
        (found / float(x)).alias("top_x_precision"),
        recall.alias("top_x_recall"),
        F.when(first <= x, 1.0 / first).otherwise(F.lit(0.0)).alias("rr"),
        F.when(found > 0, ap_sum / found).otherwise(F.lit(0.0)).alias("ap"),
        ar.alias("ar"),
        F.coalesce(first - 1, n).cast("long").alias("ifa"),
    ]


def document_metrics(docs: DataFrame, score: Callable[[Column], Column], text: str = "text",
                     flaw_idx: str = "flaw_idx", id_col: str = "doc_id", x: int = 10,
                     carry: list[str] | tuple = ()) -> DataFrame:
    """(doc_id, text, flaw_idx) -> the seven metrics per document, row-local.
    Same semantics as ``ranking.localization_metrics`` (index variant).  The
    ranked array is staged in its own projection and referenced several
    times, so it is computed once per row.  ``carry`` columns are kept."""
    ranked = ranked_lines_inrow(F.col(text), F.col(flaw_idx), score)
    staged = docs.select(id_col, *carry, ranked.alias("_ranked"), F.size(flaw_idx).alias("_labels"))
    staged = staged.select(id_col, *carry, hit_ranks(F.col("_ranked")).alias("_hr"),
                           F.size("_ranked").alias("_n"), "_labels")
    return staged.select(id_col, *carry, *metrics_from_hit_ranks(F.col("_hr"), F.col("_n"),
                                                         F.col("_labels"), x))


def generated_metrics(docs: DataFrame, preds: DataFrame, text: str = "text",
                      flaw_text: str = "flaw_text", id_col: str = "doc_id",
                      x: int = 10) -> DataFrame:
    """Text-variant metrics of the generated ranking, row-local after one join.

    ``preds(doc_id, pred_pos, line)`` are gathered into one ordered array per
    document (bounded by the generator's output length) and joined to the
    document row; the ranking is the predicted lines followed by the document
    lines whose text was not predicted, a hit is a line whose text is in
    ``flaw_text`` (duplicates count; ``[""]`` makes blank lines hits), and
    recall divides by the label count without a guard.  Same semantics as
    ``rank_lines_generated`` + ``label_lines_by_text`` +
    ``localization_metrics(recall_guard=False)``."""
    d = _with_preds(docs.select(id_col, text, flaw_text), preds, id_col)
    ranking = F.concat(F.col("_p"), _unpredicted(text))
    staged = d.select(id_col, ranking.alias("_r"), flaw_text)
    staged = staged.select(id_col, F.size("_r").alias("_n"), F.size(flaw_text).alias("_labels"),
                           F.filter(F.transform("_r", lambda l, i: F.when(
                               F.array_contains(F.col(flaw_text), l), i + 1).otherwise(-1)),
                               lambda r: r > 0).alias("_hr"))
    return staged.select(id_col, *metrics_from_hit_ranks(F.col("_hr"), F.col("_n"), F.col("_labels"),
                                                         x, recall_guard=False))


def _with_preds(docs: DataFrame, preds: DataFrame, id_col: str) -> DataFrame:
    """Documents with their predicted lines in order as ``_p``."""
    arr = preds.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pred_pos", "line"))), lambda s: s["line"]).alias("_p"))
    return docs.join(arr, id_col, "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<string>")))


def _unpredicted(text: str) -> "F.Column":
    return F.filter(T.split_lines(text), lambda l: ~F.array_contains(F.col("_p"), l))


def generated_flags(docs: DataFrame, preds: DataFrame, text: str = "text", flaw_text: str = "flaw_text",
                    id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, rank, is_predicted, hit): ``rank_lines_generated`` and
    ``label_lines_by_text`` inside the document row, without the lines' text;
    nothing is shuffled but the join with the predictions."""
    keep = keep or []
    d = _with_preds(docs.select(id_col, text, flaw_text, *keep), preds, id_col)
    hits = F.transform(F.concat(F.col("_p"), _unpredicted(text)), lambda l: F.array_contains(F.col(flaw_text), l).cast("int"))
    staged = d.select(id_col, *keep, F.size("_p").alias("_n"), F.posexplode(hits).alias("_i", "hit"))
    return staged.select(id_col, *keep, (F.col("_i") + 1).alias("rank"), (F.col("_i") < F.col("_n")).cast("int").alias("is_predicted"), "hit")
