"""Global line orders and the cost-effectiveness metrics built on them.

A global running position never goes through a partition-less window (that
would pull every line into one task).  Two plans are used instead:

* ``with_global_position`` - range partitioning on the full order key (the
  same sample-based range shuffle ``orderBy`` uses), a reliable checkpoint so
  the partition assignment is fixed, one aggregate of (lines, hits) per range
  partition (at most ``spark.sql.shuffle.partitions`` rows: a proven bound for
  the driver), then a narrow per-partition running count in Arrow batches.
* ``function_order_positions`` - when the order is "documents by probability,
  then lines by in-document rank", only the document table is globally
  ordered; line positions are document offset + rank (two-level offsets).

The effort / recall metrics are closed forms over those positions:
effort = first position whose running hit count reaches max(1, x% of flaws)
(all ranked lines if never reached) / total LOC, 1.0 when there are no flaws;
recall = hits within the first ceil(max(1, x% of LOC)) positions / flaws.
Breakpoints are evaluated as the double ``(x / 100) * n``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linesight.session import ensure_checkpoint_dir


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


ROWS_PER_PARTITION = 1_000_000


def range_partitions(df: DataFrame) -> int:
    """Range partitions for a global order: the session's shuffle partitions,
    or more where a partition would hold over ``ROWS_PER_PARTITION`` counted
    rows (an explicit partition count is not resized by AQE, and every range
    partition is one sequential task of the offset pass)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, -(-df.count() // ROWS_PER_PARTITION))


def with_global_position(df: DataFrame, order: list, hit: str = "hit",
                         partitions: int | None = None, sums: list[str] | None = None,
                         drop: list[str] | None = None) -> DataFrame:
    """Add ``pos`` (1-based position in the total order) and ``cum_hits``
    (running sum of ``hit`` including the row); every column in ``sums`` gets a
    running sum ``cum_<name>`` too.  ``order`` must end in a unique key so the
    order is total.  Columns in ``drop`` (long sort keys) end at the sort: they
    are neither checkpointed nor sent through the counting pass."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or range_partitions(df)
    keys = _cols(order)
    acc_cols = [hit] + [c for c in (sums or []) if c != hit]
    outs = ["cum_hits"] + [f"cum_{c}" for c in acc_cols[1:]]
    ordered = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*(drop or []))
               .withColumn("_pid", F.spark_partition_id())
               .checkpoint(eager=True))
    stats = (ordered.groupBy("_pid")
             .agg(F.count(F.lit(1)).alias("_n"),
                  *[F.sum(F.col(c)).alias(f"_s{i}") for i, c in enumerate(acc_cols)])
             .orderBy("_pid").collect())          # <= n rows (one per range partition)
    offsets, acc = {}, [0] * (len(acc_cols) + 1)
    for r in stats:
        offsets[r["_pid"]] = list(acc)
        acc[0] += r["_n"]
        for i in range(len(acc_cols)):
            acc[i + 1] += int(r[f"_s{i}"] or 0)

    out_schema = Ty.StructType(ordered.schema.fields + [
        Ty.StructField(o, Ty.LongType()) for o in ["pos"] + outs])

    def running(batches):
        run = None
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{o: pd.Series(dtype="int64") for o in ["pos"] + outs})
                continue
            if run is None:
                run = list(offsets.get(int(pdf["_pid"].iloc[0]), [0] * (len(acc_cols) + 1)))
            new = {"pos": run[0] + np.arange(1, len(pdf) + 1, dtype="int64")}
            run[0] += len(pdf)
            for i, (c, o) in enumerate(zip(acc_cols, outs)):
                v = pdf[c].fillna(0).astype("int64").to_numpy()
                new[o] = run[i + 1] + np.cumsum(v)
                run[i + 1] += int(v.sum())
            yield pdf.assign(**new)

    return ordered.mapInPandas(running, out_schema).drop("_pid")


ORDER_COLUMNS = ["line_idx", "rank", "hit"]   # what the orders carry (never the line text)


def _slim(ranked: DataFrame, id_col: str, extra: list[str], keep: list[str] | None) -> DataFrame:
    cols = [id_col] + [c for c in ORDER_COLUMNS + extra + list(keep or []) if c in ranked.columns]
    return ranked.select(*dict.fromkeys(cols))


def function_order_positions(ranked: DataFrame, proba: str = "proba", id_col: str = "doc_id",
                             hit: str = "hit", keep: list[str] | None = None) -> DataFrame:
    """Documents by probability desc (stable on doc_id), lines by rank inside.

    Only the document table is ordered globally; a line's position is the
    number of lines in earlier documents plus its rank, and its running hit
    count the hits of earlier documents plus its in-document running count.
    The in-document running count shares the ranking's doc_id partitioning,
    and the join back to the (one row per document) offsets is on doc_id.
    """
    ranked = _slim(ranked, id_col, [proba, hit], keep)
    w = Window.partitionBy(id_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lines = ranked.withColumn("_doc_cum", F.sum(F.col(hit)).over(w))
    docs = ranked.groupBy(id_col).agg(F.max(proba).alias(proba),
                                      F.count(F.lit(1)).alias("_size"),
                                      F.sum(hit).alias("_hits"))
    dpos = with_global_position(docs, [F.col(proba).desc(), F.col(id_col).asc()],
                                hit="_hits", sums=["_size"])
    offs = dpos.select(id_col, (F.col("cum__size") - F.col("_size")).alias("_off_lines"),
                       (F.col("cum_hits") - F.col("_hits")).alias("_off_hits"))
    return (lines.join(offs, id_col)
            .withColumn("pos", F.col("_off_lines") + F.col("rank"))
            .withColumn("cum_hits", F.col("_off_hits") + F.col("_doc_cum"))
            .drop("_off_lines", "_off_hits", "_doc_cum"))


def line_order_positions(ranked: DataFrame, score: str = "score", id_col: str = "doc_id",
                         hit: str = "hit", keep: list[str] | None = None) -> DataFrame:
    """All lines by score desc, stable over (document order, in-document rank).
    Only the order keys and flags are sorted and checkpointed (``keep`` adds
    columns), never the line text."""
    return with_global_position(
        _slim(ranked, id_col, [score, hit], keep), [F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(id_col).asc(),
                 F.col("rank").asc()], hit=hit)


def generated_order_positions(ranked: DataFrame, proba: str | None = "proba",
                              id_col: str = "doc_id", hit: str = "hit",
                              keep: list[str] | None = None) -> DataFrame:
    """Predicted lines first, then the rest; inside each group documents by
    probability desc (or document order when ``proba`` is None), then rank."""
    keys = [F.col("is_predicted").desc()]
    if proba:
        keys.append(F.col(proba).desc())
    keys += [F.col(id_col).asc(), F.col("rank").asc()]
    slim = _slim(ranked, id_col, ["is_predicted", hit] + ([proba] if proba else []), keep)
    return with_global_position(slim, keys, hit=hit)


def append_negatives(ordered: DataFrame, negatives: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines of predicted-negative documents inspected after all positives:
    never hits, positions continue after the last positive line (document
    order, then line order).  The two planning scalars (last position, total
    hits) come from one aggregate."""
    last = ordered.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("p"),
                       F.coalesce(F.max("cum_hits"), F.lit(0)).alias("h")).first()
    neg = negatives.select(id_col, "line_idx").withColumn("hit", F.lit(0))
    npos = with_global_position(neg, [F.col(id_col).asc(), F.col("line_idx").asc()])
    npos = npos.select(id_col, "line_idx", "hit", (F.col("pos") + F.lit(int(last["p"]))).alias("pos"),
                       F.lit(int(last["h"])).cast("long").alias("cum_hits"))
    return ordered.select(id_col, "line_idx", "hit", "pos", "cum_hits").unionByName(npos)


def effort_at_recall(ordered: DataFrame, total_flaws: float, total_loc: float,
                     x: float = 20.0, by: list[str] | None = None) -> DataFrame:
    """Effort: fraction of total LOC inspected until x% of the flaws are found.
    One row (per ``by`` group when several orders are stacked)."""
    flaws, loc = F.lit(float(total_flaws)), F.lit(float(total_loc))
    bp = F.greatest(F.lit(1.0), F.lit(x / 100.0) * flaws)
    grouped = ordered.groupBy(*by) if by else ordered.groupBy()
    agg = grouped.agg(
        F.min(F.when(F.col("cum_hits") >= bp, F.col("pos"))).alias("_p"),
        F.count(F.lit(1)).alias("_n"))
    return agg.select(*(by or []), F.when(flaws == 0, F.lit(1.0))
                      .otherwise(F.coalesce(F.col("_p"), F.col("_n")) / loc).alias("effort"))


def recall_at_loc(ordered: DataFrame, total_flaws: float, total_loc: float,
                  x: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Hits within the first ceil(max(1, x% of LOC)) positions / flaws (null
    when there are no flaws: the studied code divides by zero)."""
    flaws, loc = F.lit(float(total_flaws)), F.lit(float(total_loc))
    limit = F.ceil(F.greatest(F.lit(1.0), F.lit(x / 100.0) * loc))
    grouped = ordered.groupBy(*by) if by else ordered.groupBy()
    agg = grouped.agg(F.sum(F.when(F.col("pos") <= limit, F.col("hit")).otherwise(0)).alias("_f"))
    return agg.select(*(by or []),
                      F.try_divide(F.col("_f").cast("double"), flaws).alias("recall"))


LINES_ORDER = [("score", True), ("doc_id", False), ("rank", False)]       # of ``line_order_positions``
FUNCTIONS_ORDER = [("proba", True), ("doc_id", False), ("rank", False)]   # of ``function_order_positions``
GENERATED_ORDER = [("is_predicted", True), ("proba", True), ("doc_id", False), ("rank", False)]   # of ``generated_order_positions``


def effort_of_order(lines: DataFrame, order: list[tuple[str, bool]], total_flaws: float, total_loc: float,
                    x: float = 20.0, hit: str = "hit", **selection) -> float:
    """``effort_at_recall`` of an order given by its keys, by weighted selection:
    no positions are made."""
    from linesight.operators.selection import find
    if total_flaws == 0:
        return 1.0
    target = math.ceil(max(1.0, x / 100.0 * total_flaws))
    return find(lines, order, hit, target, True, **selection).rows / total_loc


def recall_of_order(lines: DataFrame, order: list[tuple[str, bool]], total_flaws: float, total_loc: float,
                    x: float = 1.0, hit: str = "hit", **selection) -> float | None:
    """``recall_at_loc`` of an order given by its keys, by weighted selection."""
    from linesight.operators.selection import find
    if total_flaws == 0:
        return None
    target = math.ceil(max(1.0, x / 100.0 * total_loc))
    return find(lines, order, hit, target, False, **selection).hits / total_flaws


def total_loc(docs: DataFrame, n_loc: str = "n_loc") -> DataFrame:
    return docs.agg(F.coalesce(F.sum(n_loc), F.lit(0)).cast("long").alias("total_loc"))


def total_flaw_lines(docs: DataFrame, flaw_idx: str = "flaw_idx", target: str = "target",
                     raw: str | None = None) -> DataFrame:
    """Σ labels over actual positives; ``raw`` adds the character-count variant
    (length of the raw index string) some published code paths used."""
    pos = docs.where(F.col(target) == 1)
    aggs = [F.coalesce(F.sum(F.size(flaw_idx)), F.lit(0)).cast("long").alias("total_flaws")]
    if raw:
        aggs.append(F.coalesce(F.sum(F.length(raw)), F.lit(0)).cast("long").alias("total_flaws_chars"))
    return pos.agg(*aggs)
