"""Places in a global order found by weighted selection.

Effort and recall need one place of an order each: that of the n-th hit, or the
hits before a place.  No order is built for that.  Rows are counted in buckets
of the first sort key (between and at some quantiles, so that ties get a bucket
of their own), the one bucket that holds the place is counted again more finely,
and so on through the keys, until few enough rows are left to be sorted in one
task.  Nothing is shuffled but counts and those last rows, no line has a position,
and none passes through Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = 1_000_000         # rows that are sorted in one task
QUANTILES = 16          # places at which a range of keys is cut


@dataclass
class Place:
    """Rows and hits up to and including the row looked for; ``found`` is false
    where the order ends before it (rows and hits are those of the whole)."""
    rows: int
    hits: int
    found: bool


def _counts(df: DataFrame, hit: str, *by) -> DataFrame:
    grouped = df.groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.col(hit).cast("long")), F.lit(0)).alias("_h"))


def _bucket(key: Column, cuts: list) -> Column:
    """2 i between the cuts i - 1 and i, 2 i + 1 at cut i; one place up a cut is
    passed twice, in ascending order of the key."""
    out = F.lit(0)
    for c in cuts:
        out = out + (key >= F.lit(c)).cast("int") + (key > F.lit(c)).cast("int")
    return out


def find(df: DataFrame, order: list[tuple[str, bool]], hit: str, target: int, by_hits: bool,
         few: int = FEW, totals: tuple[int, int] | None = None) -> Place:
    """The first row, in ``order`` (numeric columns without nulls; True:
    descending), at which the running number of hits (or rows) reaches
    ``target`` (at least 1).  The keys together tell the rows apart."""
    if totals is None:
        r = _counts(df, hit).first()
        totals = r["_n"], r["_h"]
    rows, hits = totals
    if (hits if by_hits else rows) < target:
        return Place(rows, hits, False)
    before_rows = before_hits = 0
    keys, part, size = list(order), df, rows
    while size > few and keys:
        name, descending = keys[0]
        cuts = part.agg(F.percentile_approx(F.col(name), [i / QUANTILES for i in range(QUANTILES + 1)], 10000)).first()[0]
        cuts = sorted(set(cuts))
        told = _counts(part, hit, _bucket(F.col(name), cuts).alias("_b")).collect()          # at most 2 * QUANTILES + 3 rows
        for r in sorted(told, key=lambda r: r["_b"], reverse=descending):
            weight = (before_hits if by_hits else before_rows) + (r["_h"] if by_hits else r["_n"])
            if weight >= target:
                break
            before_rows, before_hits = before_rows + r["_n"], before_hits + r["_h"]
        at, size = r["_b"], r["_n"]
        if at % 2:                           # ties of this key: the next key decides
            part = part.where(F.col(name) == F.lit(cuts[at // 2]))
            keys.pop(0)
        else:
            if at > 0:
                part = part.where(F.col(name) > F.lit(cuts[at // 2 - 1]))
            if at // 2 < len(cuts):
                part = part.where(F.col(name) < F.lit(cuts[at // 2]))
    w = Window.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]).rowsBetween(Window.unboundedPreceding, 0)
    run = part.select(F.count(F.lit(1)).over(w).alias("_r"), F.coalesce(F.sum(F.col(hit).cast("long")).over(w), F.lit(0)).alias("_c"))   # ``few`` rows
    reached = F.col("_c") + before_hits >= target if by_hits else F.col("_r") + before_rows >= target
    r = run.where(reached).agg(F.min(F.struct("_r", "_c")).alias("at")).first()["at"]
    return Place(before_rows + r["_r"], before_hits + r["_c"], True)
