"""Synthetic minority vectors: SMOTE and ADASYN on exact neighbours.

A synthetic vector lies on the segment from a minority vector to one of its
nearest neighbours of the same class.  Which vector, which neighbour and where
on the segment are seeded draws by the number of the synthetic row, so the
result is the same under any partitioning.  Neighbours come from the exact
search of ``nearest``; only ids are ordered globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.operators.matching import with_row_index
from linesight.operators.nearest import nearest
from linesight.operators.sampling import class_counts, draw
from linesight.session import materialize

NEIGHBOURS = 5          # fixed: neighbours of the studied resamplers
STEPS = 1 << 30         # places on a segment


def _class_neighbours(df: DataFrame, label: str, cls, id_col: str, vec: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, x) of a class and (id, neighbours): ids of the k nearest others of the class."""
    own = materialize(df.where(F.col(label).eqNullSafe(F.lit(cls))).select(F.col(id_col).alias("id"), F.col(vec).alias("x")))
    found = nearest(own, own, k)
    lists = found.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("to")))), lambda s: s["to"]).alias("neighbours"))
    return own, materialize(own.select("id").join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array("id"))))


def _interpolated(rows: DataFrame, own: DataFrame) -> DataFrame:
    """``rows`` (base, neighbour, u and more) with x = base + u (neighbour - base)."""
    a, b = own.select(F.col("id").alias("base"), F.col("x").alias("_a")), own.select(F.col("id").alias("neighbour"), F.col("x").alias("_b"))
    both = rows.join(a, "base").join(b, "neighbour")
    mixed = F.zip_with(F.col("_a").cast("array<double>"), F.col("_b").cast("array<double>"), lambda p, q: F.struct(p.alias("p"), (q - p).alias("d")))
    # the place on the segment is paired in: a lambda must not read the row again for each component
    at = F.zip_with(mixed, F.array_repeat("u", F.size(mixed)), lambda s, u: s["p"] + u * s["d"])
    return both.select(*rows.columns, at.alias("x"))


def _chosen(rows: DataFrame, seed: int) -> DataFrame:
    """(draw, base, neighbour, u) of ``rows`` (draw, base, neighbours): one of the
    neighbours and a place on the way to it."""
    which = (F.pmod(draw("neighbour", F.col("draw"), seed), F.size("neighbours")) + 1).cast("int")
    u = F.pmod(draw("gap", F.col("draw"), seed), F.lit(STEPS)) / F.lit(float(STEPS))
    return rows.select("draw", "base", F.element_at("neighbours", which).alias("neighbour"), u.alias("u"))


def smote(df: DataFrame, vec: str, label: str, id_col: str, seed: int, k: int = NEIGHBOURS) -> DataFrame:
    """(label, draw, base, neighbour, u, x): synthetic rows that bring every
    class to the size of the largest; draw counts from 0 in each class.  Bases
    are drawn with replacement by their place in id order.  Classes of at most k
    rows use the neighbours there are; the row of a class of one is repeated.
    ``vec``: arrays of one length, finite; ids are unique."""
    counts = class_counts(df, label)
    most, out = max(counts.values(), default=0), None
    kind = df.schema[label].dataType
    for cls, n in sorted(counts.items(), key=lambda c: str(c[0])):          # one entry a class
        if n < most:
            own, lists = _class_neighbours(df, label, cls, id_col, vec, k)
            places = with_row_index(own.select("id"), ["id"], "place")
            draws = df.sparkSession.range(most - n).select(F.col("id").alias("draw"), F.pmod(draw("base", F.col("id"), seed), F.lit(n)).alias("place"))
            rows = draws.join(places, "place").join(lists, "id").select("draw", F.col("id").alias("base"), "neighbours")
            made = _interpolated(_chosen(rows, seed), own).select(F.lit(cls).cast(kind).alias(label), "draw", "base", "neighbour", "u", "x")
            out = made if out is None else out.unionByName(made)
    if out is None:
        empty = df.select(label, F.col(id_col).alias("base"), F.col(id_col).alias("neighbour"), F.col(vec).cast("array<double>").alias("x")).limit(0)
        out = empty.select(label, F.lit(0).cast("long").alias("draw"), "base", "neighbour", F.lit(0.0).alias("u"), "x")
    return out


def adasyn_shares(df: DataFrame, vec: str, label: str, id_col: str, minority, k: int = NEIGHBOURS) -> DataFrame:
    """(id, others, n): for every minority row, how many of its k nearest rows of
    all classes are of another class, and how many synthetic rows it gets.  The
    n add up to the size of the largest class less that of the minority: each
    row's part is others / sum(others) of that, whole parts first, the rest to
    the largest remainders (ties to the smaller id).  No row has other neighbours:
    all n are 0."""
    counts = class_counts(df, label)
    total = max(counts.values(), default=0) - counts.get(minority, 0)
    is_own = F.col(label).eqNullSafe(F.lit(minority))
    rows = materialize(df.select(F.col(id_col).alias("id"), F.col(vec).alias("x"), is_own.alias("own")))
    found = nearest(rows.select("id", "x"), rows.where("own").select("id", "x"), k)
    met = found.join(rows.select("id", "own"), "id").groupBy(F.col("query_id").alias("id")).agg(F.count_if(~F.col("own")).alias("others"))
    met = materialize(rows.where("own").select("id").join(met, "id", "left").withColumn("others", F.coalesce("others", F.lit(0)).cast("long")))
    weight = met.agg(F.sum("others")).first()[0] or 0
    if weight == 0:
        return met.withColumn("n", F.lit(0).cast("long"))
    exact = F.lit(total).cast("decimal(19,0)") * F.col("others").cast("decimal(19,0)")
    parts = met.select("id", "others", F.expr(f"cast({total} as decimal(19,0)) * cast(others as decimal(19,0)) div cast({weight} as decimal(19,0))").alias("whole"),
                       (exact % F.lit(weight).cast("decimal(19,0)")).cast("long").alias("rest"))
    left = total - (parts.agg(F.sum("whole")).first()[0] or 0)
    # only (remainder, id) is ordered: the first ``left`` get one more
    placed = with_row_index(parts, [F.col("rest").desc(), F.col("id").asc()], "place")
    return placed.select("id", "others", (F.col("whole") + (F.col("place") < left).cast("long")).alias("n"))


def adasyn(df: DataFrame, vec: str, label: str, id_col: str, seed: int, minority, k: int = NEIGHBOURS) -> DataFrame:
    """(label, draw, base, neighbour, u, x): synthetic rows of ``minority`` that
    bring it to the size of the largest class, more of them where more of the
    neighbours are of other classes (``adasyn_shares``).  draw is
    "base:number"; neighbours are those of the same class."""
    shares = adasyn_shares(df, vec, label, id_col, minority, k).where("n > 0")
    own, lists = _class_neighbours(df, label, minority, id_col, vec, k)
    each = shares.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("number"))
    rows = each.join(lists, "id").select(F.concat_ws(":", "id", "number").alias("draw"), F.col("id").alias("base"), "neighbours")
    made = _interpolated(_chosen(rows, seed), own)
    return made.select(F.lit(minority).cast(df.schema[label].dataType).alias(label), "draw", "base", "neighbour", "u", "x")
