"""Prefix relations of two sets of texts by one sorted scan.

In byte order the prefixes of a text that stand before it form a stack: a text
stays open until one comes that does not begin with it.  One pass over each
range of the sorted texts therefore gives every text's prefixes and extensions,
and what is wanted of them (minima) is carried along the stack.  Comparing a text
with the one before it is enough: an open text is a prefix of the next one where
it is no longer than what the two have in common.

A range ends with some texts open.  They are told to the following ranges for as
long as those begin with them, which two numbers a range decide (what its first
text has in common with the last one before it, and what its first and last have
in common).  The texts themselves are sorted once and read once; from there on
lengths stand for them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesight.session import materialize

VALUES = ["first_any", "first_1", "first_0"]
NONE = (1 << 62) + 1        # no value yet
AT_ONCE = 16384             # rows written at a time
ROW, OPEN, EDGE = 1, 2, 3   # what a row of the first pass tells
ASKED, GIVEN = 1, 0         # texts that ask for minima, texts that carry values
SLIM = "p int, seq long, tag int, dig binary, kind int, len long, lcp long, v0 long, v1 long, v2 long"


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that two texts have in common at their beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo + 1 < hi:          # a[:lo] == b[:lo], a[:hi] != b[:hi]
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _least(a: tuple, b: tuple) -> tuple:
    return tuple(x if x < y else y for x, y in zip(a, b, strict=True))


NOTHING = (NONE, NONE, NONE)


class _Stack:
    """The open texts: length, kind, digest, values, least values of the given
    texts among it and those below, least values of what extends it."""

    def __init__(self):
        self.open: list[list] = []

    def close(self, common: int, out: list) -> None:
        """Close the texts longer than ``common``; asked ones report their extensions."""
        while self.open and self.open[-1][0] > common:
            _, kind, dig, values, _, below = self.open.pop()
            if kind == ASKED and below != NOTHING:
                out.append((dig, *below))
            if self.open:
                self.open[-1][5] = _least(self.open[-1][5], _least(values, below))

    def add(self, length: int, kind: int, dig: bytes, values: tuple) -> tuple:
        """Open a text; the least values of its prefixes."""
        above = self.open[-1][4] if self.open else NOTHING
        self.open.append([length, kind, dig, values, _least(above, values), NOTHING])
        return above


def _first_pass(ordered: DataFrame) -> DataFrame:
    """A row for each text (tag ROW) in order, with its length and what it has in
    common with the text before; then the texts open at the end of the range
    (OPEN) and the range's first and last text (EDGE)."""
    def run(it):
        stack, previous, first, p, seq, out = _Stack(), None, None, 0, 0, []

        def batch_of(rows):
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in it:
            for p, dig, key, kind, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                values = tuple(NONE if v is None else v for v in values)
                common = len(key) if previous is None else common_prefix(previous, key)
                first = key if first is None else first
                stack.close(common, [])
                stack.add(len(key), kind, dig, values)
                out.append((p, seq, ROW, dig, kind, len(key), common, *values, None, None))
                previous, seq = key, seq + 1
                if len(out) >= AT_ONCE:
                    yield batch_of(out)
                    out = []
        if previous is not None:
            out += [(p, seq, OPEN, dig, kind, length, 0, *values, None, None) for length, kind, dig, values, _, _ in stack.open]
            out.append((p, seq, EDGE, None, None, 0, 0, NONE, NONE, NONE, first, previous))
            yield batch_of(out)
    names = [c.split()[0] for c in SLIM.split(", ")] + ["first", "last"]
    return ordered.select("p", "dig", "key", "kind", *VALUES).mapInArrow(run, SLIM + ", first binary, last binary")


def _range_edges(scanned: DataFrame) -> list[tuple[int, int, int]]:
    """(range, common with the range before, common of its own ends) of every
    range that is not empty: three numbers a range reach the driver."""
    edges = scanned.where(F.col("tag") == EDGE).select("p", "first", "last")
    pairs = edges.withColumn("before", F.lag("last").over(Window.orderBy("p")))      # a row a range

    def run(it):
        for batch in it:
            rows = [(p, -1 if before is None else common_prefix(before, first), common_prefix(first, last))
                    for p, first, last, before in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["p", "before", "own"])
    return sorted(tuple(r) for r in pairs.mapInArrow(run, "p long, before long, own long").collect())


def _carried(scanned: DataFrame, edges: list[tuple[int, int, int]]) -> DataFrame:
    """The texts that are open at the beginning of each range."""
    place = {p: i for i, (p, _, _) in enumerate(edges)}

    def run(it):
        for batch in it:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for p, before, own in edges[place[row[0]] + 1:]:
                    if before < row[5]:
                        break
                    out.append((p, *row[1:]))
                    if own < row[5]:
                        break
            for s in range(0, len(out), AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[s:s + AT_ONCE], strict=True), batch.schema, strict=True)], schema=batch.schema)
    columns = [c.split()[0] for c in SLIM.split(", ")]
    return scanned.where(F.col("tag") == OPEN).select(*columns).mapInArrow(run, SLIM)


def prefix_minima(asked: DataFrame, given: DataFrame, partitions: int | None = None) -> DataFrame:
    """(rdig, first_any, first_1, first_0): for each text of ``asked`` (dig, norm)
    the least values over the texts of ``given`` (dig, norm and the values; null:
    none) where one begins with the other; texts without any have no row.  Digests
    tell the texts of each side apart.  An empty text is a prefix of all."""
    from linesight.operators.global_order import range_partitions
    key = F.encode("norm", "UTF-8").alias("key")
    none = [F.lit(None).cast("long").alias(v) for v in VALUES]
    rows = asked.select("dig", key, F.lit(ASKED).alias("kind"), *none).union(given.select("dig", key, F.lit(GIVEN).alias("kind"), *[F.col(v).cast("long") for v in VALUES]))
    n = partitions or range_partitions(rows)
    ordered = rows.repartitionByRange(n, "key").sortWithinPartitions("key", "kind", "dig").withColumn("p", F.spark_partition_id())
    scanned = materialize(_first_pass(ordered))
    edges = _range_edges(scanned)
    columns = [c.split()[0] for c in SLIM.split(", ")]
    stream = scanned.where(F.col("tag") == ROW).select(*columns).unionByName(_carried(scanned, edges).withColumn("seq", F.lit(-1).cast("long")))
    ordered = stream.repartition(max(1, len(edges)), "p").sortWithinPartitions("p", "seq", "len")

    def run(it):
        stack, now, out = _Stack(), None, []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.binary(), *[pa.int64()] * 3], strict=True)], names=["rdig", *VALUES])
        for batch in it:
            for p, seq, _, dig, kind, length, common, *values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != now:
                    stack.close(-1, out)
                    now = p
                if seq >= 0:
                    stack.close(common, out)
                above = stack.add(length, kind, dig, tuple(values))
                if kind == ASKED and seq >= 0 and above != NOTHING:
                    out.append((dig, *above))
            if len(out) >= AT_ONCE:
                yield batch_of()
                out = []
        stack.close(-1, out)
        if out:
            yield batch_of()
    found = ordered.mapInArrow(run, "rdig binary, " + ", ".join(f"{v} long" for v in VALUES))
    least = found.groupBy("rdig").agg(*[F.min(v).alias(v) for v in VALUES])
    return least.select("rdig", *[F.when(F.col(v) < NONE, F.col(v)).alias(v) for v in VALUES])
