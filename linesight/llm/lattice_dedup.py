"""Near-duplicate vectors by lattice hashing.

1. Equal vectors become one class, so that any number of copies costs one row.
2. A class's direction is projected at random onto ``BLOCKS`` times eight
   dimensions, ``TABLES`` times over.  Each eight coordinates are decoded to the
   nearest point of the E8 lattice; the points together name a cell.
3. A class is sent to its own cell and, in each table, to the ``PROBES``
   neighbouring cells nearest to it: the ones reached by the lattice's shortest
   vectors.  Classes that meet in a cell are compared by their cosine.  Of a
   cell only a spanning forest of its links leaves the task.
4. The links' components are found; within a component, every two classes are
   compared to count the links, also those that no cell had shown.

Rows that share a cell or a component meet in groups of bounded size: small
ones are packed together by a hash, large ones are cut into parts, and each
two parts meet in a task of their own.  Copies aside, a component of n
different vectors costs n * n / 2 comparisons, spread over such tasks.

With two blocks, cells of 0.7 and three probes, a pair at cosine 0.95 in 64
dimensions meets in a table with probability 0.69, in one of four with 0.99;
one in 6,000 unrelated pairs meets.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesight.llm import words as W
from linesight.llm.common import staged
from linesight.llm.near_dedup import components

COSINE = 0.95
TABLES = 4
BLOCKS = 2
PROBES = 3
WIDTH = 0.7             # side of a cell: one lattice unit
SEED = 20250211
PART_ROWS = 1024        # rows of a part of a large cell or component
BIN_ROWS = 4096         # rows of a group of small ones
CODE_ROWS = 2048        # vectors coded at a time


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2
    with an even number of minus signs."""
    out = []
    for i, j in product(range(8), repeat=2):
        if i < j:
            for a, b in product((1.0, -1.0), repeat=2):
                v = np.zeros(8)
                v[[i, j]] = a, b
                out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return near


def nearest_lattice_point(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even integer points and the same moved by 1/2."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole)**2).sum(axis=1) <= ((x - half)**2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def projections(width: int) -> np.ndarray:
    """(tables, blocks, 8, width) random projections that keep lengths on average."""
    rng = np.random.default_rng([SEED, width])
    n = 8 * BLOCKS
    out = rng.normal(size=(TABLES, n, width)) / np.sqrt(8)
    if width >= n:      # orthogonal rows vary less
        out = np.stack([np.linalg.qr(p.T)[0].T for p in out]) * np.sqrt(width / 8)
    return out.reshape(TABLES, BLOCKS, 8, width)


def _cell_keys(points: np.ndarray, table: int, width: int) -> np.ndarray:
    """Hash of cells (rows of blocks of lattice points)."""
    twice = np.rint(2 * points).astype(np.int64).reshape(len(points), -1).view(np.uint64)
    key = np.full(len(points), np.uint64(table * 0x10001 + width * 0x1000003 + 1))
    for c in range(twice.shape[1]):
        key = W.mix(key + twice[:, c])
    return key


def cell_keys(unit: np.ndarray) -> np.ndarray:
    """(rows, tables * (1 + probes)) keys of the cells that each direction is sent to."""
    short, out = shortest_vectors(), []
    for t, blocks in enumerate(projections(unit.shape[1])):
        x = [unit @ p.T / WIDTH for p in blocks]
        own = [nearest_lattice_point(c) for c in x]
        points = np.stack(own, axis=1)
        out.append(_cell_keys(points, t, unit.shape[1]))
        # a neighbour at v is nearer the more the way to it agrees with v
        agree = np.concatenate([(c - p) @ short.T for c, p in zip(x, own, strict=True)], axis=1)
        best = np.argsort(-agree, axis=1, kind="stable")[:, :PROBES]
        for probe in best.T:
            moved = points.copy()
            moved[np.arange(len(unit)), probe // len(short)] += short[probe % len(short)]
            out.append(_cell_keys(moved, t, unit.shape[1]))
    return np.stack(out, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)         # no overflow, whatever the components
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def coded(classes: DataFrame, wide: bool) -> DataFrame:
    """(rep, n, x, keys): vectors as bytes and the cells they are sent to."""
    kind = np.float64 if wide else np.float32

    def run(it):
        for batch in it:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(size):
                same = batch.filter(pa.array(size == width))
                x = same.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
                for s in range(0, len(x), CODE_ROWS):
                    part = x[s:s + CODE_ROWS]
                    keys = cell_keys(_unit(part.astype(np.float64))).view(np.int64)
                    own = [same.column(c).slice(s, len(part)) for c in (0, 1)]
                    at = np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([v.tobytes() for v in part], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))], names=["rep", "n", "x", "keys"])
    return classes.select("rep", "n", "x").mapInArrow(run, "rep long, n long, x binary, keys array<long>")


def _meeting(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with (bin, lo, hi, part): in the groups of (bin, lo, hi), every
    two rows of the same key meet.  Keys with up to ``PART_ROWS`` rows are packed
    by a hash (lo = -1); larger ones are cut into parts, each two of which meet.
    ``keys``: the key column alone, cheaper to count."""
    sizes = keys.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    large = staged(sizes.where(F.col("size") > PART_ROWS), "large")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-total // BIN_ROWS))
    none = F.lit(-1).cast("long")
    packed = lambda df: df.select("*", F.pmod(F.xxhash64(key), F.lit(bins)).alias("bin"), none.alias("lo"), none.alias("hi"), none.alias("part"))
    if large.isEmpty():
        return packed(rows)
    parts = F.ceil(F.col("size") / PART_ROWS).cast("long")
    cut = rows.join(large, key).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    sent = cut.select(*rows.columns, "part", other)
    met = sent.select(*rows.columns, F.xxhash64(key).alias("bin"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part")
    return packed(rows.join(large, key, "left_anti")).unionByName(met)


def _compared(x: pa.Array, part: np.ndarray, wide: bool, cosine: float) -> np.ndarray:
    """Which rows are linked (a symmetric matrix); of two different parts, only
    links from one to the other."""
    raw = [np.frombuffer(v.as_buffer(), np.float64 if wide else np.float32) for v in x]
    size = np.array([len(v) for v in raw])
    linked = np.zeros((len(raw), len(raw)), bool)
    for width in np.unique(size):       # vectors of different lengths have no cosine
        at = np.flatnonzero(size == width)
        unit = _unit(np.stack([raw[i] for i in at]).astype(np.float64))
        linked[np.ix_(at, at)] = unit @ unit.T >= cosine
    if part.min() != part.max():
        linked &= part[:, None] != part[None, :]
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a spanning forest of the links."""
    left, parents, nodes = np.ones(len(linked), bool), [], []
    for seed in np.flatnonzero(linked.any(axis=1)):
        front = np.array([seed])
        if not left[seed]:
            continue
        left[seed] = False
        while len(front):
            reach = linked[front]
            new = np.flatnonzero(reach.any(axis=0) & left)
            parents.append(front[reach[:, new].argmax(axis=0)])
            nodes.append(new)
            left[new] = False
            front = new
    join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return join(parents), join(nodes)


def _by_key(table: pa.Table, key: str):
    """Rows of a group key by key, of two rows or more."""
    if table.column("lo")[0].as_py() >= 0:      # one large key, or two whose hash is the same
        table = table.sort_by([(key, "ascending"), ("part", "ascending")])
    else:
        table = table.sort_by(key)
    table = table.combine_chunks()
    k = table.column(key).to_numpy()
    cuts = np.flatnonzero(np.diff(k)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(k)), strict=True):
        if b - a > 1:
            yield table.slice(a, b - a)


def cell_links(vectors: DataFrame, wide: bool, cosine: float) -> DataFrame:
    """(a, b): in each cell, a spanning forest of its links."""
    entries = vectors.select(F.explode("keys").alias("cell"), "rep", "x")

    def run(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in _by_key(table, "cell"):
            rep = rows.column("rep").to_numpy()
            p, q = _forest(_compared(rows.column("x").combine_chunks(), rows.column("part").to_numpy(), wide, cosine))
            a.append(rep[p])
            b.append(rep[q])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})
    met = _meeting(entries, vectors.select(F.explode("keys").alias("cell")), "cell")
    return met.groupBy("bin", "lo", "hi").applyInArrow(run, "a long, b long")


def link_counts(members: DataFrame, wide: bool, cosine: float) -> DataFrame:
    """(rep, links): vectors, copies included, of other classes of the component
    that are linked with each class.  ``members``: rep, n, x, component."""
    def run(table: pa.Table) -> pa.Table:
        reps, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in _by_key(table, "component"):
            linked = _compared(rows.column("x").combine_chunks(), rows.column("part").to_numpy(), wide, cosine)
            reps.append(rows.column("rep").to_numpy())
            links.append(linked @ rows.column("n").to_numpy())
        return pa.table({"rep": pa.array(np.concatenate(reps), pa.int64()), "links": pa.array(np.concatenate(links), pa.int64())})
    met = _meeting(members, members.select("component"), "component")
    return met.groupBy("bin", "lo", "hi").applyInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def _usable(x: Column) -> Column:
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``
    (vec_id, embedding; further columns are ignored): how many other vectors it
    is linked with, the smallest vec_id reachable by links, and whether it is
    its own.

    Vectors that are null, empty, zero or hold null or non-finite components are
    linked with nothing, vectors of different lengths not with each other.  Rows
    that share a vec_id are vectors of their own.  Rows without vec_id follow
    their component and are kept only if none of it has one.  An empty table
    gives an empty result."""
    wide = dict(vectors.dtypes)["embedding"] != "array<float>"
    x = F.col("embedding").cast("array<double>" if wide else "array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.withColumn("x", F.when(_usable(F.col("x")), F.col("x")))
    rows = rows.select("vec_id", "x", *[F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(i), "x")).alias(f"d{i}") for i in (1, 2)])
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = staged(rows.where("x is not null").groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "classes")
    firsts = rows.select(F.col("row").alias("rep"), "x").join(classes.select("rep", "n"), "rep")
    cells = staged(coded(firsts, wide), "cells")
    links = staged(cell_links(cells, wide, cosine).distinct(), "links")
    comp = staged(components(links).withColumnRenamed("node", "rep"), "components")
    counts = staged(link_counts(cells.select("rep", "n", "x").join(comp, "rep"), wide, cosine), "counts")
    placed = classes.join(comp, "rep", "left").join(counts, "rep", "left")
    placed = placed.select("d1", "d2", "n", "least", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("d1", "d2", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    found = rows.where("x is not null").select("vec_id", "d1", "d2").join(named, ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
