"""Decision trees and random forests on sparse counts, level by level.

MLlib's trees keep a bin for every feature of every row, so their training rows
take (rows x vocabulary) and grow with the square of a corpus.  Here a row keeps
the entries it has.  A level of all trees is one pass: tasks sum the class weights
of (node, feature, bin) over their rows' entries, one shuffle by (node, feature)
adds them up, and a node's zeros are its total less its entries.  The candidate
thresholds (MLlib's: midpoints, or ``MAX_BINS`` weighted quantiles), the gini gain,
its ties and the merging of equal leaves are MLlib's; the bins come from all rows,
not from a sample.  The model, the thresholds and one row for each open node are
on the driver, as MLlib's are.

Values are not negative, rows have an index once, in rising order (as sparse
vectors do).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesight.session import materialize

MAX_BINS = 32
HELD = 1 << 21      # sums that a task holds before it passes them on
SLOTS = 32          # nodes of a tree whose feature subsets are told apart at once
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(row_seeds: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1): how often a tree's sample holds each row."""
    with np.errstate(over="ignore"):
        u = _mix(row_seeds ^ _mix(np.array([seed * 1_000_003 + tree], np.uint64)))
    return np.searchsorted(POISSON, (u >> np.uint64(11)) * 2.0 ** -53, "right")


def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(-1, keepdims=True)
    share = stats / np.where(total > 0, total, 1.0)
    return 1.0 - (share * share).sum(-1)


def thresholds_of(values: list[float], weights: list[float], zeros: float, bins: int) -> list[float]:
    """Split points of a feature: midpoints of neighbouring values, or where there
    are more than ``bins`` values those nearest to equal weights."""
    if zeros > 0:
        values, weights = [0.0, *values], [zeros, *weights]
    if len(values) <= bins:
        return [(a + b) / 2.0 for a, b in zip(values, values[1:])]
    stride = sum(weights) / bins
    out, count, target = [], weights[0], stride
    for i in range(1, len(values)):
        before, count = count, count + weights[i]
        if abs(before - target) < abs(count - target):
            out.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return out


class _Entries:
    """A batch of rows in compressed form: ``of`` (row), ``f``, ``v`` of each entry."""

    def __init__(self, indices: pa.ListArray, values: pa.ListArray):
        sizes = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
        self.n = len(sizes)
        self.of = np.repeat(np.arange(self.n), sizes)
        self.f = indices.flatten().to_numpy(zero_copy_only=False).astype("int64")
        self.v = values.flatten().to_numpy(zero_copy_only=False)
        there = self.v != 0
        if not there.all():
            self.of, self.f, self.v = self.of[there], self.f[there], self.v[there]

    def keys(self, n_features: int) -> np.ndarray:
        return self.of * n_features + self.f


class Forest:
    """Nodes of all trees: ``feature`` (-1: leaf), ``cut`` (values above it go
    right), ``left``, ``right``, ``stats`` (class weights).  The first ones are the roots."""

    def __init__(self, roots: np.ndarray, n_features: int):
        self.trees, self.n_features = len(roots), n_features
        self.stats = roots
        self.feature = np.full(self.trees, -1)
        self.cut = np.zeros(self.trees)
        self.left, self.right = np.zeros(self.trees, int), np.zeros(self.trees, int)
        self.tree = np.arange(self.trees)

    def grow(self, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, right_stats: np.ndarray) -> np.ndarray:
        """Split the nodes; returns the children, left and right in turn."""
        at = len(self.feature) + 2 * np.arange(len(node))
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        rest = self.stats[node] - right_stats
        new = np.stack([rest, right_stats], 1).reshape(-1, self.stats.shape[1])
        self.stats = np.concatenate([self.stats, new])
        more = len(new)
        self.feature = np.append(self.feature, np.full(more, -1))
        self.cut = np.append(self.cut, np.zeros(more))
        self.left, self.right = (np.append(x, np.zeros(more, int)) for x in (self.left, self.right))
        self.tree = np.append(self.tree, np.repeat(self.tree[node], 2))
        return np.arange(len(self.feature) - more, len(self.feature))

    def merge_equal_leaves(self) -> None:
        """Two leaves of one prediction become one (children come after their node)."""
        says = self.stats.argmax(1)
        for i in np.flatnonzero(self.feature >= 0)[::-1]:
            a, b = self.left[i], self.right[i]
            if self.feature[a] < 0 and self.feature[b] < 0 and says[a] == says[b]:
                self.feature[i] = -1

    def walk(self, rows: _Entries, tree: int, keys: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        node = np.full(rows.n, tree)
        moving = np.arange(rows.n)
        while len(moving):
            f = self.feature[node[moving]]
            moving, f = moving[f >= 0], f[f >= 0]
            if not len(moving):
                break
            want = moving * self.n_features + f
            at = np.searchsorted(keys, want)
            value = np.zeros(len(moving))
            hit = np.flatnonzero(at < len(keys))
            hit = hit[keys[at[hit]] == want[hit]]
            value[hit] = rows.v[at[hit]]
            here = node[moving]
            node[moving] = np.where(value > self.cut[here], self.right[here], self.left[here])
        return node


class SparseTrees:
    """Estimator: ``trees`` trees of ``depth`` levels; with ``subset`` every tree has a
    Poisson sample of the rows and every node the root of the features' number."""

    def __init__(self, trees: int, depth: int, subset: bool, label: str, weight: str | None, seed: int, id_col: str = "doc_id"):
        self.trees, self.depth, self.subset, self.label = trees, depth, subset, label
        self.weight, self.seed, self.id_col = weight, seed, id_col

    def fit(self, df: DataFrame) -> SparseTreesModel:
        spark = df.sparkSession
        indices, values, width = _fields()
        given = (F.col(self.weight) if self.weight else F.lit(1.0)).cast("double")
        size = df.agg(F.max(width), F.max(self.label), F.max(given)).first()
        # weights of 25 bits add up exactly, in whatever order: ties stay ties
        unit = 2.0 ** (math.floor(math.log2(size[2])) - 24) if size[2] and size[2] > 0 else 1.0
        n_features, classes = int(size[0] or 0), int(size[1] or 0) + 1
        seed = F.xxhash64(self.id_col) if self.id_col in df.columns else F.xxhash64(indices, values)
        rows = df.select(F.col(self.label).cast("int").alias("label"),
                         (F.round(given / F.lit(unit)) * F.lit(unit)).alias("weight"),
                         seed.alias("seed"), indices.alias("indices"), values.alias("values"))
        rows = materialize(rows)
        roots = self._roots(rows, classes)
        model = Forest(roots, n_features)
        offsets, cuts = self._thresholds(rows, n_features)
        held_cuts = spark.sparkContext.broadcast((offsets, cuts))
        model.offsets = offsets
        opened = np.flatnonzero(_gini(roots) > 1e-12)
        for _ in range(self.depth):
            if not len(opened):
                break
            held = spark.sparkContext.broadcast(model)
            best = self._best(rows, held, held_cuts, opened).toArrow()
            held.destroy()
            if not best.num_rows:
                break
            node, at = (best.column(c).to_numpy() for c in ("node", "at"))
            order = np.argsort(node)
            node, at = node[order], at[order]
            right = np.array(best.column("right").to_pylist(), float).reshape(-1, classes)[order]
            feature = np.searchsorted(offsets, at, "right") - 1
            opened = model.grow(node, feature, cuts[at], right)
            opened = opened[_gini(model.stats[opened]) > 1e-12]
        held_cuts.destroy()
        model.merge_equal_leaves()
        return SparseTreesModel(model, spark)

    def _roots(self, rows: DataFrame, classes: int) -> np.ndarray:
        """Class weights of every tree's sample."""
        trees, subset, seed = self.trees, self.subset, self.seed

        def run(it):
            acc = np.zeros((trees, classes))
            for b in it:
                label, weight, seeds = _columns(b)
                for t in range(trees):
                    acc[t] += np.bincount(label, weight * _draws(seeds, t, seed) if subset else weight, classes)
            yield pa.RecordBatch.from_pydict({"s": [acc.tobytes()]})
        got = rows.select("label", "weight", "seed").coalesce(64).mapInArrow(run, "s binary").collect()
        return sum((np.frombuffer(bytes(r["s"])).reshape(trees, classes) for r in got), np.zeros((trees, classes)))

    def _thresholds(self, rows: DataFrame, n_features: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each feature's split points begin, and the split points."""
        total = rows.agg(F.sum("weight"), F.count(F.lit(1))).first()
        everything, bins = float(total[0] or 0.0), max(2, min(MAX_BINS, int(total[1])))

        def count(it):
            for b in it:
                _, weight, _ = _columns(b)
                x = _Entries(b.column(3), b.column(4))
                order = np.lexsort((x.v, x.f))
                f, v = x.f[order], x.v[order]
                first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (v[1:] != v[:-1])][:len(f)])
                if len(first):
                    sums = np.add.reduceat(weight[x.of[order]], first)
                    yield pa.RecordBatch.from_arrays([pa.array(f[first].astype("int32")), pa.array(v[first]), pa.array(sums)], names=["f", "v", "w"])

        def cut(it):
            for b in it:
                out = []
                for h in b.column(1).to_pylist():
                    w = [e["w"] for e in h]
                    zeros = everything - sum(w)
                    out.append(thresholds_of([e["v"] for e in h], w, zeros if zeros > 1e-9 * everything else 0.0, bins))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["f", "t"])
        values = rows.mapInArrow(count, "f int, v double, w double").groupBy("f", "v").agg(F.sum("w").alias("w"))
        by_feature = values.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("h"))
        got = by_feature.mapInArrow(cut, "f int, t array<double>").toArrow()
        f = got.column("f").to_numpy()
        lists = got.column("t").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        lists = lists.take(pa.array(np.argsort(f)))
        sizes = np.zeros(n_features + 1, int)
        sizes[np.sort(f) + 1] = lists.value_lengths().to_numpy()
        return np.cumsum(sizes), lists.flatten().to_numpy()

    def _best(self, rows: DataFrame, model, held_cuts, opened: np.ndarray) -> DataFrame:
        """(node, at, right): the best split point of the open nodes that gain by one."""
        subset, seed = self.subset, self.seed
        classes = model.value.stats.shape[1]
        n_features = model.value.n_features
        wanted = math.ceil(math.sqrt(n_features))

        def sums(it):
            forest, (offsets, cuts) = model.value, held_cuts.value
            slot_of = np.full(len(forest.feature), -1)
            by_tree = {}
            for node in opened:
                mine = by_tree.setdefault(int(forest.tree[node]), [])
                slot_of[node] = len(mine)
                mine.append(int(node))
            chosen = {}
            if subset:
                chosen = {n: np.random.default_rng([seed, n]).choice(n_features, wanted, replace=False, shuffle=False)
                          for mine in by_tree.values() for n in mine}
            mask = np.zeros(n_features, np.uint32)
            # a value's place: how many of its feature's split points lie below it
            scale = len(cuts) + n_features + 1
            held, size = [], 0
            for b in it:
                label, weight, seeds = _columns(b)
                x = _Entries(b.column(3), b.column(4))
                keys = x.keys(n_features)
                above = _places(x, offsets, cuts)
                split = above > 0           # an entry below its feature's first split point is like a zero
                at = offsets[x.f] + above - 1
                for tree, mine in by_tree.items():
                    w = weight * _draws(seeds, tree, seed) if subset else weight
                    slot = slot_of[forest.walk(x, tree, keys)]
                    slot[w == 0] = -1
                    if not subset:
                        found = [np.flatnonzero(split & (slot[x.of] >= 0))]
                    else:
                        found = []
                        for s in range(0, len(mine), SLOTS):
                            for i, n in enumerate(mine[s:s + SLOTS]):
                                mask[chosen[n]] |= np.uint32(1 << i)
                            near = np.flatnonzero(mask[x.f])
                            of = slot[x.of[near]] - s
                            near, of = near[(of >= 0) & (of < SLOTS)], of[(of >= 0) & (of < SLOTS)]
                            near = near[(mask[x.f[near]] >> of.astype(np.uint32)) & np.uint32(1) > 0]
                            found.append(near[split[near]])
                            for n in mine[s:s + SLOTS]:
                                mask[chosen[n]] = 0
                    e = np.concatenate(found)
                    if not len(e):
                        continue
                    node = np.array(mine)[slot[x.of[e]]]
                    held.append(_summed((node * scale + at[e]) * classes + label[x.of[e]], w[x.of[e]]))
                    size += len(held[-1][0])
                    if size >= HELD:
                        held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
                        size = len(held[0][0])
                        if size >= HELD // 2:
                            yield from _sum_rows(held[0], scale, classes, offsets)
                            held, size = [], 0
            if held:
                yield from _sum_rows(_summed(*(np.concatenate(c) for c in zip(*held))), scale, classes, offsets)

        def gains(it):
            forest = model.value
            left_over = None
            for b in it:
                cols = [b.column(c).to_numpy() for c in range(5)]
                if left_over is not None:
                    cols = [np.append(a, c) for a, c in zip(left_over, cols)]
                node, f = cols[0], cols[1]
                last = np.flatnonzero((node[1:] != node[:-1]) | (f[1:] != f[:-1]))
                end = last[-1] + 1 if len(last) else 0       # the last (node, feature) may go on
                left_over = [c[end:] for c in cols]
                if end:
                    yield _gains([c[:end] for c in cols], forest, classes)
            if left_over is not None and len(left_over[0]):
                yield _gains(left_over, forest, classes)

        parts = rows.mapInArrow(sums, "node int, f int, at int, class int, w double")
        dealt = parts.repartition("node", "f").sortWithinPartitions("node", "f", "at")
        best = dealt.mapInArrow(gains, "node int, gain double, at int, right array<double>")
        top = best.groupBy("node").agg(F.max(F.struct("gain", (-F.col("at")).alias("less"), "at", "right")).alias("b"))
        return top.select("node", "b.at", "b.right")


def _fields() -> tuple[Column, Column, Column]:
    """Indices, values and size of the column ``features``, sparse or dense."""
    v = F.unwrap_udt("features")
    return (F.coalesce(v["indices"], F.transform(v["values"], lambda x, i: i)), v["values"], F.coalesce(v["size"], F.size(v["values"])))


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    label, weight, seed = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
    return label.astype("int64"), weight, seed.astype("int64").view(np.uint64)


def _places(x: _Entries, offsets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each entry the number of its feature's split points below its value."""
    low, high = offsets[x.f].copy(), offsets[x.f + 1].copy()
    while True:     # all entries' binary searches side by side
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low - offsets[x.f]
        middle = (low[open_] + high[open_]) // 2
        below = cuts[middle] < x.v[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(w, first)


def _sum_rows(held, scale: int, classes: int, offsets: np.ndarray):
    for s in range(0, len(held[0]), 1 << 16):
        key, w = held[0][s:s + (1 << 16)], held[1][s:s + (1 << 16)]
        at = key // classes % scale
        f = np.searchsorted(offsets, at, "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(c.astype("int32")) for c in (key // classes // scale, f, at, key % classes)] + [pa.array(w)],
                                         names=["node", "f", "at", "class", "w"])


def _gains(cols: list[np.ndarray], forest: Forest, classes: int) -> pa.RecordBatch:
    """The best split point of each node among whole (node, feature) groups."""
    node, f, at, label, w = cols
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (at[1:] != at[:-1])])
    each = np.stack([np.add.reduceat(np.where(label == c, w, 0.0), first) for c in range(classes)], 1)
    node, f, at = node[first], f[first], at[first]
    begins = np.r_[True, (node[1:] != node[:-1]) | (f[1:] != f[:-1])]
    group = np.cumsum(begins) - 1
    last = np.append(np.flatnonzero(begins)[1:], len(node)) - 1
    upto = np.cumsum(each, 0)
    right = upto[last[group]] - upto + each             # this place and the ones above it
    total = forest.stats[node]
    left = total - right
    # split points with the same rows below are one; the lowest stands for it
    cut = np.where(begins, forest.offsets[f], np.append(-1, at[:-1] + 1))
    whole = total.sum(1)
    nl, nr = left.sum(1), right.sum(1)
    gain = _gini(total) - nl / whole * _gini(left) - nr / whole * _gini(right)
    ok = (nl > 1e-9 * whole) & (nr > 1e-9 * whole) & (gain > 0)
    node, gain, cut, right = node[ok], gain[ok], cut[ok], right[ok]
    order = np.lexsort((cut, -gain, node))
    best = order[np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]][:len(order)])]
    flat = right[best]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, classes, dtype="int32")), pa.array(flat.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(node[best].astype("int32")), pa.array(gain[best]), pa.array(cut[best].astype("int32")), lists],
                                      names=["node", "gain", "at", "right"])


class SparseTreesModel:
    """``transform`` adds ``probability`` (the mean of the trees' leaves) and ``prediction``."""

    def __init__(self, forest: Forest, spark):
        self.forest = forest
        self._held = spark.sparkContext.broadcast(forest)

    def transform(self, df: DataFrame) -> DataFrame:
        held = self._held

        @F.arrow_udf("array<double>")
        def judge(indices: pa.Array, values: pa.Array) -> pa.Array:
            forest = held.value
            x = _Entries(indices, values)
            keys = x.keys(forest.n_features)
            out = np.zeros((x.n, forest.stats.shape[1]))
            share = forest.stats / np.maximum(forest.stats.sum(1, keepdims=True), 1e-300)
            for tree in range(forest.trees):
                out += share[forest.walk(x, tree, keys)]
            out /= forest.trees
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype="int32")), pa.array(out.ravel()))
        indices, values, _ = _fields()
        out = df.withColumn("_p", judge(indices, values))
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumn("probability", array_to_vector("_p")).withColumn("prediction", best.cast("double")).drop("_p")
