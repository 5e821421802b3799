"""Near-duplicate groups by SetSketch registers.

Every text is a set of distinct word shingles.  A set's sketch has ``M``
registers.  Each shingle offers every register one value: the j-th in its own
order of registers is drawn from the j-th of M equally likely slices of an
exponential distribution, so a text's register is the smallest offer and later
slices need not be drawn once all registers lie below them.  The minima are
stored on an exponentially spaced, truncated integer scale.

1. One pass over the texts: set size, a 128-bit digest of the set, registers.
2. Equal sets (copies) become one class, named by its first row.
3. Bands of ``ROWS`` registers are hashed; classes that share a band are
   candidates.  A bucket is never expanded into all its pairs: each member is
   paired with the bucket's most connected member, its centre, and the pairs are
   filtered by the likelihood estimate.
4. The classes of the remaining pairs are checked on their full sets: one text
   for each is read again (found by a bitmap of fixed size) and goes to the
   centres it is paired with, where all sets are built and compared.  Links are
   joined into components.
5. Buckets whose members still lie in several components are finished: those
   that share members form families.  Members outside a family's largest
   component are compared with all its members by their registers, in blocks;
   the members that have a likely partner in another component, and only they,
   are compared on their full sets, in parts of bounded size.
6. Components by alternating large-star and small-star joins.

Registers: 63 in 21 bands of 3, so a pair at similarity 0.75 shares a band
with probability 1 - 1e-5.  The estimate drops a pair only below ``similarity``
minus ``SLACK`` (five standard deviations).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.llm import bitmap
from linesight.llm import words as W
from linesight.llm.common import discard, row_key, staged

WORDS = 5
PERCENT = 75
M = 64                  # registers (a power of two: an odd stride visits all)
ROWS = 3
BANDS = M // ROWS
BASE = 1.001            # spacing of the register scale
RATE = 20.0             # rate of the exponential distribution
TOP = 2**16 - 1         # registers are truncated to 0 .. TOP
SHIFT = 8000            # keeps the registers of one-element sets above 0
SLACK = 0.28
BLOCK = 1024            # members of a family that are compared with as many others at a time
PART = 1 << 18          # shingles of the sets that a task builds at a time, about
TOGETHER = 64           # partners tried at a time until one is likely
COLUMNS = 2048          # shingles counted at a time

SKETCH = "doc_id long, key long, n_shingles long, d1 long, d2 long, registers binary"
NODE = "a long, b long"


def shingle_sets(words: W.Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes row after row, and each row's count.
    Fewer than k words are one shingle; no words, none."""
    counts, first = words.counts, words.first
    runs = W.grams(words.hashes, k)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(at[-1], np.uint64)
    for r in range(len(counts)):
        seg = out[at[r]:at[r + 1]]
        if counts[r] >= k:
            seg[:] = runs[first[r]:first[r] + counts[r] - k + 1]
            seg.sort()
        elif counts[r]:
            seg[:] = W.grams(words.hashes[first[r]:first[r + 1]], int(counts[r]))
    row = np.repeat(np.arange(len(counts)), n)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.bincount(row[new], minlength=len(counts))


def registers(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers of each row's set, as uint16 (rows x M)."""
    low = np.full(len(n) * M, 1.0)
    row = np.repeat(np.arange(len(n)), n)
    start = shingles & np.uint64(M - 1)
    stride = ((shingles >> np.uint64(6)) & np.uint64(M // 2 - 1)) * np.uint64(2) + np.uint64(1)
    for j in range(M):
        u = (W.mix(shingles + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0**-53
        place = ((start + stride * np.uint64(j)) & np.uint64(M - 1)).astype(np.int64)
        np.minimum.at(low, row * M + place, (u + j) / M)
        open_rows = low.reshape(len(n), M).max(axis=1) >= (j + 1) / M
        keep = open_rows[row]
        if not keep.any():
            break
        if not keep.all():
            row, shingles, start, stride = row[keep], shingles[keep], start[keep], stride[keep]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(-np.log1p(-np.minimum(low, 1 - 2.0**-53)) / RATE) / np.log(BASE))
    return np.clip(value + SHIFT, 0, TOP).astype(np.uint16).reshape(len(n), M)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs, from how many registers are
    larger in a, larger in b and equal, given both set sizes."""
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 51)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pu, pd = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = sum(np.where(k > 0, k * np.log(np.maximum(q, 1e-300)), 0) for k, q in ((up, pu), (down, pd), (same, 1 - pu - pd)))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def likely(a, b, na, nb, percent: int) -> np.ndarray:
    """Pairs that sizes and registers leave possible."""
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    out = np.zeros(len(na), bool)
    if fits.any():
        out[fits] = estimate(a[fits], b[fits], na[fits], nb[fits]) >= percent / 100 - SLACK
    return out


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def sketch(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, digest and registers of every row."""
    def run(it):
        for batch in it:
            for rows, words in W.batches(batch.column(2), W.NON_SPACE):
                sets, n = shingle_sets(words, k)
                at = np.concatenate([[0], np.cumsum(n)])
                total = [np.concatenate([[np.uint64(0)], np.cumsum(W.mix(sets ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                d1, d2 = ((t[at[1:]] - t[at[:-1]]).view(np.int64) for t in total)
                reg = registers(sets, n)
                own = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in reg], pa.binary())], names=["doc_id", "key", "n_shingles", "d1", "d2", "registers"])
    return docs.select(F.col("doc_id").cast("long"), row_key("text").alias("key"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _sets(texts: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for _, words in W.batches(texts, W.NON_SPACE):
        sets, n = shingle_sets(words, k)
        out += np.split(sets, np.cumsum(n)[:-1])
    return out


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the joint estimate leaves possible."""
    for c in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}")), c)

    def run(it):
        for x in it:
            if x.num_rows:
                keep = likely(_matrix(x.column("ra"), np.uint16, M), _matrix(x.column("rb"), np.uint16, M), x.column("na").to_numpy(zero_copy_only=False), x.column("nb").to_numpy(zero_copy_only=False), percent)
                yield x.select(["a", "b"]).filter(pa.array(keep))
    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, NODE)


def _with_texts(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Broadcast]:
    """``wanted`` (at_id, at_key and more) with the text of a row of that doc_id
    and key, and the bitmap to destroy afterwards.  Texts that are not wanted are
    dropped where they are read, but for the few that share a bit of the bitmap."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(bitmap.build(wanted.select(F.xxhash64("at_id", "at_key"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.where(bitmap.may_hold(held, F.xxhash64("doc_id", "key")))
    return wanted.join(rows, F.col("at_id").eqNullSafe(F.col("doc_id")) & (F.col("at_key") == F.col("key"))).drop("at_id", "at_key", "doc_id", "key"), held


def _runs(table: pa.Table, by: str):
    """Rows of a group that share ``by``, run by run."""
    table = table.sort_by(by).combine_chunks()
    value = table.column(by).to_numpy()
    cuts = np.flatnonzero(np.diff(value)) + 1
    for s, e in zip(np.append(0, cuts), np.append(cuts, len(value)), strict=True):
        yield table.slice(s, e - s)


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough.  Sets meet at b, their
    centre: small centres are packed by a hash, the members of a large one are
    dealt into parts, each with the centre's own text."""
    roles = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), "b").distinct())
    where = classes.select(F.col("cid").alias("a"), "n_shingles", "at_id", "at_key")
    roles = staged(roles.join(where, "a"), "roles")
    weights = staged(roles.groupBy("b").agg(F.ceil(F.sum("n_shingles") / PART).cast("long").alias("parts"), F.sum("n_shingles").alias("weight")), "weights")
    bins = max(1, -(-(weights.where("parts = 1").agg(F.sum("weight")).first()[0] or 0) // PART))
    own, none = F.col("a") == F.col("b"), F.lit(-1).cast("long")
    part = F.when(F.col("parts") == 1, F.array(none)).when(own, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("a"), F.col("parts"))))
    bin_ = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("b"), F.lit(bins))).otherwise(F.xxhash64("b"))
    goes = F.explode(F.transform(part, lambda p: F.struct(F.col("b").alias("b"), bin_.alias("bin"), p.alias("part")))).alias("to")
    # one row for a class: the groups it goes to, at most one a band, and one a part of its own
    wanted = roles.join(weights, "b").select("a", "at_id", "at_key", goes).groupBy("a", "at_id", "at_key").agg(F.collect_list("to").alias("to"))
    wanted = staged(wanted, "wanted")
    texts, held = _with_texts(docs, wanted)
    sent = texts.select("a", "text", F.explode("to").alias("to")).select("a", "to.*", "text")

    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        for rows in _runs(table, "b"):
            ids, centre, sets = rows.column("a").to_numpy(), rows.column("b")[0].as_py(), _sets(rows.column("text"), k)
            middle = sets[int(np.flatnonzero(ids == centre)[0])]
            linked = [i for i, s in zip(ids, sets, strict=True) if i != centre and similar(middle, s, percent)]
            a += linked
            b += [centre] * len(linked)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    found = staged(sent.groupBy("bin", "part").applyInArrow(run, NODE).distinct(), "links")
    held.destroy()
    discard(roles, weights, wanted)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for nodes of ``edges``
    (a, b).  Large-star and small-star in turn, each an aggregate with partial
    minima and a join; no neighbourhood is gathered."""
    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(lowest, "a")
        if small:   # a > b: both hang below the smallest neighbour of a
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        else:       # larger neighbours of a hang below the smallest
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen, before = mark, now
        now = staged(star(star(now, False), True), "edges")
        discard(before)


def _shared(reg: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the other registers have a band in common with ``reg``."""
    same = others[:, :BANDS * ROWS] == reg[:BANDS * ROWS]
    return same.reshape(len(others), BANDS, ROWS).all(axis=2).any(axis=1)


def _mark(n, reg, own, to_n, to_reg, to_own, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Members (of one side, of the other) with a likely partner in another
    component on the other side."""
    left, right = np.zeros(len(n), bool), np.zeros(len(to_n), bool)

    def hits(r: int, c: np.ndarray) -> np.ndarray:
        return c[likely(np.repeat(reg[r][None], len(c), 0), to_reg[c], np.repeat(n[r], len(c)), to_n[c], percent)] if len(c) else c
    for r in range(len(n)):
        c = np.flatnonzero((to_own != own[r]) & (100 * np.minimum(n[r], to_n) >= percent * np.maximum(n[r], to_n)))
        c = c[_shared(reg[r], to_reg[c])]
        new = hits(r, c[~right[c]])
        left[r] = len(new) > 0
        c = c[right[c]]
        right[new] = True
        for s in range(0, len(c), TOGETHER):          # marked already: one hit is enough
            if left[r]:
                break
            left[r] = len(hits(r, c[s:s + TOGETHER])) > 0
    return left, right


def _linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a are similar enough to which of b, by exact counts of
    common shingles: a product of membership matrices, some shingles at a time."""
    n, m = (np.array([len(x) for x in side]) for side in (a, b))
    (u, row), (v, col) = ((np.concatenate(side), np.repeat(np.arange(len(side)), size)) for side, size in ((a, n), (b, m)))
    both = np.intersect1d(u, v)
    places = [np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0)) for x in (u, v)]
    known = [both[p] == x if len(both) else np.zeros(len(x), bool) for p, x in zip(places, (u, v), strict=True)]
    (u, row), (v, col) = ((p[k], r[k]) for p, k, r in zip(places, known, (row, col), strict=True))
    common = np.zeros((len(a), len(b)), np.float32)             # exact below 2**24 shingles
    by_u, by_v = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    u, row, v, col = u[by_u], row[by_u], v[by_v], col[by_v]
    for s in range(0, len(both), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        i, j = (slice(*np.searchsorted(w, [s, s + COLUMNS])) for w in (u, v))
        x[row[i], u[i] - s], y[col[j], v[j] - s] = 1, 1
        common += x @ y.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (n[:, None] + m[None, :] - common)


def _open_members(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """cid of the members of ``rows`` (cid, family, component, largest, size)
    with a likely partner in another component of their family."""
    full = rows.join(classes.select("cid", "n_shingles", "registers"), "cid")
    full = full.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    entry = F.collect_list(F.struct("cid", "component", "n_shingles", "registers"))
    everyone = full.groupBy("family", "block").agg(entry.alias("all"))                 # about BLOCK members
    others = full.where("component <> largest").groupBy("family", "blocks", F.col("block").alias("part")).agg(entry.alias("others"))
    sent = others.select("family", "others", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def unpack(column):
        x = column.flatten()
        return [x.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)] + [_matrix(x.field(3), np.uint16, M)]

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                ids, own, n, reg = unpack(batch.column("others").slice(i, 1))
                to_ids, to_own, to_n, to_reg = unpack(batch.column("all").slice(i, 1))
                left, right = _mark(n, reg, own, to_n, to_reg, to_own, percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[left], to_ids[right]]))], names=["cid"])
    return sent.join(everyone, ["family", "block"]).select("others", "all").mapInArrow(run, "cid long").distinct()


def _unfinished(docs: DataFrame, members: DataFrame, classes: DataFrame, comp: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links (a, b) that are left in buckets with several components; None if
    there is no such bucket.  Unfinished buckets that share members form a
    family; one link for each two components is enough."""
    named = comp.select(F.col("node").alias("cid"), "component")
    m = members.where("size > 2").join(named, "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("component"))
    unfinished = staged(m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("cid").alias("low")).where("lo <> hi").select("key", "low"), "unfinished")
    edges = staged(m.join(unfinished, "key").where("cid <> low").select(F.col("cid").alias("a"), F.col("low").alias("b")).distinct(), "unfinished")
    if edges.isEmpty():
        return None
    family = components(edges).select(F.col("node").alias("cid"), F.col("component").alias("family"))
    rows = staged(family.join(named, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "family")
    sizes = rows.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.sum("c").alias("size"), F.max_by("component", F.struct("c", "component")).alias("largest"))
    rows = rows.join(staged(sizes, "families"), "family")
    still = staged(_open_members(rows, classes, percent), "open")
    if still.isEmpty():
        return None
    left = staged(rows.join(still, "cid").join(classes.select("cid", "n_shingles", "at_id", "at_key"), "cid"), "left")
    parts = F.greatest(F.ceil(F.sum("n_shingles") / PART), F.ceil(F.count(F.lit(1)) / BLOCK))
    weights = staged(left.groupBy("family").agg(parts.cast("long").alias("parts"), F.sum("n_shingles").alias("weight")), "weights")
    bins = max(1, -(-(weights.where("parts = 1").agg(F.sum("weight")).first()[0] or 0) // PART))
    # a member of part x meets, as one of all, the others of every part o in (o, x), and as one of the others every part in (x, o)
    x, every = F.pmod(F.xxhash64("cid"), F.col("parts")), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    meets = F.transform(every, lambda o: F.struct(o.alias("o"), x.alias("x")))
    meets = F.when(F.col("component") == F.col("largest"), meets).otherwise(F.array_distinct(F.concat(meets, F.transform(every, lambda o: F.struct(x.alias("o"), o.alias("x"))))))
    bin_ = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("family"), F.lit(bins))).otherwise(F.xxhash64("family"))
    placed = left.join(weights, "family").select("cid", "family", "component", "at_id", "at_key", (F.col("component") != F.col("largest")).alias("other"), x.alias("own"), bin_.alias("bin"), meets.alias("meets"))
    placed = staged(placed, "placed")
    texts, held = _with_texts(docs, placed)
    sent = texts.withColumn("meet", F.explode("meets")).drop("meets")

    def run(table: pa.Table) -> pa.Table:
        links = []
        for rows in _runs(table, "family"):
            ids, own, part = (rows.column(c).to_numpy() for c in ("cid", "component", "own"))
            sets = _sets(rows.column("text"), k)
            others = np.flatnonzero(rows.column("other").to_numpy(zero_copy_only=False) & (part == rows.column("o")[0].as_py()))
            everyone = np.flatnonzero(part == rows.column("q")[0].as_py())
            if not len(others) or not len(everyone):
                continue
            found = _linked([sets[i] for i in others], [sets[i] for i in everyone], percent) & (own[others][:, None] != own[everyone][None, :])
            r, c = np.nonzero(found)
            r, c = others[r], everyone[c]
            _, one = np.unique(np.stack([np.minimum(own[r], own[c]), np.maximum(own[r], own[c])]), axis=1, return_index=True)
            links += zip(ids[r[one]].tolist(), ids[c[one]].tolist(), strict=True)     # one link joins two components
        return pa.table({"a": pa.array([v[0] for v in links], pa.int64()), "b": pa.array([v[1] for v in links], pa.int64())})
    sent = sent.select("cid", "family", "component", "other", "own", "bin", F.col("meet.o").alias("o"), F.col("meet.x").alias("q"), "text")
    found = staged(sent.groupBy("bin", "o", "q").applyInArrow(run, NODE), "links")
    held.destroy()
    discard(edges, unfinished, still, left, weights, placed)
    return found


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) for every row of ``docs``
    (doc_id, text; further columns are ignored).

    Words are runs of anything but ASCII white space, A-Z in lower case.  Texts
    that are null, empty or without words have size 0 and are linked with
    nothing.  Rows without doc_id follow their component and are kept only if
    none of it has one.  Rows that share a doc_id but not the text are documents
    of their own; repeated rows give repeated result rows; an empty table gives
    an empty result."""
    base = staged(sketch(docs, k).withColumn("row", F.monotonically_increasing_id()), "sketch")
    place = F.min(F.struct("row", "doc_id", "key"))
    classes = base.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(place.alias("at"), F.min("doc_id").alias("least"), F.first("registers").alias("registers"))
    classes = staged(classes.select("d1", "d2", "n_shingles", "least", "registers", F.col("at.row").alias("cid"), F.col("at.doc_id").alias("at_id"), F.col("at.key").alias("at_key")), "classes")
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)]))
    bands = classes.select("cid", band.alias("key"))
    # tables of keys are written before they are joined, so that a join on a hot key can be split
    sizes = staged(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = staged(bands.join(sizes, "key"), "members")
    degree = members.groupBy("cid").agg(F.sum("size").alias("degree"))
    centre = staged(members.join(degree, "cid").groupBy("key").agg(F.max(F.struct("degree", -F.col("cid"))).alias("best")).select("key", (-F.col("best.col2")).alias("b")), "centres")
    pairs = members.select(F.col("cid").alias("a"), "key").join(centre, "key").where("a <> b").select("a", "b").distinct()
    pairs = staged(_likely_pairs(pairs, classes, percent), "pairs")
    found = _links(docs, pairs, classes, k, percent)
    comp = staged(components(found), "components")
    late = _unfinished(docs, members, classes, comp, k, percent)
    if late is not None:
        comp = staged(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late)), "components")
    discard(sizes, members, centre, pairs, found)
    placed = classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("d1", "d2", "n_shingles", "least", F.coalesce("component", "cid").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("d1", "d2", "n_shingles", "component_id")
    some = base.where("n_shingles > 0").select("doc_id", "key", "d1", "d2", "n_shingles").join(named, ["d1", "d2", "n_shingles"]).select("doc_id", "key", "n_shingles", "component_id")
    none = base.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
