"""Benchmark decontamination by latent semantic retrieval.

1. Terms are hashed words of the benchmark's passages; their inverse passage
   frequency is counted over all passages of all documents.
2. A randomised SVD of the benchmark's TF-IDF passages (range finder with
   power steps; every product with the matrix is a Spark job over its rows)
   gives the latent space.
3. Cosine search: passages are told apart by length; every document is read in
   overlapping windows of the same length, and a window is a candidate for each
   passage of at least the cosine ``COSINE`` in the latent space of which it
   holds at least ``HELD`` (the window's projection on the passage, as a share of
   the passage's length).
4. Latent vectors of few dimensions can miss a hit, so a second, exact source is
   united with them: places that hold so many of a passage's rarest words that
   the check below could still succeed.  No place that would pass the check is
   left out, whatever the passage's length or the number of passages.
5. Candidates are checked on their words: the longest common subsequence with
   the passage must cover ``COPY`` of it, or ``PARAPHRASE`` of it while the
   answer (the passage's last sentence) is there as well.  Of the windows that
   pass, the one with the largest cover counts, then that with the largest
   cosine in the latent space.
6. Items of fewer than ``SHORTEST`` words are leaked by documents that have just
   the same words (a join); inside a longer text so few words say nothing.

The benchmark is searched for in slices of at most ``SLICE`` passages, so what
a task holds is bounded; documents are read whole, and only hits leave a task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.llm import words as W
from linesight.llm.common import row_key, staged

FEATURES = 2**16
RANK = 64
STEPS = 2              # power steps of the range finder
HOP = 16               # words between windows; a window has two hops
PASSAGE = 48           # longer benchmark items are cut into passages of so many words
COMMON = 0.02          # terms in a larger share of passages are left out of the latent space,
RAREST = 8             # but not a passage's rarest ones
COPY = 0.75
PARAPHRASE = 0.6
ANSWER = 0.8
ANSWER_WORDS = 5       # the answer has at least so many words
SLICE = 20_000
SHORTEST = 5           # items of fewer words are compared with whole documents only
SCALES = (8, 12, 16, 24, 32, 48)   # words of the windows of the cosine search; a passage meets the next ones up
COSINE = 0.55
HELD = 0.4
PRODUCTS_AT_ONCE = 4_000_000
SOURCES = ("cosine", "signature")
LOOKED_UP = 0.06       # microseconds to look up a word in a passage's signature
CHECKED = 15.0         # and to check a candidate on its words
LOOKED_UP_AT_ONCE = 2_000_000
TOGETHER = 8           # windows that are first checked as one


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(24)).astype(np.int64) & (FEATURES - 1)


def _hashed(text: str) -> np.ndarray:
    data, offsets = W.text_buffer(pa.array([text]))
    return W.find_words(data, offsets, W.ALNUM).hashes


def passages(item_id, text: str) -> list[tuple]:
    """(item_id, word hashes, answer's word hashes) of an item's passages."""
    words = _hashed(text)
    sentences = [h for s in re.split(r"[.!?\n]+", text) if len(h := _hashed(s))]
    out = []
    cuts = max(1, -(-len(words) // PASSAGE))
    for part in np.array_split(words, cuts):
        if len(part) >= SHORTEST:
            answer, left = part[:0], len(sentences)
            while cuts == 1 and len(answer) < ANSWER_WORDS and left:
                left -= 1
                answer = np.concatenate([sentences[left], answer])
            out.append((item_id, part, answer if len(answer) >= ANSWER_WORDS else part[-ANSWER_WORDS:]))
    return out


def passage_frequency(docs: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """Passages (of two hops) that hold each feature, and all passages, over all
    documents; ``wanted`` are the features to count."""
    def run(it):
        count, total = np.zeros(FEATURES + 1, np.int64), 0
        for batch in it:
            for _, words in W.batches(batch.column(0), W.ALNUM):
                at = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
                per_row = -(-words.counts // (2 * HOP))
                passage = np.repeat(np.cumsum(per_row) - per_row, words.counts) + at // (2 * HOP)
                total += int(per_row.sum())
                f = _features(words.hashes)
                ok = wanted[f]
                pairs = np.sort(passage[ok] * FEATURES + f[ok])
                pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
                count[:-1] += np.bincount(pairs & (FEATURES - 1), minlength=FEATURES)
        count[FEATURES] = total
        f = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(count[f])], names=["feature", "c"])
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "feature long, c long").groupBy("feature").agg(F.sum("c").alias("c")).toArrow()   # FEATURES rows at most
    out = np.zeros(FEATURES + 1, np.int64)
    out[found.column("feature").to_numpy()] = found.column("c").to_numpy()
    return out[:-1], int(out[-1])


def _weights(items: list[tuple], df: np.ndarray, n: int) -> np.ndarray:
    """Inverse passage frequency of the features searched for, 0 for others."""
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    keep = np.zeros(FEATURES, bool)
    for _, words, _ in items:
        f = np.unique(_features(words))
        keep[f[df[f] <= COMMON * n]] = True
        keep[f[np.argsort(df[f], kind="stable")[:RAREST]]] = True
    return np.where(keep, idf, 0.0)


def latent_space(rows: DataFrame, weight: np.ndarray, rank: int = RANK, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Used features and their latent vectors (right singular vectors of the
    TF-IDF matrix whose rows are ``rows``' word hashes, column ``words``)."""
    used = np.flatnonzero(weight)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    rank = max(1, min(rank, len(used)))
    basis = np.linalg.qr(np.random.default_rng(7).normal(size=(len(used), rank)))[0]
    for _ in range(steps + 1):
        shared = rows.sparkSession.sparkContext.broadcast((place, weight, basis))

        def run(it, shared=shared):
            place, weight, basis = shared.value
            total = np.zeros_like(basis)
            for batch in it:
                for h in batch.column(0).to_pylist():
                    f = _features(np.array(h, np.int64).view(np.uint64))
                    f, tf = np.unique(f[place[f] >= 0], return_counts=True)
                    x = tf * weight[f]
                    x = x / max(1e-12, np.linalg.norm(x))
                    total[place[f]] += np.outer(x, x @ basis[place[f]])   # a^T (a Q), row by row
            r = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r, total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), len(r))), pa.array(total[r].ravel())], names=["f", "j", "x"])
        z = rows.select("words").mapInArrow(run, "f long, j long, x double").groupBy("f", "j").agg(F.sum("x").alias("x")).toArrow()   # FEATURES * RANK values at most
        product = np.zeros((len(used), rank))
        product[z.column("f").to_numpy(), z.column("j").to_numpy()] = z.column("x").to_numpy()
        gram, last = basis.T @ product, basis
        basis = np.linalg.qr(product)[0]
        shared.unpersist()
    value, turn = np.linalg.eigh((gram + gram.T) / 2)   # squared singular values
    good = value > 1e-9 * max(value.max(), 1e-300)
    return used, last @ turn[:, good]


def _group_sums(vector: np.ndarray, f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``vector[f]`` over the groups that begin at ``starts``: the first
    members of all groups, then the second ones, and so on (a group has a few; many
    times as fast as ``np.add.reduceat`` along the rows)."""
    many = np.diff(np.append(starts, len(f)))
    order = np.argsort(-many, kind="stable")
    begin, many = starts[order], -many[order]
    out = np.empty((len(starts), vector.shape[1]), vector.dtype)
    total = vector[f[begin]]
    for k in range(1, -int(many[0]) if len(many) else 0):
        n = int(np.searchsorted(many, -k))
        total[:n] += vector[f[begin[:n] + k]]
    out[order] = total
    return out


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence: bit-parallel, one bit a passage word."""
    full = (1 << n) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _least(share: float, n: int) -> int:
    """Fewest words of n that are ``share`` of them."""
    return next(c for c in range(n + 1) if c / n >= share)


def _needed(length: int, answer: int) -> int:
    """Fewest words that a hit has in common with its passage.  The answer is a
    part of the passage, so its words count for both."""
    return min(_least(COPY, length), max(_least(PARAPHRASE, length), next(c for c in range(answer + 1) if c >= ANSWER * answer)))


def signatures(items: list[tuple], df: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words by which each passage is looked up, and how many of their places
    every hit holds.

    A hit misses at most ``length - _needed`` words of its passage, so of any p
    words it holds p less that many: whatever words are taken, no hit is lost.
    They are the rarest ones, as many as cost the least by expectation."""
    rate = -np.log1p(-np.minimum(df / (n + 1), 0.999)) / (2 * HOP)   # of a feature, a word of text
    chosen, need = [], np.zeros(len(items), np.int64)
    for i, (_, words, answer) in enumerate(items):
        length = len(words)
        order = words[np.argsort(rate[_features(words)], kind="stable")]
        many = np.arange(1, _needed(length, len(answer)) + 1)        # places a hit holds
        first = length - len(many)
        total = np.cumsum(rate[_features(order)])[first:]
        near = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, len(many)))]))   # log (many - 1)!
        meet = np.exp(np.minimum((many - 1) * np.log(np.maximum(total * (2 * HOP + 2 * length), 1e-12)) - near, 50.0))
        best = int(np.argmin(total * (LOOKED_UP + CHECKED * np.minimum(meet, 1.0))))
        chosen.append(np.unique(order[:first + best + 1]))
        need[i] = best + 1
    return chosen, need


def passages_by_scale(items: list[tuple], place: np.ndarray, vector: np.ndarray) -> list[tuple]:
    """(words of a window, passages, their unit latent vectors and lengths) of
    every scale that has passages."""
    length = np.array([len(h) for _, h, _ in items])
    scale_of = np.searchsorted(SCALES, length)
    out = []
    for k, scale in enumerate(SCALES):
        own = np.flatnonzero(scale_of == k)
        if len(own):
            latent = np.stack([vector[f[f >= 0]].sum(axis=0) for f in (place[_features(items[i][1])] for i in own)])
            norm = np.sqrt(np.einsum("ij,ij->i", latent, latent))
            ok = norm > 0
            if ok.any():
                out.append((scale, own[ok], np.ascontiguousarray(latent[ok] / norm[ok, None]), norm[ok]))
    return out


def same_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hits of items of fewer than ``SHORTEST`` words: documents that have the
    same words and no others."""
    apart, word = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    few = f"^{apart}*+(?:{word}++{apart}*+){{1,{SHORTEST - 1}}}$"
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    brief = lambda df: df.where(F.col("text").rlike(few)).withColumn("words", F.split(F.btrim(F.regexp_replace(lower, f"{apart}+", " ")), " "))
    pairs = brief(docs).join(brief(items).select("item_id", "words").distinct(), "words")
    last = (F.size("words") - 1).cast("long")
    return pairs.select("doc_id", "key", "item_id", F.lit(0).cast("long").alias("first_word"), last.alias("last_word"), F.lit(1.0).alias("cosine"), F.lit(1.0).alias("covered"), F.lit(True).alias("answer"))


def search(docs: DataFrame, items: list[tuple], df: np.ndarray, n: int, used: np.ndarray, vector: np.ndarray, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(doc_id, key, item_id, first_word, last_word, cosine, covered, answer) of
    the verified hits; ``docs`` has doc_id, key and text, ``vector`` the weighted
    latent vectors of the features ``used``, ``sources`` where candidates come
    from (one alone: to measure it)."""
    place = np.full(FEATURES, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    chosen, need = signatures(items, df, n)
    vocabulary, word = np.unique(np.concatenate(chosen), return_inverse=True)
    owner = np.repeat(np.arange(len(items)), [len(c) for c in chosen])[np.argsort(word, kind="stable")].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(vocabulary)))])
    known = np.zeros(FEATURES, bool)
    known[_features(vocabulary)] = True
    vector = vector.astype(np.float32)
    scales = passages_by_scale(items, place, vector)
    shared = docs.sparkSession.sparkContext.broadcast((place, vector, items, need, vocabulary, owner, starts, known, scales))   # SLICE passages and FEATURES vectors at most

    def run(it):
        place, vector, items, need, vocabulary, owner, starts, known, scales = shared.value
        length = np.array([len(h) for _, h, _ in items])
        span = 2 * HOP + 2 * length
        widest = int(span.max())
        masks: dict[int, tuple] = {}

        def pull(hashes: np.ndarray) -> np.ndarray:
            f = place[_features(hashes)]
            return vector[f[f >= 0]].sum(axis=0)

        def verify(i: int, part: list[int]) -> tuple[float, bool] | None:
            if i not in masks:
                masks[i] = _masks(items[i][1]), _masks(items[i][2])
            share = common_length(masks[i][0], int(length[i]), part) / int(length[i])
            if share < PARAPHRASE:
                return None
            answered = common_length(masks[i][1], len(items[i][2]), part) >= ANSWER * len(items[i][2])
            return (share, answered) if share >= COPY or answered else None

        def alike(words: W.Words):
            """Passages, rows, first and last windows by cosine in the latent space."""
            f = place[_features(words.hashes)]
            at = np.flatnonzero(f >= 0)
            f, row = f[at], np.searchsorted(words.first, at, side="right") - 1
            for scale, own, unit, norm in scales:
                hop = scale // 4
                begin = np.concatenate([[0], np.cumsum(-(-words.counts // hop) + 3)])   # three empty hops end a row
                group = begin[row] + (at - words.first[row]) // hop
                step = max(64, PRODUCTS_AT_ONCE // max(len(own), vector.shape[1]))
                for lo in range(0, int(begin[-1]), step):
                    a, b = np.searchsorted(group, [lo, lo + step + 3])
                    if a == b:
                        continue
                    edge = np.flatnonzero(np.diff(group[a:b], prepend=-1))
                    hops = np.zeros((step + 3, vector.shape[1]), np.float32)
                    hops[group[a:b][edge] - lo] = _group_sums(vector, f[a:b], edge)
                    window = hops[:-3] + hops[1:-2] + hops[2:-1] + hops[3:]
                    size = np.sqrt(np.einsum("ij,ij->i", window, window))
                    some = np.flatnonzero(size >= HELD * norm.min())   # no other one holds enough of any passage
                    if not len(some):
                        continue
                    dot = window[some] @ unit.T
                    w, p = np.nonzero(dot >= HELD * norm)
                    ok = dot[w, p] >= COSINE * size[some[w]]
                    w, p = lo + some[w[ok]], p[ok]
                    r = np.searchsorted(begin, w, side="right") - 1
                    start = (w - begin[r]) * hop
                    ok = start < words.counts[r]
                    yield own[p[ok]], r[ok], start[ok] // HOP, start[ok] // HOP

        def rare(words: W.Words):
            """Passages, rows, first and last windows where a passage's hits may lie,
            by its signature."""
            at = np.flatnonzero(known[_features(words.hashes)])
            v = np.minimum(np.searchsorted(vocabulary, words.hashes[at]), len(vocabulary) - 1)
            ok = vocabulary[v] == words.hashes[at]
            at, v = at[ok], v[ok]
            many = starts[v + 1] - starts[v]
            total = np.concatenate([[0], np.cumsum(many)])
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + LOOKED_UP_AT_ONCE, side="right")) - 1)
                back = int(np.searchsorted(at, at[lo] - widest))   # words that may belong to this part's
                m = many[back:hi]
                item = owner[np.repeat(starts[v[back:hi]] - (total[back:hi] - total[back]), m) + np.arange(total[hi] - total[back])]
                both = np.sort(item.astype(np.int64) << 40 | np.repeat(at[back:hi], m))
                item, spot = both >> 40, both & ((1 << 40) - 1)
                last = np.arange(len(both)) + need[item] - 1
                first = np.flatnonzero(last < len(both))
                last = last[first]
                ok = (item[first] == item[last]) & (spot[last] - spot[first] < span[item[first]])
                first, last = first[ok], last[ok]
                row = np.searchsorted(words.first, spot[first], side="right") - 1
                ok = spot[last] < words.first[row + 1]
                item, row, begin, end = item[first[ok]], row[ok], spot[first[ok]], spot[last[ok]]
                begin, end = begin - words.first[row], end - words.first[row]
                low = np.maximum(0, -((2 * HOP + length[item] - 1 - end) // HOP))
                high = np.minimum(begin + length[item], words.counts[row] - 1) // HOP
                ok = low <= high
                yield item[ok], row[ok], low[ok], high[ok]
                lo = hi

        def places(words: W.Words):
            """(passage, row, first and last window) of all candidates, neighbours together."""
            parts = [p for name, source in (("cosine", alike), ("signature", rare)) if name in sources for p in source(words)]
            if not parts:
                return
            every = np.unique(np.stack([np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)], axis=1), axis=0)
            open_ = None
            for i, r, a, b in every.tolist():
                if open_ and open_[:2] == (i, r) and a <= open_[3] + 1 and b - open_[2] < TOGETHER:
                    open_ = (i, r, open_[2], max(b, open_[3]))
                    continue
                if open_:
                    yield open_
                open_ = (i, r, a, b)
            if open_:
                yield open_

        for batch in it:
            hits: list[tuple] = []
            for rows, words in W.batches(batch.column(2), W.ALNUM):
                if not len(words.hashes):
                    continue
                listed, found = None, {}
                for i, r, low, high in places(words):
                    listed = words.hashes.tolist() if listed is None else listed
                    base, count, n = int(words.first[r]), int(words.counts[r]), int(length[i])
                    part = lambda a, b: listed[base + max(0, a * HOP - n):base + min(count, (b + 2) * HOP + n)]  # noqa: E731, B023
                    if verify(i, part(low, high)) is None:   # no window holds more than all of them
                        continue
                    for w in range(low, high + 1):
                        if seen := verify(i, part(w, w)):
                            x, y = pull(words.hashes[base + w * HOP:base + min(count, (w + 2) * HOP)]), pull(items[i][1])
                            cosine = float(x @ y / max(1e-12, float(np.linalg.norm(x) * np.linalg.norm(y))))
                            found[r, i] = max(found.get((r, i), (-1.0,)), (seen[0], cosine, -w, seen[1]))
                for (r, i), (share, cosine, w, answered) in found.items():
                    lo, n = max(0, -w * HOP - int(length[i])), int(words.counts[r])
                    base = int(words.first[r])
                    own = [p for p, h in enumerate(listed[base + lo:base + min(n, (2 - w) * HOP + int(length[i]))]) if h in masks[i][0]]
                    hits.append((*(batch.column(c)[rows.start + r].as_py() for c in (0, 1)), items[i][0], lo + own[0], lo + own[-1], cosine, share, answered))
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True) if hits else [[]] * 8, kinds, strict=True)], names=["doc_id", "key", "item_id", "first_word", "last_word", "cosine", "covered", "answer"])
    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, item_id long, first_word long, last_word long, cosine double, covered double, answer boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, slice_items: int = SLICE) -> DataFrame:
    """One row for each document and benchmark item that it leaks: doc_id, key
    (hash of the text), item_id, first_word, last_word (about where), cosine,
    covered (share of the passage), answer.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; further columns
    are ignored.  Null and empty texts leak nothing; items without id or word are
    not searched for.  Repeated documents and repeated items give one row; empty
    tables give none."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), row_key("text").alias("key"), F.col("text").cast("string"))
    wanted_items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    slices = max(1, -(-wanted_items.count() // slice_items))
    found = same_words(rows, wanted_items)
    for part in range(slices):
        chosen = wanted_items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).orderBy("item_id", "text").collect()   # about slice_items rows
        items = [p for r in chosen for p in passages(r.item_id, r.text)]
        if not items:
            continue
        wanted = np.zeros(FEATURES, bool)
        for _, h, _ in items:
            wanted[_features(h)] = True
        df, n = passage_frequency(docs, wanted)
        weight = _weights(items, df, max(n, 1))
        matrix = spark.createDataFrame([(h.view(np.int64).tolist(),) for _, h, _ in items], "words array<long>")
        used, space = latent_space(matrix, weight)
        found = found.union(search(rows, items, df, max(n, 1), used, space * weight[used, None]))
    best = F.max(F.struct("covered", "cosine", "first_word", "last_word", "answer")).alias("best")
    return staged(found.groupBy("doc_id", "key", "item_id").agg(best).select("doc_id", "key", "item_id", "best.first_word", "best.last_word", "best.cosine", "best.covered", "best.answer"), "leaks")
