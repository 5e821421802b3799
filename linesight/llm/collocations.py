"""Collocations by SON partitioning.

A phrase is a run of words within a piece (text between punctuation marks or
line ends); everything is counted by language.  The documents are dealt into
``SHARDS`` shards by a hash of their content.  A phrase that stands ``support``
times in all stands at least ``(support - 1) // SHARDS + 1`` times in one shard
at least, so:

1. Each shard is mined completely at that lowered support, level by level: a
   run of k words can only be frequent where both its runs of k - 1 words are.
2. The candidates are the union of the locally frequent phrases, but for those
   that cannot reach the support: where a phrase is not locally frequent it
   stands less often than the lowered support, so what it has at most in all is
   known.  No phrase with the support is lost.
3. A shard's counts are exact wherever both shorter runs were frequent in it.
   One more pass counts the candidates' other places alone, fewer than the
   lowered support for a candidate and shard; the two sums together are the
   number of occurrences.
4. Each phrase with the support is written once, from one text it stands in:
   the counts carry 32 bits of the hash of such a text.  Copies of the text and
   texts that share these bits cost work only.

Phrases are counted by 88 bits of two independent hashes, 56 of one and 32 of
the other.

What a pass has to know of the level before is a bitmap of fixed size
(``BITMAP_BITS``), built by an aggregate.  It lets every locally frequent
candidate through; the few others that share its bits are counted too and fall
at the test of the exact count.  A bitmap filled by a huge vocabulary therefore
costs work, never a phrase.  The support is an absolute number, so the number
of shards does not grow with the data; a shard is counted by as many tasks as
it has input, with sums shuffled by phrase.

Scores, containment and ranks are joins and aggregates over the frequent
phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesight.llm import bitmap
from linesight.llm import words as W
from linesight.llm.common import discard, staged

SUPPORT = 30
SHARDS = 8              # at most 256
LONGEST = 4
TOP = 2000
COVERED = 80            # a phrase goes when a longer one holds so many per cent of its places
SCALE = 2_000_000
BITMAP_BITS = bitmap.BITS
HELD = 1 << 21          # places a task holds before it passes their counts on
PARTS = 64              # parts of a language ranked by themselves first
CHUNK_WORDS = 1 << 17   # words of a text whose phrases are written out at a time

#: characters that end a piece: . , ; : ! ? and the line ends 0A to 0D
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
#: word characters by byte: everything but those, space and tab
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
#: random numbers by a byte's place in its word (modulo 64) and its value
_SHAPE = np.random.default_rng(20120712).integers(0, 2**64, (64, 256), dtype=np.uint64)


def _pieces(words: W.Words) -> np.ndarray:
    """A number for each word that two words share only in the same piece."""
    ends = np.flatnonzero(ENDS[words.data])
    return np.searchsorted(ends, words.starts) + words.row_of_word()


def _runs(piece: np.ndarray, k: int) -> np.ndarray:
    """Whether a run of k words within a piece begins at each word."""
    ok = np.zeros(len(piece), bool)
    if len(piece) >= k:
        ok[:len(piece) - k + 1] = piece[k - 1:] == piece[:len(piece) - k + 1]
    return ok


def _keys(words: W.Words, row_lang: np.ndarray, k: int) -> np.ndarray:
    """Keys of the runs of k words beginning at each word, by language; the low byte is left free."""
    key = np.zeros(len(words.hashes), np.uint64)
    g = W.grams(words.hashes, k)
    key[:len(g)] = W.mix(g ^ row_lang[:len(g)])
    return key & ~np.uint64(255)


def _lang_hash(langs: pa.Array) -> np.ndarray:
    """Hash of each row's language."""
    names = langs.dictionary_encode()
    own = np.array([W.hash_name(x) for x in names.dictionary.to_pylist()], np.uint64)
    return own[names.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)


def _shapes(words: W.Words) -> np.ndarray:
    """A second hash of each word: a sum of random numbers, one for each byte and its place."""
    out = np.empty(len(words.starts), np.uint64)
    at = 0
    while at < len(out):
        lo = words.starts[at]
        to = max(at + 1, int(np.searchsorted(words.ends, lo + W.SEGMENT_BYTES, side="right")))
        s, e = words.starts[at:to] - lo, words.ends[at:to] - lo
        place = np.arange(e[-1]) - np.repeat(s, np.diff(np.append(s, e[-1])))
        total = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum(_SHAPE[place & (len(_SHAPE) - 1), words.data[lo:lo + e[-1]]], out=total[1:])
        out[at:to] = W.mix(total[e] - total[s] + (e - s).astype(np.uint64))
        at = to
    return out


def _others(shapes: np.ndarray, k: int) -> np.ndarray:
    """32 bits of a second hash of the runs of k words beginning at each word."""
    other = np.zeros(len(shapes), np.uint64)
    g = W.grams(shapes, k)
    other[:len(g)] = g >> np.uint64(32)
    return other


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of places and where in it each group of equal keys begins.
    Places are sorted by the first key only; a group met twice is merged later."""
    order = np.argsort(keys[0])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[order[1:]] != key[order[:-1]]
    return order, np.flatnonzero(change)


def _summed(held: list[tuple[np.ndarray, ...]]) -> dict[str, pa.Array]:
    """Phrases, marks (second hash and shard), smallest documents and counts of
    held places: keys (phrase and shard), second hashes and documents."""
    key, other, doc = (np.concatenate(x) for x in zip(*held, strict=True))
    order, first = _groups(key, other)
    least = np.minimum.reduceat(doc[order], first) if len(first) else doc
    key, other = key[order[first]], other[order[first]]
    mark = other << np.uint64(8) | key & np.uint64(255)
    return {"phrase": pa.array((key & ~np.uint64(255)).view(np.int64)), "mark": pa.array(mark.view(np.int64)), "doc": pa.array(least), "c": pa.array(np.diff(np.append(first, len(order))))}


def _document() -> Column:
    """32 bits of the hash of a row's language and text."""
    return F.shiftright(F.xxhash64("lang", "text"), 32).cast("int").alias("doc")


def _counted(known: np.ndarray, words: W.Words, of_lang: np.ndarray, of_shard: np.ndarray, piece: np.ndarray, k: int) -> np.ndarray:
    """Whether both runs of k - 1 words of the run of k beginning at each word are in the shard's bitmap."""
    part = np.append(bitmap.known(known, _keys(words, of_lang, k - 1) | of_shard) & _runs(piece, k - 1), False)
    return part[:-1] & part[1:]


def local_phrases(texts: DataFrame, k: int, least: int, known=None) -> DataFrame:
    """The runs of k words with ``least`` occurrences in their shard: phrase and
    other (hashes), key (phrase and shard), doc (a document holding it) and
    counts c.  ``known``: broadcast bitmap of the level before."""
    def run(it):
        held, size = [], 0
        for batch in it:
            lang, shard = _lang_hash(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            doc = batch.column(3).to_numpy(zero_copy_only=False)
            for rows, words in W.batches(batch.column(2), WORD):
                row = words.row_of_word()
                of_lang, of_shard, piece = lang[rows][row], shard[rows][row], _pieces(words)
                ok = _runs(piece, k)
                if known is not None:
                    ok &= _counted(known.value, words, of_lang, of_shard, piece, k)
                held.append(((_keys(words, of_lang, k) | of_shard)[ok], _others(_shapes(words), k)[ok], doc[rows][row[ok]]))
                size += len(held[-1][0])
                if size >= HELD:
                    yield pa.RecordBatch.from_pydict(_summed(held))
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict(_summed(held))
    rows = texts.select("lang", "shard", "text", _document()).mapInArrow(run, "phrase long, mark long, doc int, c long")
    # dealt by phrase alone, so that the sums over its shards need no further exchange
    sums = rows.repartition("phrase").groupBy("phrase", "mark").agg(F.sum("c").alias("c"), F.min("doc").alias("doc")).where(F.col("c") >= least)
    return sums.select("phrase", F.shiftright("mark", 8).alias("other"), F.expr("phrase | (mark & 255)").alias("key"), "doc", "c")


def may_reach(local: DataFrame, support: int, shards: int, least: int) -> DataFrame:
    """The phrases that may have ``support`` occurrences, going by their counts
    of ``least`` and more, and ``least - 1`` for each other shard: key, other,
    the sum c of all their given counts, doc, and the shards with ``least`` as
    bits of in_0 (64 shards), in_1 and so on."""
    more = F.sum(F.when(F.col("c") >= least, F.col("c") - (least - 1))).alias("more")
    bits = [F.expr(f"bit_or(if(c >= {least} and (key & 192) = {64 * i}, shiftleft(1L, cast(key & 63 as int)), 0L))").alias(f"in_{i}") for i in range((shards + 63) // 64)]
    found = local.groupBy("phrase", "other").agg(F.sum("c").alias("c"), F.min("doc").alias("doc"), more, *bits)
    return found.where(F.col("more") >= support - shards * (least - 1)).drop("more").withColumnRenamed("phrase", "key")


def _bitmaps(found: DataFrame, shards: int) -> list[np.ndarray]:
    """Two bitmaps of candidates: by each shard they are locally frequent in, and whatever the shard."""
    keys = [f"transform(filter(sequence({i}, {min(i + 63, shards - 1)}), s -> shiftrightunsigned(in_{i // 64}, s - {i}) & 1 = 1), s -> key | s)" for i in range(0, shards, 64)]
    by_shard = found.select(F.explode(F.expr(f"concat({', '.join(keys)})")).alias("key"))
    return [bitmap.build(k, BITMAP_BITS) for k in (by_shard, found.select("key"))]


def _written(words: W.Words, starts: np.ndarray, k: int) -> pa.Array:
    """The runs of k words beginning at ``starts`` as strings, one space between words."""
    place = (starts[:, None] + np.arange(k)).ravel()
    n = words.ends[place] - words.starts[place] + 1            # with a space behind
    at = np.concatenate([[0], np.cumsum(n)])
    source = np.arange(at[-1]) + np.repeat(words.starts[place] - at[:-1], n)
    space = at[1:] - 1
    source[space] = 0
    data = words.data[source] if len(words.data) else np.zeros(0, np.uint8)
    data[space] = 0x20
    last = np.zeros(at[-1], bool)
    last[space[k - 1::k]] = True                               # but none behind the phrase
    bounds = at[::k] - np.arange(len(starts) + 1)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~last])))


def other_places(texts: DataFrame, by_shard: list, anywhere: list) -> DataFrame:
    """(lang, k, phrase, mark, doc, c): counts of the candidates' places that
    their shard did not count, by hashes and without lang; with k = 0 each
    language's number of words.  ``by_shard`` and ``anywhere``: broadcast
    bitmaps of the levels from 1 and from 2."""
    def run(it):
        held, size = {k: [] for k in range(2, len(by_shard) + 2)}, 0

        def told():
            for k, places in held.items():
                if places:
                    sums = _summed(places)
                    n = len(sums["c"])
                    yield pa.RecordBatch.from_pydict({"lang": pa.nulls(n, pa.string()), "k": pa.array(np.full(n, k, np.int32)), **sums})
                    places.clear()
        for batch in it:
            lang, shard = _lang_hash(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            doc = batch.column(3).to_numpy(zero_copy_only=False)
            names = batch.column(0).dictionary_encode()
            total = np.zeros(len(names.dictionary), np.int64)
            for rows, words in W.batches(batch.column(2), WORD):
                np.add.at(total, names.indices.to_numpy(zero_copy_only=False)[rows], words.counts)
                row, piece, shapes = words.row_of_word(), _pieces(words), _shapes(words)
                of_lang, of_shard = lang[rows][row], shard[rows][row]
                for k, (known, level) in enumerate(zip(by_shard, anywhere, strict=True), 2):
                    key = _keys(words, of_lang, k)
                    here = _runs(piece, k) & bitmap.known(level.value, key) & ~_counted(known.value, words, of_lang, of_shard, piece, k)
                    held[k].append((key[here], _others(shapes, k)[here], doc[rows][row[here]]))
                    size += len(held[k][-1][0])
                if size >= HELD:
                    yield from told()
                    size = 0
            none = np.zeros(len(total), np.int64)
            yield pa.RecordBatch.from_pydict({"lang": names.dictionary.cast(pa.string()), "k": pa.array(none.astype(np.int32)), "phrase": pa.array(none), "mark": pa.array(none), "doc": pa.array(none.astype(np.int32)), "c": pa.array(total)})
        yield from told()
    return texts.select("lang", "shard", "text", _document()).mapInArrow(run, "lang string, k int, phrase long, mark long, doc int, c long")


def written_phrases(texts: DataFrame, wanted: DataFrame, longest: int) -> DataFrame:
    """(lang, k, key, other, phrase) of the phrases ``wanted`` (key, doc), read
    from the texts of their documents, and by chance some more."""
    def run(it):
        for batch in it:
            lang, doc = _lang_hash(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = batch.column(3)
            of_row = np.repeat(doc, keys.value_lengths().to_numpy(zero_copy_only=False))
            sought = np.unique(W.mix(keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ W.mix(of_row)))
            for rows, words in W.batches(batch.column(2), WORD):
                row, piece, shapes = words.row_of_word(), _pieces(words), _shapes(words)
                of_lang, of_doc = lang[rows][row], W.mix(doc[rows])[row]
                for k in range(1, longest + 1):
                    key, other = _keys(words, of_lang, k), _others(shapes, k)
                    here = np.flatnonzero(_runs(piece, k) & np.isin(W.mix(key ^ of_doc), sought))
                    order, first = _groups(key[here], other[here])
                    at = here[order[first]]
                    for s in range(0, len(at), CHUNK_WORDS):
                        part = at[s:s + CHUNK_WORDS]
                        yield pa.RecordBatch.from_pydict({"lang": batch.column(0).take(pa.array(rows.start + row[part])), "k": pa.array(np.full(len(part), k, np.int32)), "key": pa.array(key[part].view(np.int64)), "other": pa.array(other[part].view(np.int64)), "phrase": _written(words, part, k).cast(pa.string())})
    docs = wanted.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    some = texts.sparkSession.sparkContext.broadcast(bitmap.build(wanted.select(F.col("doc").cast("long")), BITMAP_BITS))
    held = texts.select("lang", _document(), "text").where(bitmap.may_hold(some, F.col("doc").cast("long"))).distinct()
    return held.join(docs, "doc").select("lang", "doc", "text", "keys").mapInArrow(run, "lang string, k int, key long, other long, phrase string")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, longest: int = LONGEST) -> DataFrame:
    """(lang, k, phrase, c) of all phrases of 1 to ``longest`` words with
    ``support`` occurrences in their language, and with k = 0 its number of
    words.  ``docs``: text and lang; null languages are ``und``."""
    if not 1 <= shards <= 256 or support < 1:
        raise ValueError("support is at least 1, shards from 1 to 256")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = texts.select("lang", F.pmod(F.xxhash64("lang", "text"), F.lit(shards)).cast("int").alias("shard"), "text")
    least = (support - 1) // shards + 1
    by_shard, anywhere, found = [], [], []
    for k in range(1, longest + 1):
        counts = local_phrases(dealt, k, 1, by_shard[-1] if by_shard else None)
        found.append(staged(may_reach(counts, support, shards, least), "local"))
        for held, bits in zip((by_shard, anywhere), _bitmaps(found[-1], shards), strict=True):
            held.append(spark.sparkContext.broadcast(bits))
    rest = staged(other_places(dealt, by_shard[:-1], anywhere[1:]).groupBy("lang", "k", "phrase", "mark").agg(F.sum("c").alias("c"), F.min("doc").alias("doc")), "rest")
    for held in (*by_shard, *anywhere):
        held.destroy()
    counts = rest.where("k > 0").select("k", F.col("phrase").alias("key"), F.shiftright("mark", 8).alias("other"), "doc", "c")
    for k, level in enumerate(found, 1):
        counts = counts.union(level.select(F.lit(k).alias("k"), "key", "other", "doc", "c"))
    wanted = staged(counts.groupBy("k", "key", "other").agg(F.sum("c").alias("c"), F.min("doc").alias("doc")).where(F.col("c") >= support), "wanted")
    written = written_phrases(texts, wanted, longest).dropDuplicates(["k", "key", "other"])
    phrases = wanted.join(written, ["k", "key", "other"]).select("lang", "k", "phrase", "c")
    total = rest.where("k = 0").select("lang", "k", F.lit("").alias("phrase"), "c")
    out = staged(phrases.union(total), "phrases")
    discard(*found, rest, wanted)
    return out


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` best
    phrases of 2 to ``longest`` words.  ``docs``: text and lang; further columns
    are ignored.

    a, l and r are the occurrences of the phrase, of its part before the cut and
    of the rest; the cut with the lowest score floor(2000000 a / (l + r)) counts,
    ties to the first.  Phrases whose words stand in a longer frequent phrase
    with at least 80 % of their occurrences are left out.  Order: score and a
    descending, phrase ascending by its bytes.  Null languages are ``und``, null
    and empty texts hold no words, repeated rows count each; an empty table
    gives no rows."""
    freq = frequent_phrases(docs, support, shards, longest)
    f = freq.where("k > 0").select("lang", "phrase", F.col("c").alias("f"))
    cand = freq.where("k > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = cand.select("lang", "k", "phrase", F.col("c").alias("a"), cut)
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - k)"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(f.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    # every shorter run of a longer phrase's words, with the longer one's count
    words = F.split("phrase", " ", -1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("k") - m), lambda p: F.array_join(F.slice(words, p + 1, m), " "))))
    longer = cand.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "c").groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    held = F.expr(f"100 * cast(longer as decimal(20,0)) >= {COVERED} * cast(a as decimal(20,0))")
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~held)
    # the best of each part of a language first: a language's task then ranks PARTS * top rows at most
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    left = left.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top)
    best = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = freq.where("k = 0").select("lang", F.col("c").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
