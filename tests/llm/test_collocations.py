import random
import re
from collections import Counter

import numpy as np
import pytest

from linesight.llm import collocations as C
from tests.llm.data import DOCUMENTS, awkward, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, top=2000, longest=4):
    """(lang, rank, phrase, a, l, r, n, score) straight from the definition."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    longer = Counter()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i:i + m]] = max(longer[lang, p[i:i + m]], a)
    out = {}
    for (lang, p), a in cand.items():
        if 100 * longer[lang, p] < 80 * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:c]] + f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, best in out.items() for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])}


def corpus(rng, n):
    """Texts with planted phrases, odd spaces, marks within phrases and rare words."""
    planted = ["new york city hall", "Prime Minister", "été à paris", "a b a b a b", "the the the", "over\tand  out", "Dr. No", "x:y", " odd space"]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 40)):
            words.append(rng.choice(planted) if rng.random() < 0.25 else f"w{min(rng.randrange(60), rng.randrange(60))}")
        marks = [w + rng.choice(["", "", "", ",", ".", "\n", " ", "!"]) for w in words]
        texts.append(" ".join(marks))
    return texts


def rows_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize(("support", "shards", "top"), [(30, 8, 2000), (7, 3, 25), (2, 1, 2000), (1, 8, 40)])
def test_collocations_equal_brute_force(spark, support, shards, top):
    rng = random.Random(support)
    texts = corpus(rng, 250)
    rows = [(i, t, rng.choice(["en", "en", "en", "de", None, "und"]), "s", 1, "x", "y", "z", "r", "g") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    got = C.collocations(df, support, shards, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes} == {"string", "bigint"}
    assert rows_of(got) == brute([(r[1], r[2]) for r in rows], support, top)


def test_full_bitmaps_lose_and_add_nothing(spark, monkeypatch):
    """With bitmaps far too small all phrases are counted; the result is the same."""
    monkeypatch.setattr(C, "BITMAP_BITS", 6)
    monkeypatch.setattr(C, "HELD", 64)
    monkeypatch.setattr(C, "CHUNK_WORDS", 8)
    texts = corpus(random.Random(4), 120)
    assert rows_of(C.collocations(documents(spark, texts).repartition(3), 5, 4)) == brute([(r["text"], r["lang"]) for r in documents(spark, texts).collect()], 5)


def test_shards_are_mined_at_the_lowered_support(spark):
    """A shard reports exactly its runs with the lowered support; every frequent
    phrase has it in one shard."""
    from pyspark.sql import functions as F
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(12)) for _ in range(200)]
    dealt = documents(spark, texts).select(F.lit("en").alias("lang"), F.pmod(F.xxhash64("text"), F.lit(3)).cast("int").alias("shard"), "text")
    by_shard = Counter()
    for r in dealt.collect():
        w = r["text"].split()
        by_shard.update((r["shard"], a, b) for a, b in zip(w, w[1:], strict=False))
    found = [r["key"] for r in C.local_phrases(dealt, 2, 6).collect()]
    want = Counter(s for (s, *_), c in by_shard.items() if c >= 6)
    assert Counter(k & 255 for k in found) == want
    total = Counter()
    for (_, a, b), c in by_shard.items():
        total[a, b] += c
    assert all(max(by_shard[s, *p] for s in range(3)) >= (16 - 1) // 3 + 1 for p, c in total.items() if c >= 16)


def test_candidates_are_those_that_may_reach_the_support(spark):
    """All phrases with the support are candidates, and no locally frequent one
    whose counts rule the support out."""
    from pyspark.sql import functions as F
    rng = random.Random(10)
    texts = [" ".join(f"w{min(rng.randrange(15), rng.randrange(15))}" for _ in range(12)) for _ in range(200)]
    dealt = documents(spark, texts).select(F.lit("en").alias("lang"), F.pmod(F.xxhash64("text"), F.lit(3)).cast("int").alias("shard"), "text")
    local = C.local_phrases(dealt, 2, 6).cache()
    counts = Counter()
    for r in local.collect():
        counts[r["key"] & -256] += r["c"]
    shards = Counter(r["key"] & -256 for r in local.collect())
    want = {k for k, c in counts.items() if c + (3 - shards[k]) * 5 >= 18}
    got = [r["key"] for r in C.may_reach(local, 18, 3, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(counts)
    total = Counter()
    for r in dealt.collect():
        w = r["text"].split()
        total.update(zip(w, w[1:], strict=False))
    assert len(want) >= sum(c >= 18 for c in total.values()) > 0 < len(counts) - len(want)


def test_a_held_phrase_is_one_row_a_shard():
    """However its shards alternate; phrases with the same first hash stay apart."""
    n = 1000
    key = np.array([256 * 7, 256 * 9], np.uint64)[np.arange(n) // 4 % 2] | (np.arange(n) % 4).astype(np.uint64)
    held = [(key, np.full(n, 5, np.uint64), np.arange(n, dtype=np.int32)), (key[:4], np.full(4, 6, np.uint64), np.zeros(4, np.int32))]
    got = C._summed(held)
    rows = list(zip(*(got[x].to_pylist() for x in ("phrase", "mark", "doc", "c")), strict=True))
    total = Counter()
    for phrase, mark, _, c in rows:
        total[phrase, mark >> 8, mark & 255] += c
    assert total == {(256 * p, 5, s): n // 8 for p in (7, 9) for s in range(4)} | {(256 * 7, 6, s): 1 for s in range(4)}
    assert len(rows) <= 4 * (2 + 2) and min(r[2] for r in rows if r[:2] == (256 * 9, 5 << 8 | 3)) == 7


@pytest.mark.parametrize("tasks", [1, 6])
def test_passes_over_the_texts_make_rows_of_what_is_open_only(spark, tasks):
    """After the shards are mined, the places of candidates that no shard
    counted are counted, and each wanted phrase is written once, by however many tasks."""
    from pyspark.sql import functions as F
    rng = random.Random(12)
    rows = [" ".join("a{0} b{0}".format(rng.randrange(60)) for _ in range(6)) for _ in range(150)]
    texts = documents(spark, rows + rows[:30]).select(F.lit("en").alias("lang"), "text").repartition(tasks)
    dealt = texts.select("lang", F.pmod(F.xxhash64("text"), F.lit(3)).cast("int").alias("shard"), "text")
    support, shards, least = 12, 3, 4
    words, pairs, total = Counter(), Counter(), Counter()
    for r in dealt.collect():
        w = r["text"].split()
        words.update((r["shard"], x) for x in w)
        pairs.update((r["shard"], p) for p in zip(w, w[1:], strict=False))
        total.update(zip(w, w[1:], strict=False))

    def candidates(counts):
        more = Counter()
        for (_, p), c in counts.items():
            more[p] += max(0, c - (least - 1))
        return {p for p, m in more.items() if m and m >= support - shards * (least - 1)}
    known = {(s, x) for (s, x), c in words.items() if c >= least and x in candidates(words)}
    counted = Counter({(s, p): c for (s, p), c in pairs.items() if (s, p[0]) in known and (s, p[1]) in known})
    want = candidates(counted)
    open_ = Counter({(s, p): c for (s, p), c in pairs.items() if p in want and (s, p) not in counted})
    assert 0 < sum(open_.values()) < sum(counted.values()) and max(open_.values()) < least

    share = spark.sparkContext.broadcast
    one = C.may_reach(C.local_phrases(dealt, 1, 1), support, shards, least)
    by_shard = share(C._bitmaps(one, shards)[0])
    two = C.may_reach(C.local_phrases(dealt, 2, 1, by_shard), support, shards, least).cache()
    rest = C.other_places(dealt, [by_shard], [share(C._bitmaps(two, shards)[1])]).collect()
    assert sum(r["c"] for r in rest if r["k"] == 2) == sum(open_.values())
    assert sum(r["c"] for r in rest if r["k"] == 0 and r["lang"] == "en") == sum(words.values())
    written = C.written_phrases(texts, two.select("key", "doc"), 2).collect()
    assert len(written) == len(want) and {(r["lang"], r["k"], tuple(r["phrase"].split())) for r in written} == {("en", 2, p) for p in want}
    found = {r["key"]: r["c"] for r in two.collect()}
    for r in rest:
        if r["k"] == 2:
            found[r["phrase"]] += r["c"]
    assert {tuple(r["phrase"].split()): found[r["key"]] for r in written} == {p: total[p] for p in want}


def test_more_than_64_shards(spark):
    """The shards a candidate is frequent in go through several numbers."""
    texts = corpus(random.Random(6), 150)
    rows = documents(spark, texts).collect()
    assert rows_of(C.collocations(documents(spark, texts), 150, 140)) == brute([(r["text"], r["lang"]) for r in rows], 150)


def test_exact_beyond_64_bits(spark):
    """The score of huge counts is a whole division without overflow or rounding."""
    e = "(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    a, l, r = 9_000_000_000_000_007, 9_000_000_000_000_011, 9_000_000_000_000_013
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(f"{e} AS score").first()
    assert row["score"] == 2_000_000 * a // (l + r)


def test_awkward_documents(spark):
    ids, texts = awkward()
    df = documents(spark, texts, ids)
    assert rows_of(C.collocations(df, 2, 2)) == brute([(r["text"], r["lang"]) for r in df.collect()], 2)
    assert rows_of(C.collocations(documents(spark, texts, ids).union(documents(spark, texts, ids)), 2)) == brute([(r["text"], r["lang"]) for r in df.collect()] * 2, 2)
    assert C.collocations(df.limit(0)).count() == 0
    assert C.collocations(documents(spark, [None, "", " . "])).count() == 0
    with pytest.raises(ValueError):
        C.collocations(df, shards=300)
