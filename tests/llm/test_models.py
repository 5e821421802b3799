import bisect
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesight.llm import decontaminate as D
from linesight.llm import language_id as G
from tests.llm.data import awkward, documents, sentence

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def test_leaks(spark):
    """Copies and paraphrases of whole passages are found, clean texts are not."""
    rng = random.Random(11)
    items = [" ".join(sentence(rng, 6) + "." for _ in range(rng.randrange(3, 12))) for _ in range(40)]
    common = ["the", "of", "and", "to", "in"]
    texts, want = [], {}
    for i in range(150):
        words = [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 400))]
        if i % 3 == 0:
            item = rng.randrange(40)
            part = items[item].split()
            if i % 2:
                for _ in range(len(part) // 6):
                    p = rng.randrange(len(part))
                    part[p:p + 1] = rng.choice([[], ["other"], ["more", part[p]]])
            at = rng.randrange(len(words))
            words[at:at] = part
            want[i] = item
        texts.append(" ".join(words))
    bench = spark.createDataFrame([*enumerate(items), (40, None), (41, ""), (42, "too short"), (None, items[0]), (3, items[3])], "item_id long, text string").withColumn("words", F.lit("clash"))
    for size in (D.SLICE, 15):
        got = D.leaks(documents(spark, texts).repartition(4), bench, size)
        found = {(r.doc_id, r.item_id): r for r in got.collect()}
        assert set(found) == set(want.items())
        assert all(r.covered >= D.PARAPHRASE and r.first_word <= r.last_word for r in found.values())


def test_leaks_awkward_rows(spark):
    ids, texts = awkward()
    bench = spark.createDataFrame([(1, "unlike anything that stands in these few documents here")], "item_id long, text string")
    docs = documents(spark, texts, ids)
    assert D.leaks(docs, bench).count() == 0
    own = spark.createDataFrame([(1, " ".join(texts[5].split()[100:140]))], "item_id long, text string")
    assert sorted(r.doc_id for r in D.leaks(docs, own).collect()) == [5, 6]
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(documents(spark, []), own).count() == 0


def test_no_hit_of_the_word_check_is_lost(spark):
    """Of a large benchmark of short items, all that a check of every window
    against every item finds is found."""
    rng = random.Random(8)
    common = ["the", "of", "and", "to", "in", "a", "is", "that"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6)) % 6000}"
    items = [[word() for _ in range(rng.choice((6, 8, 12, 16, 24, 40)))] for _ in range(3000)]
    texts = []
    for i in range(48):
        words, part = [word() for _ in range(rng.randrange(5, 60))], list(rng.choice(items))
        for _ in range(len(part) // 5 if i % 2 else 0):
            p = rng.randrange(len(part))
            part[p:p + 1] = rng.choice([[], ["other"], ["more", part[p]]])
        at = rng.randrange(len(words))
        words[at:at] = part
        texts.append(" ".join(words))
    passages = [p for i, w in enumerate(items) for p in D.passages(i, " ".join(w))]
    masks = [(i, len(h), D._masks(h), len(a), D._masks(a)) for i, h, a in passages]
    want = set()
    for d, text in enumerate(texts):
        h = D._hashed(text).tolist()
        for i, n, m, k, answer in masks:
            for begin in range(0, len(h), D.HOP):
                part = h[max(0, begin - n):begin + 2 * D.HOP + n]
                share = D.common_length(m, n, part) / n
                if share >= D.COPY or (share >= D.PARAPHRASE and D.common_length(answer, k, part) >= D.ANSWER * k):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(documents(spark, texts), bench).collect()}
    assert len(want) >= 40 and got == want


def test_the_cosine_search_finds_most_by_itself(spark):
    """Candidates by cosine alone hold nine in ten of the planted items that the word
    check finds, verbatim or edited; and hits of either source are hits of both."""
    rng = random.Random(5)
    common = ["the", "of", "and", "to", "in", "a", "is", "that"]
    zipf = list(itertools.accumulate(1 / (k + 10) for k in range(6000)))
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"w{bisect.bisect(zipf, rng.random() * zipf[-1])}"
    items = [[word() for _ in range(rng.choice((6, 8, 12, 16, 24, 40)))] for _ in range(1000)]
    texts, planted = [], set()
    for i in range(200):
        item = rng.randrange(1000)
        planted.add((i, item))
        words, part = [word() for _ in range(rng.randrange(5, 60))], list(items[item])
        for _ in range(len(part) // 5 if i % 2 else 0):
            part[rng.randrange(len(part))] = "other"
        at = rng.randrange(len(words))
        words[at:at] = part
        texts.append(" ".join(words))
    passages = [p for i, w in enumerate(items) for p in D.passages(i, " ".join(w))]
    docs = documents(spark, texts).select("doc_id", F.lit(0).cast("long").alias("key"), "text")
    df, n = D.passage_frequency(docs, np.ones(D.FEATURES, bool))
    weight = D._weights(passages, df, n)
    used, space = D.latent_space(spark.createDataFrame([(h.view(np.int64).tolist(),) for _, h, _ in passages], "words array<long>"), weight)
    found = lambda *sources: {(r.doc_id, r.item_id) for r in D.search(docs, passages, df, n, used, space * weight[used, None], sources).collect()}
    every, latent = found("signature"), found("cosine")
    assert latent <= every and len(planted & every) >= 180
    assert len(planted & latent) >= 0.9 * len(planted & every)
    assert found(*D.SOURCES) == every


def test_items_of_few_words(spark):
    """They are leaked by documents of just the same words."""
    bench = spark.createDataFrame([(1, "Forty-two."), (2, "forty two"), (3, "yes"), (4, "..."), (5, "a b c d"), (5, "a b c d")], "item_id long, text string")
    texts = ["forty TWO", " forty, two!\n", "forty two three", "yes", "yes and no", "", "...", None, "A b.C d", "a b c d e", "yes " * 50_000]
    got = sorted((r.doc_id, r.item_id, r.first_word, r.last_word) for r in D.leaks(documents(spark, texts), bench).collect())
    assert got == [(0, 1, 0, 1), (0, 2, 0, 1), (1, 1, 0, 1), (1, 2, 0, 1), (3, 3, 0, 0), (8, 5, 0, 3)]


@needs_data
def test_every_verbatim_passage_is_found(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    pairs = docs.select("doc_id", norm("text").alias("t")).join(F.broadcast(bench.select("item_id", F.concat(F.lit(" "), F.trim(norm("text")), F.lit(" ")).alias("b"))), F.expr("instr(t, b) > 0"))
    want = {(r.doc_id, r.item_id) for r in pairs.collect()}
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 0.02 * len(want)


def test_common_length():
    assert D.common_length(D._masks(D._hashed("a b c b d a b")), 7, D._hashed("b d c a b a").tolist()) == 4


@needs_data
def test_held_out_accuracy(spark):
    """Texts alone identify the declared languages of rows the model has not seen."""
    rows = G.documents_evidence(spark.read.parquet(f"{DATA}/documents.parquet")).where("declared is not null")
    train = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    languages, model = G.fit(train)
    test = G.text_evidence(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1), languages, model)
    names = [*languages, G.UNKNOWN]
    seen = [(r.declared, names[r.text_best]) for r in test.collect()]
    assert sum(a == b for a, b in seen) >= 0.97 * len(seen)
    out = G.identify(rows).collect()
    assert sum(r.accepted for r in out) >= 0.99 * len(out)


def test_evidence_decides_where_the_text_does_not(spark):
    rng = random.Random(2)
    word = {"xx": "abcde", "yy": "fghij"}
    text = lambda lang, n: " ".join("".join(rng.choice(word[lang]) for _ in range(4)) for _ in range(n))
    rows = [(i, text(lang, 30), lang, f"h{lang}.{lang}", lang) for i in range(120) for lang in ("xx", "yy")]
    rows += [(1000, "q", "yy", "hyy.yy", "yy"), (1001, text("xx", 40), "yy", "hyy.yy", "yy"), (1002, None, "xx", None, None), (1003, "", None, None, None), (1004, "中文" * 50, None, None, None), (1005, text("yy", 40), None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string").withColumn("Logs", F.lit(1))
    out = {r.doc_id: r for r in G.identify(df).collect() if r.doc_id >= 1000}
    assert out[1001].language == "xx" and out[1001].text_language == "xx"
    assert out[1005].language == "yy" and out[1005].accepted
    assert out[1000].language == "yy"    # a letter says nothing; the rest does
    assert all(out[i].language == "und" and not out[i].accepted for i in (1002, 1003, 1004))


def test_every_declared_language_has_a_place(spark):
    """90 declared languages, one of them with two rows: none is left out."""
    rng = random.Random(4)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(30)] for i in range(90)}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(lang, text(lang), lang) for lang in words for _ in range(2 if lang == "l89" else 4)]
    rows += [(lang, text(lang), None) for lang in words if lang != "l89"] + [("und", "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200)), None)]
    df = spark.createDataFrame(rows, "want string, text string, declared string").withColumn("host", F.lit(None).cast("string")).withColumn("suffix", F.lit(None).cast("string"))
    out = G.identify(df).collect()
    assert len(out) == len(rows)
    assert [r for r in out if r.language != r.want or r.accepted != (r.want != "und")] == []


def test_language_awkward_rows(spark):
    ids, texts = awkward()
    docs = documents(spark, texts, ids)
    out = G.identify(G.documents_evidence(docs)).collect()
    assert len(out) == len(ids) and {r.language for r in out} <= {"en", "und"}
    assert all(r.language == "und" and not r.accepted for r in out if r.doc_id in (0, 1, 2, 9))
    unlabelled = G.identify(G.documents_evidence(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.language for r in unlabelled} == {"und"}    # nothing to learn from
    assert G.identify(G.documents_evidence(documents(spark, []))).count() == 0


@needs_data
def test_pages_evidence(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    out = G.identify(G.pages_evidence(pages)).collect()
    assert len(out) == pages.count() and sum(r.language == r.declared for r in out) >= 0.95 * len(out)
