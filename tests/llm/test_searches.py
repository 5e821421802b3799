import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from linesight.llm import exact_topk as K
from linesight.llm import license_scan as L
from linesight.llm import sql
from linesight.llm import url_filter as U
from linesight.llm.queries import URL_RULES
from tests.llm.data import awkward, documents, sentence


def brute_top_k(rows, k=5):
    """Rows found, each as often as it is found; rows that share an id are rows of their own."""
    clean = [(i, [math.floor(256 * c) for c in x]) for i, x, *_ in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for at, (q, x) in enumerate(clean):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i) for to, (i, v) in enumerate(clean) if to != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16)) / 4
    x[100:180] = x[3]                 # ties
    x[200:260] = x[50] + rng.normal(size=(60, 16)) / 100
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1050, [1.0, None], 0), (1100, [float("nan")] * 16, 0), (1150, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (1200, [], 0), (1250, [0.5, -0.5], 0), (50, [9.0] * 16, 0), (100, list(map(float, x[100])), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    for entries, queries in ((1 << 19, 1024), (90 * 16, 5)):
        got = sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 50 == 0, block_entries=entries, query_rows=queries).collect())
        assert got == brute_top_k(rows)
    few = spark.createDataFrame(rows[:1] + rows[50:53], "vec_id long, embedding array<double>, score int")
    assert sorted(tuple(r) for r in K.top_k(few, F.col("vec_id") % 50 == 0).collect()) == brute_top_k(rows[:1] + rows[50:53])
    assert K.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_reading_stops_early(spark):
    """No query reads all lists, on vectors spread evenly in 64 dimensions (as in
    the test table) and on some with a few wide axes, which end far sooner."""
    rng = np.random.default_rng(3)
    even = rng.normal(size=(2000, 64))
    even /= np.linalg.norm(even, axis=1, keepdims=True)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    wide = (rng.normal(size=(2000, 64)) * 0.8 ** np.arange(64)) @ axes
    shares = []
    for x in (even, wide):
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        rows = K.searched(df, F.col("vec_id") % 50 == 0).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == brute_top_k([(i, v) for i, v in enumerate(x)])
        shares.append(np.array([r["read"] for r in rows]))
    assert shares[0].max() < 0.9 and shares[0].mean() < 0.8, shares[0].mean()
    assert shares[1].max() < 0.3 and shares[1].mean() < 0.2, shares[1].mean()


def test_bounds_hold_only_vectors_that_can_qualify():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(500, 12)))
    v[7] = v[3]
    lists = K.Lists(v)
    for j in range(40):
        own = np.array([j])
        c, share = K.candidates(lists, v[j], own, 4)
        full = v @ v[j]
        full[j] = -np.inf
        assert set(np.flatnonzero(full >= np.sort(full)[-4])) <= set(c) and j not in c and 0 < share <= 1
    assert len(K.candidates(K.Lists(np.zeros((6, 3))), np.zeros(3), np.array([0]), 2)[0]) == 5


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_urls(spark):
    urls = ["http://a.example.com/en/1", "http://www.example.com/en/2?x=1#f", "https://EXAMPLE.com/en/", "http://example.com", "http://x.net/es/3", "http://net/fr/4", "http://xnet/fr/4", "http://q.org/a/?b=2&a=1&utm_source=z", "http://www.q.org:80/a?a=1&b=2", "https://q.org/a/?a=1&b=3", None, "", "nothing", "ftp://É.org/Ü://x", "http://u@q.org/a?a=1&b=2#frag", "http://q.org/a?a=1&b=2\nx", "://", "http:///x"]
    rows = [(i, u, "clash") for i, u in enumerate(urls + urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, Host string")
    listed = spark.createDataFrame([("http://q.org/a?b=2&a=1",), (None,), ("junk",), ("http://net/fr/4",)], "url string")
    got = U.judge(pages, listed, URL_RULES)
    assert got.columns == ["page_id", "url", "Host", "host_", "path", "canon", "rule", "verdict"]
    out = got.collect()
    assert len(out) == len(rows)
    hit = {7, 8, 14}
    for r in out:
        host, path = url_parts(r.url)
        assert (r.host_, r.path) == (host, path)
        fits = [x for x in URL_RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert r.rule == (best and best[0] + best[1])
        assert r.verdict == (best[2] if best else "block" if r.page_id % len(urls) in hit else "allow"), r
    assert U.judge(pages.limit(0), listed, URL_RULES).count() == 0
    assert {r.verdict for r in U.judge(pages, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("canon"))
    blocks = -(-5000 // U.URLS_PER_BLOCK)
    table = U.bloom_blocks(listed, blocks)
    probe = spark.range(20_000).select("id", F.concat(F.lit("h/"), "id").alias("canon"))
    masks = [m.alias(f"m{i}") for i, m in enumerate(U._masks(F.xxhash64(F.lit(1), "canon")))]
    hits = probe.select("id", F.pmod(F.xxhash64("canon"), F.lit(blocks)).alias("block"), *masks).join(table, "block").where(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(4)))
    found = {r.id for r in hits.select("id").collect()}
    assert set(range(5000)) <= found and len(found) < 5000 + 0.03 * 15_000
    assert U.listed_pages(probe, listed).count() == 5000


def brute_scan(text, k=L.K):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    more, score = set(labels), 0.0
    for label, template in L.TEMPLATES:
        t = L.word_list(template)
        votes = defaultdict(list)
        for i in range(len(w) - k + 1):
            for j in range(len(t) - k + 1):
                if w[i:i + k] == t[j:j + k]:
                    votes[i - j].append((i, j))
        group, last = [], None
        for d in [*sorted(votes), None]:
            if group and (d is None or d - last > L.MERGE):
                cover = len({x for _, j in group for x in range(j, j + k)}) / len(t)
                most = L.STRETCH * len(t) + L.MERGE
                if cover >= L.COVERED and max(i for i, _ in group) + k - min(i for i, _ in group) <= most:
                    more.add(label)
                    score = max(score, cover)
                elif cover >= L.COVERED:      # a long chain: the windows that begin at its hits
                    for begin in {i for i, _ in group}:
                        cover = len({x for i, j in group if i >= begin and i + k - begin <= most for x in range(j, j + k)}) / len(t)
                        if cover >= L.COVERED:
                            more.add(label)
                            score = max(score, cover)
                group = []
            if d is not None:
                group += votes[d]
                last = d
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(80):
        words = sentence(rng, rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(0, 4)):
            t = rng.choice([*(t for _, t in L.TEMPLATES), *L.PHRASES, "GENERAL Public\nLicense"]).split()
            for _ in range(rng.randrange(0, 3)):
                t.insert(rng.randrange(len(t)), "odd") if rng.random() < 0.5 else t.pop(rng.randrange(len(t)))
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        texts.append(" ".join(words))
    ids, more = awkward()
    all_ids, all_texts = [*range(100, 180), *ids], [*texts, *more]
    rows = L.scan(documents(spark, all_texts, all_ids)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in rows), key=str)
    want = sorted(((i, *(round(x, 9) if isinstance(x, float) else x for x in brute_scan(t))) for i, t in zip(all_ids, all_texts, strict=True)), key=str)
    assert got == want
    assert L.scan(documents(spark, [])).count() == 0


def test_notice_in_a_long_chain_is_found(spark):
    """Repeats that lie on neighbouring diagonals do not hide a notice."""
    notice = "All rights reserved. No part of this publication may be reproduced"
    texts = ["All rights reserved. " * 4 + notice, "All rights reserved. " * 400 + notice.replace("part of", "part at all of") + " All rights reserved." * 9, "All rights reserved. " * 50]
    out = {r.doc_id: r for r in L.scan(documents(spark, texts)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    for r in con.sql(sql.license_scan()).fetchall():         # SQL and brute force state the same rule
        own = out[r[0]]
        assert r == (own.doc_id, own.n_words, own.n_base, own.first_word, own.last_word, own.base_labels, own.labels, own.score)
        assert (own.labels, own.score) == brute_scan(texts[r[0]])[5:]
    assert [out[i].labels for i in range(3)] == ["all-rights-reserved", "all-rights-reserved", ""]
    assert out[0].score == 1.0 and out[1].score >= L.COVERED and out[2].score == 0.0
    assert len(out[0].spans) == 1


def test_top_k_sends_no_block_and_no_vector_through_the_driver(spark, monkeypatch):
    plans, fetched, staged = [], [], K.staged

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))))
        return staged(df, name)
    monkeypatch.setattr(K, "staged", seen)
    collect = type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda df: fetched.append(collect(df)) or fetched[-1])
    x = np.random.default_rng(3).normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = K.top_k(df, F.col("vec_id") % 50 == 0, block_entries=50 * 8, query_rows=2)
    assert fetched and max(len(rows) for rows in fetched) <= K.GRAM_PARTS
    monkeypatch.undo()
    assert sorted(tuple(r) for r in found.collect()) == brute_top_k(list(enumerate(x)))
    assert [name for name, plan in plans if "Broadcast" in plan] == []
