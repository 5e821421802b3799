"""Exact quotas of the samplers (independent of partitioning), multiset
overlap, and the exact Wilcoxon p value."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from linesight.operators import overlap as Ov
from linesight.operators import runs as U
from linesight.operators import sampling as Sm
from tests import oracles as O


def _data(spark, parts=3):
    rows = [(i, "w%d x y" % i, 1 if i % 9 == 0 else 0) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(parts)


def test_stratified_quotas_and_invariance(spark):
    a = Sm.stratified_split(_data(spark, 1), "label", "doc_id", 123)
    b = Sm.stratified_split(_data(spark, 7), "label", "doc_id", 123)
    ra = {r["doc_id"]: r["split"] for r in a.collect()}
    rb = {r["doc_id"]: r["split"] for r in b.collect()}
    assert ra == rb
    c = Counter((r["label"], r["split"]) for r in a.collect())
    # 34 positives, 266 negatives; test = ceil(.1 n), val = ceil(.1 (n - test))
    assert c[(1, "test")] == 4 and c[(1, "val")] == 3 and c[(0, "test")] == 27 and c[(0, "val")] == 24


def test_kfold_undersample_oversample(spark):
    d = _data(spark)
    folds = Counter((r["label"], r["fold"]) for r in Sm.stratified_kfold(d, "label", "doc_id", 1, 10).collect())
    assert all(v in (3, 4) for k, v in folds.items() if k[0] == 1)
    u = Counter(r["label"] for r in Sm.undersample(d, "label", "doc_id", 1, ratio=4.0).collect())
    assert u == {1: 34, 0: 136}
    o = Counter(r["label"] for r in Sm.oversample(d, "label", "doc_id", 1).collect())
    assert o == {1: 266, 0: 266}
    e = Counter(r["label"] for r in Sm.exact_sample(d, "label", "doc_id", 1, {0: 100, 1: 50}).collect())
    assert e == {0: 100, 1: 34}


def test_augment_and_delete(spark):
    d = _data(spark)
    a = Counter(r["label"] for r in Sm.augment_minority(d, "text", "label", "doc_id", 5).collect())
    assert a[1] == 34 * (1 + (266 - 34) // 34)
    from linesight.functions import text as T
    toks = T.word_tokens("text")
    r = d.select(F.size(toks).alias("a"), F.size(Sm.perturb_delete(toks, 5, F.xxhash64("doc_id")))
                 .alias("b")).collect()
    assert all(1 <= x["a"] - x["b"] <= 3 for x in r)


def test_multiset_overlap_counts(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    gt = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, line string")
    pr = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c")], "doc_id long, line string")
    out = {r["doc_id"]: r for r in Ov.multiset_overlap(docs, gt, pr).collect()}
    g, p = Counter(["a", "a", "b"]), Counter(["a", "c", "c"])
    inter, uni = sum((g & p).values()), sum((g | p).values())
    assert out[1]["msp"] == pytest.approx(inter / 3) and out[1]["miou"] == pytest.approx(inter / uni)
    assert out[2]["msp"] == 0.0 and out[2]["gt_len"] == 0


def test_wilcoxon_exact(spark):
    diffs = [0.31, -0.12, 0.5, 0.07, 0.22, -0.04, 0.9, 0.15]
    pairs = spark.createDataFrame([(f"r{i}", "accuracy", d, 0.0) for i, d in enumerate(diffs)],
                                  "run string, metric string, a double, b double")
    out = U.wilcoxon_signed_rank(pairs).first()
    w, p = O.wilcoxon_exact_greater(diffs)
    assert out["w_plus"] == w and out["exact"] and out["p_value"] == pytest.approx(p)


def test_multiset_overlap_row_local_matches_counter(spark):
    import random
    rng = random.Random(2)
    rows = []
    for i in range(60):
        g = [rng.choice("abcd") for _ in range(rng.randint(0, 6))]
        p = [rng.choice("abce") for _ in range(rng.randint(0, 6))]
        rows.append((i, g, p))
    df = spark.createDataFrame(rows, "id int, g array<string>, p array<string>")
    got = {r["id"]: r for r in df.select("id", *Ov.multiset_overlap_arrays(F.col("g"), F.col("p"))).collect()}
    for i, g, p in rows:
        cg, cp = Counter(g), Counter(p)
        inter, uni = sum((cg & cp).values()), sum((cg | cp).values())
        assert got[i]["msp"] == pytest.approx(inter / len(p) if p else 0.0)
        assert got[i]["msr"] == pytest.approx(inter / len(g) if g else 0.0)
        assert got[i]["miou"] == pytest.approx(inter / uni if uni else 0.0)
