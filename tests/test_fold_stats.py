"""Fold-aware naive Bayes against a direct fit on each training part."""

import math
import random
import re
from collections import Counter

from linesight.operators import fold_stats as Fs


def direct(rows, folds, min_df):
    """id -> class, every model fitted on its own training rows."""
    words = {i: Counter(w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 1) for i, t, _, _ in rows}
    out = {}
    for held in range(folds):
        train = [(i, c) for i, _, c, f in rows if f != held]
        df = Counter(w for i, _ in train for w in words[i])
        vocabulary = [w for w, n in df.items() if n >= min_df]
        classes = sorted({c for _, c in train})

        def variance(values):
            mean = sum(values) / len(values)
            return mean, max(sum(v * v for v in values) / len(values) - mean * mean, 0.0)
        extra = 1e-9 * max([variance([words[i][w] for i, _ in train])[1] for w in vocabulary], default=0.0)
        model = {(c, w): variance([words[i][w] for i, x in train if x == c]) for c in classes for w in vocabulary}
        for i, _, _, f in rows:
            if f == held:
                def score(c, i=i):
                    total = math.log(sum(x == c for _, x in train) / len(train))
                    for w in vocabulary:
                        mean, var = model[c, w]
                        var = max(var + extra, 1e-300)
                        total += -0.5 * math.log(2 * math.pi * var) - (words[i][w] - mean) ** 2 / (2 * var)
                    return total
                out[i] = max(classes, key=lambda c: (round(score(c), 6), -c))
    return out


def rows_of(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = int(rng.random() < 0.4) + (rng.random() < 0.1)
        pool = ["alpha", "beta", "Gamma", "delta", "x", "é1"] + [f"c{c}"] * 3 + [f"rare{rng.randrange(40)}"]
        rows.append((i, None if i % 17 == 5 else " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 25))), c, rng.randrange(4)))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int, fold int").repartition(3)


def test_predictions_equal_direct_fits(spark):
    rows = rows_of(160)
    got = Fs.cross_predict(table(spark, rows), "label", "fold", 4, min_df=6).collect()
    assert {(r["doc_id"], r["target"], r["fold"]) for r in got} == {(i, c, f) for i, _, c, f in rows} and len(got) == len(rows)
    assert {r["doc_id"]: r["pred"] for r in got} == direct(rows, 4, 6)


def test_term_counts(spark):
    texts = ["b a b B  cc c dd.dd aa", "", "x y z", "one", None, "aa " * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in Fs.occurrences(df).collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = r["x"]
    assert got == {0: {"cc": 1, "dd": 2, "aa": 1}, 3: {"one": 1}, 5: {"aa": 5}}


def test_held_out_statistics_are_the_total_less_the_fold(spark):
    rows = rows_of(90, 2)
    df = table(spark, rows)
    stats = Fs.held_out_statistics(Fs.fold_statistics(df, "label", "fold"), 4, [0, 1, 2], min_df=1).collect()
    want = {}
    for held in range(4):
        for i, t, c, f in rows:
            if f != held:
                for w, x in Counter(w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 1).items():
                    for k in range(3):
                        s, q = want.get((held, w, k), (0, 0))
                        want[held, w, k] = (s + x * (k == c), q + x * x * (k == c))
    assert {(r["held"], r["term"], r["label"]): (r["s"], r["q"]) for r in stats} == want


def test_a_fold_without_words_and_a_class_in_one_fold(spark):
    rows = [(0, "", 0, 0), (1, "aa bb", 0, 1), (2, "aa", 1, 1), (3, "bb bb", 0, 2), (4, None, 1, 1)]
    got = {r["doc_id"]: r["pred"] for r in Fs.cross_predict(table(spark, rows), "label", "fold", 3, min_df=1).collect()}
    assert set(got) == set(range(5)) and got[1] == got[2] == got[4] == 0        # class 1 is unknown without fold 1
    assert Fs.cross_predict(table(spark, rows), "label", "fold", 3, min_df=99).count() == 5


def test_terms_are_counted_once_in_their_rows(spark, monkeypatch):
    """One scan of the texts serves the statistics and the scores; a task adds up its documents first."""
    texts = []
    whole = Fs.terms
    monkeypatch.setattr(Fs, "terms", lambda c: texts.append(c) or whole(c))
    rows = rows_of(120, 3)
    Fs.cross_predict(table(spark, rows), "label", "fold", 4, min_df=2).collect()
    assert len(texts) == 1
    counted = Fs.counted_terms(table(spark, rows).coalesce(1), keep=["label", "fold"])
    assert counted.count() == len(rows)
    for held in (5, 1 << 20):      # in several parts, in one
        monkeypatch.setattr(Fs, "HELD_TERMS", held)
        got = {(r["term"], r["fold"], r["label"]): (r["n"], r["s"], r["q"]) for r in Fs.counted_statistics(counted, "label", "fold").collect()}
        want = {}
        for _, t, c, f in rows:
            for w, x in Counter(w for w in re.findall(r"\w+", (t or "").lower()) if len(w) > 1).items():
                n, s, q = want.get((w, f, c), (0, 0, 0))
                want[w, f, c] = (n + 1, s + x, q + x * x)
        assert got == want


def test_a_block_holds_one_fold(spark, monkeypatch):
    """Documents meet the words of their own fold's model only, however many blocks there are."""
    from linesight.operators import token_blocks as Tb
    rows = rows_of(160, 5)
    df = table(spark, rows).selectExpr("doc_id", "fold", "coalesce(text, '') as text")
    for size in (10, 1 << 20):
        block, n = Tb._grouped(*Tb._blocks(Fs.F.col("text"), ["doc_id"], df, size), Fs.F.col("fold"), 4)
        dealt = df.select("fold", block.alias("b")).distinct().collect()
        assert n % 4 == 0 and all(0 <= r["b"] < n and r["b"] % 4 == r["fold"] for r in dealt)
        assert size > 10 or len(dealt) > 4
    monkeypatch.setattr(Fs, "BLOCK_BYTES", 64)
    got = {r["doc_id"]: r["pred"] for r in Fs.cross_predict(table(spark, rows), "label", "fold", 4, min_df=6).collect()}
    assert got == direct(rows, 4, 6)


def test_the_block_of_a_document_is_told_once(spark, monkeypatch):
    """Its hash reads the whole text; above the explode it was made for every token."""
    from linesight.operators import token_blocks as Tb
    df = spark.createDataFrame([(0, "a b a", 0)], "doc_id long, text string, fold int")
    words = spark.createDataFrame([("a", 1)], "tok string, v int")
    answers = []
    monkeypatch.setattr(Tb, "stored", lambda found, name: answers.append(found) or found)
    out = Tb.looked_up(df, Fs.F.col("text"), Fs.F.split("text", " "), words, [Fs.F.col("doc_id")], "doc_id long, n int",
                       lambda x: iter([Fs.pa.RecordBatch.from_pydict({"doc_id": x.rows.column(0), "n": Fs.pa.array([int((x.code >= 0).sum())], Fs.pa.int32())})]), ["doc_id"])
    plan = answers[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert any("xxhash64" in line for line in plan[explode:]) and not any("xxhash64(doc_id" in line for line in plan[explode - 1:explode])
    assert [tuple(r) for r in out.collect()] == [(0, 2)]
