"""Exact neighbours, synthetic vectors and near words against brute force."""

import math
import random

import numpy as np

from linesight.operators import nearest as N
from linesight.operators import sampling as Sm
from linesight.operators import synthetic as Sy


def brute(points, queries, k):
    out = {}
    for q, x in queries:
        near = sorted((math.sqrt(((np.array(x) - np.array(y)) ** 2).sum()), i) for i, y in points if i != q)[:k]
        out[q] = [(i, d) for d, i in near]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in x]) for i, x in rows], "id long, x array<double>").repartition(3)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["id"], r["dist"]))
    return out


def test_neighbours_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.1 + c for c in ((0, 0, 0), (5, 0, 0), (0, 9, 1), (0.3, 0.2, 0))] + [rng.normal(size=(40, 3)) * 20])
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0)])           # one point many times: ties by id
    rows = list(enumerate(x.tolist()))
    asked = rows[::3]
    want = brute(rows, asked, 4)
    for cell, block in ((10_000, 4096), (12, 4096), (12, 9), (1, 5)):
        monkeypatch.setattr(N, "BLOCK_ROWS", block)
        got = found(N.nearest(table(spark, rows), table(spark, asked), 4, cell_rows=cell))
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
        assert all(np.allclose([d for _, d in got[q]], [d for _, d in want[q]]) for q in want)


def test_far_cells_are_not_searched(spark, monkeypatch):
    """Two clouds far apart: no query is sent to the other one's cells."""
    sent = []
    search = N._search
    monkeypatch.setattr(N, "_search", lambda cells, s, *a: (sent.append(s.count()), search(cells, s, *a))[1])
    rng = np.random.default_rng(2)
    rows = list(enumerate(np.concatenate([rng.normal(size=(100, 2)), rng.normal(size=(100, 2)) + 1000]).tolist()))
    df = table(spark, rows)
    assert found(N.nearest(df, df, 3, cell_rows=25)).keys() == dict(rows).keys()
    assert sent[0] == 200 and sent[1] < 200 * 5                     # of 7 other cells each at most those of the own cloud


def test_few_or_no_points(spark):
    rows = [(5, [0.0, 1.0]), (7, [1.0, 1.0])]
    assert found(N.nearest(table(spark, rows), table(spark, rows), 5)) == {5: [(7, 1.0)], 7: [(5, 1.0)]}
    none = table(spark, rows).limit(0)
    assert N.nearest(none, table(spark, rows), 5).count() == 0 and N.nearest(table(spark, rows), none, 5).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in x], c) for i, x, c in rows], "id long, x array<double>, label int").repartition(3)


def sample(n_major=60, n_minor=17):
    rng = np.random.default_rng(3)
    return [(i, rng.normal(size=4) + (0 if i < n_major else 1.2), int(i >= n_major)) for i in range(n_major + n_minor)]


def on_segments(made, rows, k=5):
    own = {i: np.array(x) for i, x, c in rows if c == 1}
    near = brute(list(own.items()), list(own.items()), k)
    for r in made:
        assert r["neighbour"] in [i for i, _ in near[r["base"]]] or (len(own) == 1 and r["neighbour"] == r["base"])
        assert 0 <= r["u"] < 1 and np.allclose(r["x"], own[r["base"]] + r["u"] * (own[r["neighbour"]] - own[r["base"]]))


def test_smote(spark):
    rows = sample()
    made = Sy.smote(vectors(spark, rows), "x", "label", "id", 7).collect()
    assert sorted(r["draw"] for r in made) == list(range(60 - 17)) and {r["label"] for r in made} == {1}
    on_segments(made, rows)
    again = Sy.smote(vectors(spark, rows).repartition(7), "x", "label", "id", 7).collect()
    assert sorted(map(str, again)) == sorted(map(str, made))
    other = Sy.smote(vectors(spark, rows), "x", "label", "id", 8).collect()
    assert {(r["base"], r["neighbour"]) for r in other} != {(r["base"], r["neighbour"]) for r in made}
    for few in (1, 2, 4):
        rows = sample(20, few)
        made = Sy.smote(vectors(spark, rows), "x", "label", "id", 7).collect()
        assert len(made) == 20 - few
        on_segments(made, rows)
    assert Sy.smote(vectors(spark, sample(20, 20)), "x", "label", "id", 7).count() == 0
    assert Sy.smote(vectors(spark, sample()).limit(0), "x", "label", "id", 7).count() == 0


def test_smote_brings_every_class_to_the_largest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3), c) for i, c in enumerate([0] * 25 + [1] * 9 + [2] * 14)]
    made = Sy.smote(vectors(spark, rows), "x", "label", "id", 1).groupBy("label").count().collect()
    assert sorted(map(tuple, made)) == [(1, 16), (2, 11)]


def test_adasyn_counts_add_up(spark):
    rows = sample(83, 17)
    shares = {r["id"]: (r["others"], r["n"]) for r in Sy.adasyn_shares(vectors(spark, rows), "x", "label", "id", 1).collect()}
    near = brute([(i, x) for i, x, _ in rows], [(i, x) for i, x, c in rows if c == 1], 5)
    others = {i: sum(rows[j][2] != 1 for j, _ in v) for i, v in near.items()}
    weight, total = sum(others.values()), 83 - 17
    want = {i: total * o // weight for i, o in others.items()}
    for i in sorted(others, key=lambda i: (-(total * others[i] % weight), i))[:total - sum(want.values())]:
        want[i] += 1
    assert {i: o for i, (o, _) in shares.items()} == others and {i: n for i, (_, n) in shares.items()} == want
    assert sum(want.values()) == total
    made = Sy.adasyn(vectors(spark, rows), "x", "label", "id", 3, 1).collect()
    assert {i: sum(r["base"] == i for r in made) for i in want} == want
    on_segments(made, rows)


def test_adasyn_without_other_neighbours(spark):
    rows = [(i, [float(i % 5), 0.0], 1) for i in range(10)] + [(i, [float(i), 1e6], 0) for i in range(20, 60)]
    assert Sy.adasyn(vectors(spark, rows), "x", "label", "id", 3, 1).count() == 0


def test_near_words(spark):
    rng = random.Random(1)
    words = {f"w{i}": [rng.gauss(0, 1) for _ in range(5)] for i in range(70)} | {"zero": [0.0] * 5, "double": None}
    words["double"] = [2 * c for c in words["w3"]]
    df = spark.createDataFrame(list(words.items()), "word string, vector array<double>").repartition(3)
    got = {r["tok"]: r["neighbours"] for r in Sm.word_neighbours(df, 4).collect()}
    assert "zero" not in got and got["w3"][0] == "double"
    for a, near in got.items():
        cos = {b: np.dot(words[a], v) / np.linalg.norm(words[a]) / np.linalg.norm(v) for b, v in words.items() if b not in (a, "zero")}
        assert near == sorted(cos, key=lambda b: (-round(cos[b], 12), b))[:4]
    docs = spark.createDataFrame([(0, "w1 w2  w3 oov w1 " * 9, 1), (1, "oov zero", 0), (2, None, 1), (3, "w5", 0)], "doc_id long, text string, label int")
    out = {r["doc_id"]: r for r in Sm.perturb_neighbour(docs, df, "text", "doc_id", 5, k=4).collect()}
    before = ("w1 w2 w3 oov w1 " * 9).split()
    after = out[0]["text"].split()
    changed = [(x, y) for x, y in zip(before, after, strict=True) if x != y]
    assert 1 <= len(changed) == out[0]["replaced"] <= 10 and all(y in got[x] for x, y in changed)
    assert (out[1]["text"], out[1]["replaced"], out[2]["text"], out[2]["replaced"]) == ("oov zero", 0, "", 0)
    assert out[3]["replaced"] == 1 and out[3]["text"] in got["w5"]


def test_samples_move_no_text(spark):
    """Rows are told apart by comparisons: no exchange carries the text."""
    docs = spark.createDataFrame([(i, f"text {i}", i % 3 == 0) for i in range(200)], "doc_id long, text string, label boolean").repartition(4)
    for df in (Sm.stratified_split(docs, "label", "doc_id", 1), Sm.stratified_kfold(docs, "label", "doc_id", 1, 5), Sm.undersample(docs, "label", "doc_id", 1, 1.0), Sm.exact_sample(docs, "label", "doc_id", 1, {True: 5, False: 9})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan            # the table's own


def test_cuts_are_the_rows_at_their_ranks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 0, 1, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int").repartition(3)
    keyed = {r["id"]: r["k"] for r in df.select("id", Sm.seeded_key("id", 9).alias("k")).collect()}
    order = {c: sorted((keyed[i], i) for i, x in rows if x == c) for c in (0, 1, None)}
    ranks = {0: [1, 17, len(order[0])], 1: [0, 3, 3], None: [len(order[None])]}
    assert Sm.class_cuts(df, "label", "id", 9, ranks) == {c: [order[c][r - 1] for r in rs if r] for c, rs in ranks.items()}
    folds = {r["id"]: r["fold"] for r in Sm.stratified_kfold(df, "label", "id", 9, 7).collect()}
    for c, own in order.items():
        sizes = [sum(folds[i] == f for _, i in own) for f in range(7)]
        assert sizes == [len(own) // 7 + (f < len(own) % 7) for f in range(7)]
    few = {r["id"]: r["fold"] for r in Sm.stratified_kfold(df.where("id < 3"), "label", "id", 9, 7).collect()}
    assert len(few) == 3 and set(few.values()) <= set(range(3))


def test_k_nearest_equals_the_sorted_distances_and_sorts_only_the_near_ones(monkeypatch):
    rng = np.random.default_rng(11)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e4), (1e18, 0.0), (1e-25, 0.0)):
        x = rng.normal(size=(300, 5)) * scale + shift
        x[50:60] = x[3]                                     # ties
        y, own, ids = x[::7], np.arange(0, 300, 7), np.arange(300)
        exact = N.distances(y, x)
        exact[np.arange(len(y)), own] = np.inf
        for k, bound in ((4, np.full(len(y), np.inf)), (4, np.sort(exact, axis=1)[:, 6]), (400, np.full(len(y), np.inf))):
            at, to, far = N.k_nearest(y, own, bound, x, ids, k)
            want = [(i, j) for i in range(len(y)) for j in np.argsort(exact[i], kind="stable")[:k] if exact[i, j] <= bound[i] and np.isfinite(exact[i, j])]
            assert list(zip(at, to)) == want and np.array_equal(far, exact[at, to])
    seen, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(len(keys[0])) or lexsort(keys))
    monkeypatch.setattr(np, "argsort", None)                # all distances of a block were sorted before
    x = rng.normal(size=(2000, 5))
    N.k_nearest(x[:100], np.arange(100), np.full(100, np.inf), x, np.arange(2000), 4)
    assert sum(seen) < 100 * 50


def test_vectors_are_computed_before_any_filter_on_them(spark, monkeypatch):
    """The filter on the norm sank below the count of the words."""
    from linesight import session
    seen, plain = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df: seen.append(df.columns) or plain(df))
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0])]
    got = Sm.word_neighbours(spark.createDataFrame(rows, "word string, vector array<double>"), 2)
    assert seen[0] == ["word", "vector"]
    assert {r.tok: r.neighbours for r in got.collect()} == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "a"]}
