"""Per-document metrics against the loop oracle, on hand-written traps and
on random documents."""

import random

import pytest
from pyspark.sql import functions as F

from linesight.operators import lines as L
from linesight.operators import ranking as R
from tests import oracles as O

X = 10


def _docs(spark, rows):
    # rows: (doc_id, text, flaw_idx list, score per line list)
    data = [(d, t, f, s) for d, t, f, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, flaw_idx array<int>, scores array<double>")


def _metrics(spark, rows, x=X):
    df = _docs(spark, rows)
    ln = L.split_lines(df, keep=["flaw_idx", "scores"])
    ln = L.label_lines_by_index(ln, "flaw_idx")
    ln = ln.withColumn("score", F.element_at("scores", F.col("line_idx") + 1)) \
        .withColumn("n_labels", F.size("flaw_idx"))
    m = R.localization_metrics(R.rank_lines_by_score(ln), x=x)
    return {r["doc_id"]: r.asDict() for r in m.collect()}


def _expected(text, flaws, scores, x=X):
    lines = text.split("\n")
    order = sorted(range(len(lines)), key=lambda i: -(scores[i] or 0.0))  # stable
    return dict(top_x_accuracy=O.top_x_accuracy(order, flaws, x),
                top_x_precision=O.top_x_precision(order, flaws, x),
                top_x_recall=O.top_x_recall(order, flaws, x), rr=O.rr(order, flaws, x),
                ap=O.ap(order, flaws, x), ar=O.ar(order, flaws, x), ifa=O.ifa(order, flaws))


TRAPS = [
    (1, "a\nb\nc", [], [1.0, 2.0, 3.0]),                      # false positive: no labels
    (2, "a\n\nb\n", [1], [0.0, 0.0, 0.0, 0.0]),               # blank + trailing newline, equal scores
    (3, "x", [0], [5.0]),                                     # fewer lines than X
    (4, "p\nq\nr", [7], [1.0, 1.0, 1.0]),                     # label beyond the document
    (5, "\n".join("l%d" % i for i in range(25)), [3, 12, 24], [float(i % 5) for i in range(25)]),
    (6, "a\na\na", [0, 0, 2], [1.0, 1.0, 1.0]),               # duplicated label index
    (7, "", [0], [2.0]),                                      # empty document
]


def test_traps_match_loop_oracle(spark):
    got = _metrics(spark, TRAPS)
    for d, text, flaws, scores in TRAPS:
        exp = _expected(text, flaws, scores)
        for k, v in exp.items():
            assert got[d][k] == pytest.approx(v), (d, k, got[d][k], v)


def test_random_documents(spark):
    rng = random.Random(7)
    rows = []
    for d in range(60):
        n = rng.randint(1, 30)
        text = "\n".join(rng.choice(["", "x", "y = 1", "z"]) for _ in range(n))
        flaws = sorted(rng.sample(range(n + 3), rng.randint(0, min(5, n))))
        scores = [float(rng.randint(0, 4)) for _ in range(n)]
        rows.append((d, text, flaws, scores))
    got = _metrics(spark, rows)
    for d, text, flaws, scores in rows:
        exp = _expected(text, flaws, scores)
        for k, v in exp.items():
            assert got[d][k] == pytest.approx(v), (d, k)


def test_text_variant_counts_duplicates(spark):
    # generated ranking: predicted lines first (duplicates kept), rest in order
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 3, "")],
                                  "doc_id long, line_idx int, line string")
    preds = spark.createDataFrame([(1, 0, "b"), (1, 1, "zz"), (1, 2, "b")],
                                  "doc_id long, pred_pos int, line string")
    ranked = R.rank_lines_generated(lines, preds).orderBy("rank").collect()
    assert [r["line"] for r in ranked] == ["b", "zz", "b", "a", "a", ""]
    lab = spark.createDataFrame([(1, [""])], "doc_id long, flaw_text array<string>")
    r = R.rank_lines_generated(lines, preds).join(lab, "doc_id")
    r = L.label_lines_by_text(r, "flaw_text").withColumn("n_labels", F.size("flaw_text"))
    m = R.localization_metrics(r, recall_guard=False).first()
    # unlabelled document: the blank line is a hit (label list [""])
    assert m["ifa"] == 5 and m["top_x_accuracy"] == 1


def test_summary_rows(spark):
    m = spark.createDataFrame([(1, 1, 0.1, 0.5, 1.0, 1.0, 0.5, 0), (2, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 4),
                               (3, 1, 0.2, 1.0, 0.5, 0.75, 0.75, 1)],
                              "doc_id long, top_x_accuracy int, top_x_precision double, top_x_recall double, "
                              "rr double, ap double, ar double, ifa long")
    s = {r["type"]: r for r in R.metric_summary(m).where("type != 'Individual'").collect()}
    assert s["Average"]["ifa"] == pytest.approx(5 / 3)
    assert s["Median"]["ifa"] == 1.0 and s["Median"]["rr"] == 0.5


def test_row_local_metrics_equal_relational(spark):
    from linesight.operators.document_metrics import document_metrics
    rng = random.Random(3)
    rows = []
    for d in range(80):
        n = rng.randint(1, 25)
        lines = [rng.choice(["", "a", "bb", "ccc", "dd"]) for _ in range(n)]
        flaws = sorted(rng.choices(range(n + 2), k=rng.randint(0, 4)))
        rows.append((d, "\n".join(lines), flaws, [float(len(x)) for x in lines]))
    rows += [(100 + i, t, f, [float(len(x)) for x in t.split("\n")]) for i, (_, t, f, _s) in enumerate(TRAPS)]
    df = _docs(spark, rows).where(F.size("scores") == F.size(F.split("text", "\n", -1)))
    rel = _metrics(spark, [r for r in rows if len(r[3]) == len(r[1].split("\n"))])
    got = {r["doc_id"]: r.asDict() for r in document_metrics(df, lambda l: F.length(l)).collect()}
    assert set(got) == set(rel)
    for d, m in got.items():
        for k in m:
            assert m[k] == pytest.approx(rel[d][k]), (d, k)


def test_generated_row_local_equals_relational(spark):
    from linesight.operators.document_metrics import generated_metrics
    rng = random.Random(9)
    docs, preds, lines = [], [], []
    for d in range(50):
        n = rng.randint(1, 12)
        ls = [rng.choice(["", "a", "b", "c1", "d"]) for _ in range(n)]
        flaws = [x for x in ls if x.endswith("1")] or [""]
        docs.append((d, "\n".join(ls), flaws))
        lines += [(d, i, x) for i, x in enumerate(ls)]
        preds += [(d, j, rng.choice(ls + ["zz"])) for j in range(rng.randint(1, 4))]
    ddf = spark.createDataFrame(docs, "doc_id long, text string, flaw_text array<string>")
    pdf = spark.createDataFrame(preds, "doc_id long, pred_pos int, line string")
    ldf = spark.createDataFrame(lines, "doc_id long, line_idx int, line string")
    rel = R.rank_lines_generated(ldf, pdf).join(ddf.select("doc_id", "flaw_text"), "doc_id")
    rel = L.label_lines_by_text(rel, "flaw_text").withColumn("n_labels", F.size("flaw_text"))
    a = {r["doc_id"]: r.asDict() for r in R.localization_metrics(rel, recall_guard=False).collect()}
    b = {r["doc_id"]: r.asDict() for r in generated_metrics(ddf, pdf).collect()}
    assert a.keys() == b.keys()
    for d in a:
        for k in a[d]:
            assert b[d][k] == pytest.approx(a[d][k]), (d, k)
