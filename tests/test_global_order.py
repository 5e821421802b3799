"""Global orders: closed forms vs the sequential loops, and invariance to
the number of range partitions."""

import random

import pytest
from pyspark.sql import functions as F

from linesight.operators import global_order as G
from tests import oracles as O


def _case(rng, n_docs=25):
    rows = []
    for d in range(n_docs):
        n = rng.randint(1, 12)
        proba = rng.choice([0.5, 0.7, 0.9, rng.random()])
        for r in range(1, n + 1):
            rows.append((d, r - 1, r, float(rng.randint(0, 3)), int(rng.random() < 0.2), proba))
    return rows


def _df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, line_idx int, rank int, score double, hit int, proba double")


def _loop_orders(rows):
    # lines: score desc, stable over (document order, rank)
    by_doc = sorted(rows, key=lambda r: (r[0], r[2]))
    lines = sorted(by_doc, key=lambda r: -r[3])
    # functions: documents by proba desc (stable on doc order), then rank
    funcs = sorted(by_doc, key=lambda r: -r[5])
    return [r[4] for r in lines], [r[4] for r in funcs]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_effort_and_recall_match_loops(spark, seed):
    rng = random.Random(seed)
    rows = _case(rng)
    df = _df(spark, rows)
    flaws = sum(r[4] for r in rows) + rng.randint(0, 3)   # some flaws never ranked
    loc = len(rows) + rng.randint(0, 50)                  # negatives' lines count in LOC
    lines_h, funcs_h = _loop_orders(rows)
    lo = G.line_order_positions(df)
    fo = G.function_order_positions(df)
    for x in (1, 20, 50):
        e = G.effort_at_recall(lo, flaws, loc, x).first()["effort"]
        assert e == pytest.approx(O.effort_lines_order(lines_h, flaws, loc, x))
        e = G.effort_at_recall(fo, flaws, loc, x).first()["effort"]
        assert e == pytest.approx(O.effort_lines_order(funcs_h, flaws, loc, x))
        r = G.recall_at_loc(lo, flaws, loc, x).first()["recall"]
        assert r == pytest.approx(O.recall_lines_order(lines_h, flaws, loc, x))
        r = G.recall_at_loc(fo, flaws, loc, x).first()["recall"]
        assert r == pytest.approx(O.recall_lines_order(funcs_h, flaws, loc, x))


@pytest.mark.parametrize("seed", [4, 5])
def test_selection_equals_loops(spark, seed, monkeypatch):
    """Weighted selection down to a few rows: the same effort and recall, ties
    of every key included."""
    from linesight.operators import selection
    rng = random.Random(seed)
    rows = _case(rng, 40)
    df = _df(spark, rows).repartition(3)
    flaws, loc = sum(r[4] for r in rows) + rng.randint(0, 3), len(rows) + rng.randint(0, 50)
    monkeypatch.setattr(selection, "QUANTILES", 4)
    for order, hits in zip((G.LINES_ORDER, G.FUNCTIONS_ORDER), _loop_orders(rows), strict=True):
        for x, few in ((1, 1), (20, 5), (50, 1), (100, 30), (50, 10**6)):
            assert G.effort_of_order(df, order, flaws, loc, x, few=few) == pytest.approx(O.effort_lines_order(hits, flaws, loc, x))
            assert G.recall_of_order(df, order, flaws, loc, x, few=few) == pytest.approx(O.recall_lines_order(hits, flaws, loc, x))
    place = selection.find(df, G.LINES_ORDER, "hit", 10**9, False)
    assert (place.rows, place.found) == (len(rows), False)
    empty = df.limit(0)
    assert G.effort_of_order(empty, G.LINES_ORDER, 3, 10) == 0.0 and G.recall_of_order(empty, G.LINES_ORDER, 3, 10) == 0.0
    assert G.effort_of_order(df, G.LINES_ORDER, 0, 10) == 1.0 and G.recall_of_order(df, G.LINES_ORDER, 0, 10) is None


def test_no_flaws_effort_is_one_and_recall_is_null(spark):
    df = _df(spark, [(0, 0, 1, 1.0, 0, 0.5)])
    lo = G.line_order_positions(df)
    assert G.effort_at_recall(lo, 0, 10).first()["effort"] == 1.0
    assert G.recall_at_loc(lo, 0, 10).first()["recall"] is None


def test_positions_invariant_to_partitions(spark):
    rows = _case(random.Random(11), 40)
    df = _df(spark, rows)
    keys = [F.col("score").desc(), F.col("doc_id"), F.col("rank")]
    a = {(r["doc_id"], r["rank"]): (r["pos"], r["cum_hits"])
         for r in G.with_global_position(df, keys, partitions=1).collect()}
    b = {(r["doc_id"], r["rank"]): (r["pos"], r["cum_hits"])
         for r in G.with_global_position(df.repartition(7), keys, partitions=7).collect()}
    assert a == b
    assert sorted(p for p, _ in a.values()) == list(range(1, len(rows) + 1))


def test_append_negatives_continue_positions(spark):
    df = _df(spark, [(0, 0, 1, 2.0, 1, 0.9), (0, 1, 2, 1.0, 0, 0.9)])
    lo = G.line_order_positions(df)
    neg = spark.createDataFrame([(5, 0), (5, 1), (3, 0)], "doc_id long, line_idx int")
    out = {(r["doc_id"], r["line_idx"]): (r["pos"], r["hit"], r["cum_hits"])
           for r in G.append_negatives(lo, neg).collect()}
    assert out[(3, 0)] == (3, 0, 1) and out[(5, 1)] == (5, 0, 1)


def test_no_single_partition_window_in_plan(spark):
    df = _df(spark, _case(random.Random(5)))
    plan = G.line_order_positions(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
