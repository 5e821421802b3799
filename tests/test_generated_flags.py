"""Flags of the generated ranking made inside the row equal the relational form."""

from pyspark.sql import functions as F

from linesight.operators import global_order as G
from linesight.operators import lines as L
from linesight.operators import ranking as R
from linesight.operators.document_metrics import generated_flags

DOCS = [(0, "a\nb1\n\nb1\nc", ["b1"], 0.5), (1, "x\ny\n", [""], 0.5), (2, "only", [""], 0.9), (3, "k1\nk2", ["k1", "k2"], 0.1)]
PREDS = [(0, 0, "c"), (0, 1, "foreign"), (0, 2, "b1"), (1, 0, ""), (3, 0, "k2"), (3, 1, "k2")]


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, flaw_text array<string>, proba double")
    return docs, spark.createDataFrame(PREDS, "doc_id long, pred_pos int, line string")


def test_flags_equal_the_relational_ranking(spark):
    docs, preds = tables(spark)
    ranked = R.rank_lines_generated(L.split_lines(docs.select("doc_id", "text")), preds)
    ranked = L.label_lines_by_text(ranked.join(docs.select("doc_id", "flaw_text", "proba"), "doc_id"), "flaw_text")
    cols = ["doc_id", "rank", "is_predicted", "hit", "proba"]
    flags = generated_flags(docs, preds, keep=["proba"])
    assert sorted(map(tuple, flags.select(cols).collect())) == sorted(map(tuple, ranked.select(cols).collect()))
    order = G.generated_order_positions(ranked)
    for flaws, loc in ((4.0, 12.0), (0.0, 12.0), (100.0, 300.0)):
        want = G.effort_at_recall(order, flaws, loc, 20.0).first()[0], G.recall_at_loc(order, flaws, loc, 10.0).first()[0]
        assert want == (G.effort_of_order(flags, G.GENERATED_ORDER, flaws, loc, 20.0), G.recall_of_order(flags, G.GENERATED_ORDER, flaws, loc, 10.0))


def test_the_lines_are_not_shuffled(spark):
    docs, preds = tables(spark)
    plan = generated_flags(docs, preds, keep=["proba"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "Generate" in plan and plan.index("Generate") < plan.index("Join")     # lines come last, above the join
