"""Both methods' metrics are made in the document row and equal the relational form."""

from pyspark.sql import functions as F

from linesight.operators import lines as L
from linesight.operators import ranking as R
from linesight.plans import bindings as B
from linesight.plans.runs import method_doc_metrics

SF = "/root/testdata/sf0.001"


def test_metrics_equal_the_relational_form_without_a_shuffle(spark):
    got = method_doc_metrics(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    f = B.function_table(spark, SF)
    ln = L.split_labelled_lines(f.withColumn("n_labels", F.size("flaw_idx")), keep=["n_labels", "project"])
    ln = ln.select("doc_id", "project", "line_idx", F.length("line").cast("double").alias("score"), "hit", "n_labels")
    by_score = R.rank_lines_by_score(ln).withColumn("method", F.lit("score"))
    by_pos = ln.withColumn("rank", F.col("line_idx") + 1).withColumn("method", F.lit("position"))
    want = R.localization_metrics(by_score.unionByName(by_pos), carry=["method", "project"])
    cols = ["method", "project", "doc_id", "top_x_accuracy", "top_x_precision", "top_x_recall", "rr", "ap", "ar", "ifa"]

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(cols).collect())
    assert rows(got) == rows(want)
