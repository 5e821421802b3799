"""Published per-seed results (re-typed from the study's result files:
accuracy, MRR, median IFA, Effort@20%Recall per seed) reproduce the
published means, spreads and the significance verdict."""

import os
import tempfile

import pytest

from linesight.operators import runs as U
from linesight.sources import readers as Rd

# Published per-seed results, seed -> (accuracy, MRR, median IFA, effort).
GENERATED = {123: (83.4, 79.4, 0, 0.6), 123456: (82.9, 79.5, 0, 0.5), 135: (82.9, 78.6, 0, 0.559),
             345678: (84.0, 80.9, 0, 0.6), 456: (81.9, 79.1, 0, 0.6), 567890: (83.1, 79.7, 0, 0.6),
             680: (82.3, 79.0, 0, 0.53), 789: (83.9, 80.0, 0, 0.611), 789012: (81.0, 77.7, 0, 0.5),
             901234: (82.5, 79.9, 0, 0.6)}
ATTENTION = {123: (70.9, 43.6, 2, 0.6), 123456: (71.6, 43.7, 2, 0.6), 135: (70.7, 43.6, 2, 0.633),
             345678: (72.4, 44.1, 2, 0.6), 456: (71.4, 43.2, 2, 0.6), 567890: (71.9, 43.8, 2, 0.6),
             680: (71.7, 44.0, 2, 0.616), 789: (71.6, 43.8, 2, 0.644), 789012: (70.0, 42.7, 2, 0.6),
             901234: (71.6, 43.5, 2, 0.6)}
METRICS = ["accuracy", "MRR", "Median_IFA", "EffortRecall"]


@pytest.fixture(scope="module")
def runs(spark):
    root = tempfile.mkdtemp(prefix="linesight-runs-")
    for method, table in (("generated", GENERATED), ("attention", ATTENTION)):
        os.makedirs(os.path.join(root, method))
        for seed, vals in table.items():
            with open(os.path.join(root, method, f"{seed}.csv"), "w") as f:
                f.write(",".join(METRICS) + "\n" + ",".join(str(v) for v in vals) + "\n")
        with open(os.path.join(root, method, "avg.csv"), "w") as f:   # stored average: skipped
            f.write(",".join(METRICS) + "\n1,1,1,1\n")
    schema = "accuracy double, MRR double, Median_IFA double, EffortRecall double"
    df = Rd.read_runs(spark, root, schema)
    from pyspark.sql import functions as F
    return df.withColumn("method", F.regexp_extract(F.col("_metadata.file_path"), r"/(\w+)/[^/]+$", 1))


def test_means_and_spread(runs):
    avg = {r["method"]: r for r in U.average_runs(runs, METRICS, ["method"]).collect()}
    assert avg["generated"]["accuracy"] == pytest.approx(82.79)
    assert avg["attention"]["accuracy"] == pytest.approx(71.38)
    assert avg["generated"]["MRR"] == pytest.approx(79.38)
    assert avg["attention"]["MRR"] == pytest.approx(43.60)
    d = {(r["method"], r["metric"]): r for r in U.describe_runs(runs, METRICS, ["method"]).collect()}
    assert d[("generated", "accuracy")]["count"] == 10
    assert round(d[("generated", "accuracy")]["std"], 2) == 0.91
    assert round(d[("attention", "accuracy")]["std"], 2) == 0.68
    assert d[("attention", "Median_IFA")]["p50"] == 2.0


def test_wilcoxon_generated_beats_attention(runs):
    from pyspark.sql import functions as F
    r = runs.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)\.csv$", 1))
    pairs = U.pair_runs(r.select("method", "run", *METRICS), METRICS, "method", "generated", "attention")
    out = {x["metric"]: x for x in U.wilcoxon_signed_rank(
        pairs, less_metrics=("Median_IFA", "EffortRecall")).collect()}
    acc = out["accuracy"]
    assert acc["n"] == 10 and acc["w_plus"] == 55.0 and acc["exact"]
    assert acc["p_value"] == pytest.approx(1 / 1024) and acc["significant"]
    assert out["Median_IFA"]["alternative"] == "less" and out["Median_IFA"]["significant"]
