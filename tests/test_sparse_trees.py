"""Sparse trees against MLlib's, and what their rows hold."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from linesight.operators import features as Fe
from linesight.operators import sparse_trees as St


def table(spark, n=400, width=30, classes=2, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.poisson(0.4, width) * (1 + (rng.random(width) < 0.1) * rng.integers(1, 60, width))
        y = int((x[0] > 0) + (x[3] > 2) + (rng.random() < 0.1)) % classes
        at = np.flatnonzero(x)
        rows.append((i, float(y), Vectors.sparse(width, at.tolist(), x[at].astype(float).tolist())))
    return spark.createDataFrame(rows, ["doc_id", "label", "features"])


@pytest.mark.parametrize("classes", [2, 3])
def test_a_deep_tree_is_mllibs(spark, classes, monkeypatch):
    monkeypatch.setattr(St, "HELD", 50)      # sums leave the tasks several times
    df = table(spark, classes=classes).repartition(3)
    ours = Fe.classifier("dt").fit(df).transform(df).select("doc_id", F.col("prediction").alias("a"), vector_to_array("probability").alias("pa"))
    theirs = DecisionTreeClassifier(maxDepth=30, labelCol="label").fit(df).transform(df).select(
        "doc_id", F.col("prediction").alias("b"), vector_to_array("probability").alias("pb"))
    got = ours.join(theirs, "doc_id").collect()
    assert len(got) == 400
    assert all(r.a == r.b and np.allclose(r.pa, r.pb) for r in got)


def test_a_forest_learns_and_repeats(spark):
    df = Fe.with_class_weights(table(spark), "label")
    test = table(spark, n=200, seed=4)

    def run(d):
        return {r.doc_id: (r.prediction, r.p) for r in Fe.classifier("rf", weight="weight").fit(d).transform(test)
                .select("doc_id", "prediction", F.round(vector_to_array("probability")[1], 6).alias("p")).collect()}
    a = run(df.repartition(3))
    truth = {r.doc_id: r.label for r in test.collect()}
    assert np.mean([a[i][0] == truth[i] for i in truth]) > 0.8
    assert a == run(df.repartition(5))        # the samples follow the ids, not the partitions


def test_wide_rows_are_not_made_dense(spark):
    """Two entries a row among ten million features: a dense row of bins would take 40 MB."""
    rows = [(i, float(i % 2), Vectors.sparse(10_000_000, [i % 2, 5_000_000 + i], [1.0, 2.0])) for i in range(200)]
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    got = Fe.classifier("dt").fit(df).transform(df).where("prediction <> label").count()
    assert got == 0


def test_one_class_and_no_features(spark):
    df = spark.createDataFrame([(i, 0.0, Vectors.sparse(0, [], [])) for i in range(3)], ["doc_id", "label", "features"])
    assert [r.prediction for r in Fe.classifier("dt").fit(df).transform(df).collect()] == [0.0] * 3


def test_split_points():
    assert St.thresholds_of([1.0, 3.0], [2.0, 1.0], 5.0, 32) == [0.5, 2.0]
    assert St.thresholds_of([1.0, 3.0], [2.0, 1.0], 0.0, 32) == [2.0]
    many = St.thresholds_of([float(i) for i in range(1, 101)], [1.0] * 100, 0.0, 32)
    assert len(many) <= 31 and many == sorted(many)
