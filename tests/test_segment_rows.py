"""Line scores summed inside the row against the relational form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesight.operators import scores as Sc

ROWS = [
    (1, [1.0, 2.0, 4.0, 8.0], [1, 0, 2, 1]),
    (2, [], [2, 0]),                      # tokens of its lines were never scored
    (3, [0.5, None, 0.25], [2, None, 3]),  # runs past the scored tokens
    (4, None, [1]),
    (5, [3.0], None),
    (6, [3.0], []),
    (7, [16.0] * 9, [0, 0, 4, 0, 5, 0]),
    (7, [1.0], [1]),                      # an id twice: each row by itself
]
SCHEMA = "doc_id long, scores array<double>, n_tok array<int>"


def expected(rows, offset):
    out = []
    for doc, scores, counts in rows:
        at = offset
        for line, n in enumerate(counts or []):
            n = n or 0
            out.append((doc, line, sum((scores[p] or 0.0) for p in range(at, at + n)
                                       if 0 <= p < len(scores or []))))
            at += n
    return sorted(out)


@pytest.mark.parametrize("offset", [0, 1, -1, 3])
def test_rows_equal_the_loop(spark, offset):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = sorted(tuple(r) for r in Sc.segment_sum_rows(df, offset=offset).collect())
    assert got == expected(ROWS, offset)


def test_rows_equal_the_relation_on_random_documents(spark):
    rng = np.random.default_rng(3)
    rows = [(d, rng.integers(0, 64, rng.integers(0, 40)).astype(float).tolist(),
             rng.integers(0, 4, rng.integers(1, 15)).tolist()) for d in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    tokens = df.select("doc_id", F.posexplode("scores").alias("tok_pos", "score"))
    lines = df.select("doc_id", F.posexplode("n_tok").alias("line_idx", "n_tok"))
    relation = Sc.segment_sum(tokens, Sc.line_token_ranges(lines), offset=1)
    got = sorted(tuple(r) for r in Sc.segment_sum_rows(df, offset=1).collect())
    assert got == sorted(tuple(r) for r in relation.collect())


def test_no_rows_and_no_exchange(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = Sc.segment_sum_rows(df)
    assert out.count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
