import os
import random

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from linesight.llm.queries import ORACLES, QUERIES
from tests.llm.data import awkward, documents, sentence
from tests.llm.test_near_dedup import brute_force as components
from tests.llm.test_packing import check
from tests.llm.test_sharding_lines import brute_force as without_windows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    rel = con.sql(ORACLES[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    own = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    place = [rel.columns.index(c) for c in order]
    assert own == sorted((tuple(r[p] for p in place) for r in rel.fetchall()), key=str) and own


@needs_data
def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = {}
    for name, stage in C.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        steps[name] = ({r.doc_id: r.text for r in docs.collect()}, out.collect())
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    before, after = steps["language_id"]
    assert len(after) >= 0.99 * len(before)
    before, after = steps["line_dedup"]
    want = {i: t for i, (t, _, gone) in without_windows(sorted(before.items())).items() if not gone or t.strip(" ")}
    assert {r.doc_id: r.text for r in after} == want
    before, after = steps["near_dedup"]
    assert {r.doc_id for r in after} == {i for i, (_, _, kept) in components(before.items()).items() if kept}
    before, after = steps["packing"]
    check(after, list(before), list(before.values()))
    assert set(before) <= set(steps["decontamination"][0])


def test_pipeline_awkward_rows(spark):
    ids, texts = awkward()
    rng = random.Random(1)
    texts += [sentence(rng, 40) for _ in range(60)]
    ids += list(range(100, 160))
    docs = documents(spark, texts, ids)
    kept = C.drop_near_duplicates(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i in set(ids) - {6})
    for name, stage in C.STAGES[:2] + C.STAGES[3:4] * os.path.exists(DATA):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() <= len(ids), name
    empty = documents(spark, [])
    for name, stage in C.STAGES[:3] + C.STAGES[3:] * os.path.exists(DATA):
        assert stage(spark, empty, DATA).count() == 0, name
