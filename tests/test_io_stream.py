"""Round trips of the readers / writers and the streaming metrics."""

import os
import tempfile

from pyspark.sql import functions as F

from linesight.sources import readers as Rd
from linesight.sources import sinks as Sk


def _tmp():
    return tempfile.mkdtemp(prefix="linesight-io-test-")


def test_split_csv_round_trip_keeps_multiline_and_quotes(spark):
    rows = [(3, "p", 1, 'int f() {\n  return "a,b";\n}', "return \"a,b\";", "1"),
            (1, "p", 0, "x\r\ny", "", ""), (2, "q", 1, "", None, None)]
    df = spark.createDataFrame(rows, Rd.FUNCTION_SCHEMA)
    root = _tmp()
    paths = {}
    for name, ids in (("train", [1, 2]), ("test", [3])):
        paths[name] = os.path.join(root, name)
        Sk.write_table(df.where(F.col("index").isin(ids)), paths[name])
    back = {r["orig_index"]: r for r in Rd.read_splits(spark, paths).collect()}
    assert back[3]["processed_func"] == rows[0][3] and back[3]["split"] == "test"
    assert back[3]["index"] == 2 and back[1]["index"] == 0
    assert back[1]["flaw_line"] is None          # "" reads as null (CSV semantics)


def test_json_keyed_and_arrays(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "doc_id long, source string, n long")
    p1, p2 = _tmp() + "/k", _tmp() + "/a"
    Sk.write_json_keyed(df, p1, "doc_id")
    vs = "struct<source:string,n:long>"
    back = Rd.read_json_keyed(spark, p1, spark.createDataFrame([], vs).schema)
    assert sorted((r["key"], r["source"], r["n"]) for r in back.collect()) == [("1", "a", 5), ("2", "b", 7)]
    Sk.write_json_arrays(df, p2)
    arr = Rd.read_json_records(spark, p2, df.schema)
    assert sorted(tuple(r) for r in arr.collect()) == [(1, "a", 5), (2, "b", 7)]


def test_streaming_metrics_equal_batch(spark):

    from linesight.streaming.metrics_stream import document_metrics_plan, run_document_stream
    docs = spark.createDataFrame([(1, "a1\nbb\nc"), (2, "zz\n@x\n\ny9"), (3, "")], "doc_id long, text string")
    src = _tmp()
    docs.repartition(3).write.mode("overwrite").parquet(src + "/documents.parquet")
    out, ck = _tmp() + "/out", _tmp() + "/ck"
    run_document_stream(spark, src + "/documents*.parquet", "doc_id long, text string", out, ck,
                        document_metrics_plan())
    streamed = {r["doc_id"]: r.asDict() for r in spark.read.parquet(out).collect()}
    batch = {r["doc_id"]: r.asDict() for r in document_metrics_plan()(docs).collect()}
    assert streamed == batch and len(batch) == 3

