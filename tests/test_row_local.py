"""Row-local and skew-safe forms against their plain statements."""

from pyspark.sql import functions as F

from linesight.operators import attribution as At
from linesight.operators import cleaning as C
from linesight.operators import features as Fe
from linesight.operators import lines as L
from linesight.operators import sampling as Sm
from linesight.operators.profiling import length_reduce
from linesight.sources import readers as Rd
from linesight.sources import sinks as Sk


def test_split_labelled_lines_equals_array_contains(spark):
    docs = spark.createDataFrame(
        [(1, "a\n\nb", [0, 2, 2]), (2, "", [0]), (3, None, [0]), (4, "x\ny", None), (5, "p\nq\n", [2, 9]), (5, "p", [])],
        "doc_id long, text string, flaw_idx array<int>").withColumn("tag", F.col("doc_id") * 10)
    want = L.label_lines_by_index(L.split_lines(docs, keep=["tag", "flaw_idx"])).drop("flaw_idx")
    got = L.split_labelled_lines(docs, keep=["tag"])
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "line_idx", "line", "tag", "hit").collect())
    assert rows(got) == rows(want)


def test_spread_join_equals_join_and_splits_the_hot_token(spark):
    occ = spark.range(900).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("tok"))
    table = occ.where("tok <> 't1'").groupBy("tok").agg(F.count(F.lit(1)).alias("w"))
    want = sorted(tuple(r) for r in occ.join(table, "tok").select("doc_id", "pos", "tok", "w").collect())
    got = C._spread_join(occ, table, "doc_id", shares=30)
    assert sorted(tuple(r) for r in got.select("doc_id", "pos", "tok", "w").collect()) == want
    empty = C._spread_join(occ.where("false"), table, "doc_id")
    assert empty.count() == 0


def test_json_chunks_round_trip(spark, tmp_path):
    rows = [(i, f'q"{i}\\ é', None if i % 7 == 0 else "v\n" * (i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, name string, v string").repartition(3)
    Sk.write_json_arrays(df, str(tmp_path / "a"), chunk_bytes=200)
    back = Rd.read_json_records(spark, str(tmp_path / "a"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    Sk.write_json_keyed(df.drop("id"), str(tmp_path / "k"), "name", chunk_bytes=200)
    keyed = Rd.read_json_keyed(spark, str(tmp_path / "k"), spark.createDataFrame([], "v string").schema)
    assert sorted(map(tuple, keyed.select("key", "v").collect())) == sorted((n, v) for _, n, v in rows)
    Sk.write_json_arrays(df.where("false"), str(tmp_path / "e"))
    assert Rd.read_json_records(spark, str(tmp_path / "e"), df.schema).count() == 0


def test_report_layout(spark):
    df = spark.createDataFrame([("s%d\n", "a", None)], "s string, a string, p string")
    want = "Source Code:\ns%d\n\n" + "-" * 50 + "\nActual Vulnerable Lines:\na\n" + "=" * 50 + "\n\nPredicted Vulnerable Lines:\n\n" + "-" * 50
    assert Sk.report_blocks(df, "s", "a", "p").first()[0] == want


def test_positional_split_by_boundary_keys(spark):
    ids = [None, *range(0, 57, 3)]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.split for r in Sm.positional_split(df, "doc_id", 0.2).collect()}
    order = [None, *sorted(i for i in ids if i is not None)]
    want = {x: "test" if p >= 16 else "val" if p >= 12 else "train" for p, x in enumerate(order)}
    assert got == want
    assert {r.split for r in Sm.positional_split(df, "doc_id", 0.01).collect()} == {"train"}
    assert Sm.positional_split(df.where("false"), "doc_id").count() == 0


def test_exact_sample_draws_labelled_positives_only(spark):
    df = spark.createDataFrame([(i, i % 2, "3" if i % 4 == 1 else "" if i % 3 else None) for i in range(40)], "doc_id long, label int, idx string")
    got = Sm.exact_sample(df, "label", "doc_id", 7, {0: 5, 1: 100}, lines="idx").collect()
    assert sorted(r.doc_id for r in got if r.label == 1) == [i for i in range(40) if i % 4 == 1]
    assert sum(r.label == 0 for r in got) == 5


def test_length_reduce_without_rows_or_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert length_reduce(df).count() == 0


def test_vocabulary_vectors_are_zero_for_unknown_tokens(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "tok string, idx long")
    vec = spark.createDataFrame([("b", [1.0, 2.0]), ("z", [3.0, 3.0])], "word string, vector array<double>")
    got = sorted(tuple(r) for r in Fe.vocabulary_vectors(vocab, vec).select("idx", "vector").collect())
    assert got == [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 2.0])]


def test_attribution_finds_the_deciding_token(spark):
    docs = spark.createDataFrame([(1, "a b c bad d e f"), (2, "bad"), (3, ""), (4, None), (5, "good x y z")], "doc_id long, text string")
    w = spark.createDataFrame([("bad", 3.0), ("good", -3.0)], "tok string, weight double")
    out = At.attribute(docs, w, seed=5)
    rows = out.collect()
    best = {}
    for r in rows:
        if abs(r.weight) > abs(best.get(r.doc_id, (None, 0.0))[1]):
            best[r.doc_id] = (r.token, r.weight)
    assert best[1][0] == "bad" and best[1][1] > 0 and best[2][0] == "bad" and best[5][0] == "good" and best[5][1] < 0
    assert {r.doc_id for r in rows} == {1, 2, 5}
    again = At.attribute(docs.repartition(4), w, seed=5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
