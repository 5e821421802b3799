"""Hand-written rows the fixtures list calls for: metadata parser fallbacks,
null categories in the hold-out split, the two similarity-replacement
variants, token budgets."""



from linesight.operators import budget as Bu
from linesight.operators import filters as Fl
from linesight.operators import generated as Gn


def test_metadata_parser_fallbacks(spark):
    rows = [(1, '{"codet5": {"vul_line_within_128": true}}'),
            (2, "{'codet5': {'vul_line_within_128': True, 'index_128': None}}"),
            (3, '{"codet5": {"vul_line_within_128": "true"}}'),
            (4, "{broken"), (5, None), (6, '{"codet5": {"vul_line_within_128": false}}')]
    df = spark.createDataFrame(rows, "id int, metadata string")
    got = {r["id"]: r["is_within_128"] for r in Bu.parse_budget_metadata(df).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    missing = Bu.parse_budget_metadata(df.drop("metadata"), "metadata").collect()
    assert all(r["is_within_128"] is False for r in missing)


def test_holdout_keeps_null_category_in_train(spark):
    df = spark.createDataFrame([(1, "CWE-79"), (2, None), (3, "CWE-20")], "id int, cwe string")
    train, test = Fl.holdout_split(df, "cwe", ["CWE-79"])
    assert sorted(r["id"] for r in train.collect()) == [2, 3]
    assert [r["id"] for r in test.collect()] == [1]


def test_similarity_replacement_variants(spark):
    lines = spark.createDataFrame([(1, 0, "int a = 0;"), (1, 1, "return a + b;"), (1, 2, "")],
                                  "doc_id long, line_idx int, line string")
    single = spark.createDataFrame([(1, 0, "return a+b ;")], "doc_id long, pred_pos int, line string")
    a = Gn.similar_line_replace(single, lines, skip_last=True).first()
    assert a["line"] == "return a+b ;" and a["replaced"] == 0      # (a) the last line is kept
    b = Gn.similar_line_replace(single, lines, skip_last=False, drop_blank=True).first()
    assert b["replaced"] == 1 and b["line"] in ("return a + b;", "int a = 0;")
    two = spark.createDataFrame([(1, 0, "a = 0"), (1, 1, "   "), (1, 2, "return a + b;")],
                                "doc_id long, pred_pos int, line string")
    out = {r["pred_pos"]: r for r in Gn.similar_line_replace(two, lines, skip_last=False,
                                                              drop_blank=True).collect()}
    assert set(out) == {0, 2}                                       # blank prediction dropped
    assert out[0]["line"] == "int a = 0;" and out[2]["replaced"] == 0
    flags = {r["doc_id"]: r["hallucinated"] for r in Gn.hallucination_flag(two, lines).collect()}
    assert flags == {1: 1}


def test_budget_index_and_flags(spark):
    text = "\n".join(["w " * 60, "w " * 60, "w " * 60])
    df = spark.createDataFrame([(1, text, [1]), (2, text, [3]), (3, "short", [])],
                               "doc_id long, text string, flaw_line_no array<int>")
    idx = {r["doc_id"]: r["i"] for r in df.select("doc_id", Bu.budget_index("text").alias("i")).collect()}
    assert idx[1] == 2 and idx[3] == 1        # 61 + 61 <= 126 < 183
    f = {r["doc_id"]: r["metadata"] for r in Bu.budget_flags(df, "text", "flaw_line_no").collect()}
    assert f[1]["bert"]["vul_line_within_128"] and not f[2]["bert"]["vul_line_within_128"]
    assert f[3] is None
    assert not f[1]["bert"]["under_128_tokens"]



def test_row_local_similarity_replacement_equals_relational(spark):
    import random
    rng = random.Random(12)
    vocab = ["int", "a", "b", "=", "0;", "return", "x", "A", "if", "(x)"]
    docs, lines, preds = [], [], []
    for d in range(40):
        ls = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 8))]
        docs.append((d, "\n".join(ls)))
        lines += [(d, i, x) for i, x in enumerate(ls)]
        for j in range(rng.randint(1, 4)):
            cand = rng.choice(ls) if rng.random() < 0.4 else " ".join(rng.choice(vocab) for _ in range(3))
            preds.append((d, j, rng.choice([cand, "   ", cand])))
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    ldf = spark.createDataFrame(lines, "doc_id long, line_idx int, line string")
    pdf = spark.createDataFrame(preds, "doc_id long, pred_pos int, line string")
    for skip, blank in ((True, False), (False, True)):
        a = {(r["doc_id"], r["pred_pos"]): (r["line"], r["replaced"])
             for r in Gn.similar_line_replace(pdf, ldf, skip_last=skip, drop_blank=blank).collect()}
        b = {(r["doc_id"], r["pred_pos"]): (r["line"], r["replaced"])
             for r in Gn.similar_line_replace_rows(ddf, pdf, skip_last=skip, drop_blank=blank).collect()}
        assert a == b
