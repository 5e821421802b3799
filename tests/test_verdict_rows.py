"""Rows that the driver tables never hold: blank lines, literals, null classes."""

from linesight.operators import budget as Bu
from linesight.operators import sampling as Sa
from linesight.operators import scores as Sc


def test_segment_sum_of_lines_without_tokens(spark):
    ranges = Sc.line_token_ranges(spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 1), (1, 3, 0)], "doc_id long, line_idx int, n_tok int"))
    scores = spark.createDataFrame([(1, 0, 10.0), (1, 1, 20.0), (1, 2, 30.0)], "doc_id long, tok_pos int, score double")
    got = {r.line_idx: r.score for r in Sc.segment_sum(scores, ranges).collect()}
    assert got == {0: 30.0, 1: 0.0, 2: 30.0, 3: 0.0}


def test_budget_metadata_literals(spark):
    rows = [
        ("{'codet5': {'vul_line_within_128': True, 'note': \"it's\"}}", True),
        ('{"codet5": {"vul_line_within_128": true}}', True),
        ('{"codet5": {"vul_line_within_128": "True"}}', True),
        ("{'codet5': {'vul_line_within_128': 'true'}}", True),
        ("{'codet5': {'vul_line_within_128': False, 'note': \"'vul_line_within_128': True\"}}", False),
        ("{'codet5': {'vul_line_within_128': None}}", False),
        ("{'bert': {'vul_line_within_128': True}}", False),
        ("{'codet5': [1", False), ("[1, 2]", False), ("", False), (None, False)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(rows)], "i int, metadata string")
    got = [r.is_within_128 for r in Bu.parse_budget_metadata(df).orderBy("i").collect()]
    assert got == [x for _, x in rows]


def test_null_class_is_a_class_of_its_own(spark):
    rows = [(i, None if i < 10 else "a") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, label string")
    over = Sa.oversample(df, "label", "id", 1)
    assert {r.label: r["count"] for r in over.groupBy("label").count().collect()} == {None: 40, "a": 40}
    assert {r.id for r in over.where("label is null").collect()} <= set(range(10))
    under = Sa.undersample(df, "label", "id", 1, ratio=2.0)
    assert {r.label: r["count"] for r in under.groupBy("label").count().collect()} == {None: 10, "a": 20}
    half = Sa.undersample(df, "label", "id", 1, ratio=None, fraction=0.1)
    assert {r.label: r["count"] for r in half.groupBy("label").count().collect()} == {None: 10, "a": 4}
    split = Sa.stratified_split(df, "label", "id", 1).collect()
    assert sorted(r.id for r in split) == list(range(50))


def test_longest_common_subsequence():
    import random

    from linesight.operators import rouge as Rg
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        hits = sorted(Rg._lcs_table_hits(a, b))
        assert Rg._lcs(a, b) == table[-1][-1] == len(hits)
        it = iter(b)
        assert all(any(y == a[i] for y in it) for i in hits)


def test_rouge_by_hand(spark):
    from linesight.operators import rouge as Rg
    df = spark.createDataFrame([(1, "a b c", "a b d e"), (2, "", "x"), (3, None, None), (4, "x x y", "x y y")], "doc_id long, p string, r string")
    got = {r.doc_id: (round(r.rouge1_f, 6), round(r.rouge2_f, 6)) for r in Rg.rouge_n(df, "p", "r", n=(1, 2)).collect()}
    assert got == {1: (round(4 / 7, 6), 0.4), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (round(4 / 6, 6), 0.5)}
    lcs = {r.doc_id: round(r.rougeL_f, 6) for r in Rg.rouge_l(df, "p", "r").collect()}
    assert lcs == {1: round(4 / 7, 6), 2: 0.0, 3: 0.0, 4: round(4 / 6, 6)}
    mean = Rg.rouge_means(Rg.rouge_n(df, "p", "r", n=(1, 2))).first()
    assert round(mean.rouge2_f, 6) == 0.225
