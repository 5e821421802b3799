"""Text functions against Python's own string/regex semantics."""

from pyspark.sql import functions as F

from linesight.functions import text as T

SAMPLES = [
    "", "a", "a\n", "\n\na\n", "int x = 1;\r\nint y;", "x y　z  w\tq",
    'printf("100 $ %d", 42); // note\n/* block\n comment */ return 0;',
    "#include <stdio.h>\n  #include \"a.h\"\r\nint main() {}\n",
    "  lead and trail  \n\n   \nend", "It's 'quoted' and \"double\" 12a 3 b4",
    "a\x1cb\x1d\x1e c\x1f", "\x1f lead\x1c\ntail\x1d",
]


def _run(spark, col_fn):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("t"))).collect()]


def test_split_lines_matches_python(spark):
    assert _run(spark, T.split_lines) == [s.split("\n") for s in SAMPLES]


def test_normalize_whitespace_unicode(spark):
    assert _run(spark, T.normalize_whitespace) == ["".join(s.split()) for s in SAMPLES]


def test_word_tokens_no_empties(spark):
    assert _run(spark, T.word_tokens) == [s.split() for s in SAMPLES]


def _pairs(spark, col_fn, pairs):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(col_fn(F.col("t"))).collect()] == [b for _, b in pairs]


def test_mask_literals(spark):
    _pairs(spark, T.mask_literals, [
        ("", ""), ("It's 'quoted' and \"double\"", 'It"STR$ID"quoted\' and "STR$ID"'),
        ('printf("100 $ %d", 42);', 'printf("STR$ID", NUM%ID);'), ("12a 3 b4", "12a NUM%ID b4"),
        ("x = 'a\nb'", "x = 'a\nb'"), ('s = "a\nb"', 's = "STR$ID"')])


def test_strip_includes_comments_blank_lines(spark):
    _pairs(spark, T.strip_includes, [
        ("#include <stdio.h>\n  #include \"a.h\"\nint main() {}\n", "int main() {}\n"),
        ("a\n#include <b>", "a\n"), ("x #include <b>\n", "x #include <b>\n"), ("", "")])
    _pairs(spark, T.strip_comments, [
        ("a // note\nb", "a \nb"), ("/* one\n two */c", "c"), ("d /* e */ f // g", "d  f "), ("1 / 2", "1 / 2")])
    _pairs(spark, T.strip_blank_lines, [
        ("\n\na\n", "a\n"), ("a\n  \n\t\nb", "a\nb"), ("a", "a"), ("a\n", "a\n")])


def test_parse_and_encode_int_lists(spark):
    df = spark.createDataFrame([(None,), ("",), ("36,37,40",), ("5",)], "s string")
    got = [r[0] for r in df.select(T.parse_int_list("s")).collect()]
    assert got == [[], [], [36, 37, 40], [5]]
    enc = df.select(T.encode_ints(T.parse_int_list("s"))).collect()
    assert [r[0] for r in enc] == ["", "", "36,37,40", "5"]


def test_strip_lines_and_same_prefix(spark):
    got = _run(spark, lambda c: T.strip_lines(T.split_lines(c)))
    assert got == [[x.strip() for x in s.split("\n") if x.strip()] for s in SAMPLES]
    df = spark.createDataFrame([("abc\r\n", " abcdef"), ("abc", "abd")], "a string, b string")
    assert [r[0] for r in df.select(T.same_prefix("a", "b")).collect()] == [True, False]
