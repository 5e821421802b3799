"""Step 4: text cleaning, token pruning, list encodings and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.functions import text as T
from linesight.operators import cleaning as Cl
from linesight.operators import filters as Fl
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register

MASK_SQL = ("regexp_replace(regexp_replace(text, '(\"[^\"]*\"|''.*?'')', '\"STR$ID\"', 'g'), "
            "'\\b\\d+\\b', 'NUM%ID', 'g')")
CLEAN_SQL = ("regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace("
             + MASK_SQL + ", '(?m)^\\s*#include\\s+.+?(\\n|$)', '', 'g'), '//.*', '', 'g'), "
             "'/\\*[\\s\\S]*?\\*/', '', 'g')), '(?m)^\\s*\\n', '', 'g')")
TOKS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def _docs(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


@register("normalize_whitespace", sql="""
SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS norm FROM documents""")
def q_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.normalize_whitespace("text").alias("norm"))


@register("text_prefix", sql="""
SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), 1, 150) AS prefix
FROM documents""")
def q_prefix(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.text_prefix(T.normalize_whitespace("text"))
                                       .alias("prefix"))


@register("word_tokens", sql=f"""
SELECT doc_id, CAST(len({TOKS.format(x='text')}) AS BIGINT) AS n_tokens,
       array_to_string({TOKS.format(x='text')}, ' ') AS tokens FROM documents""")
def q_word_tokens(spark, sf_dir):
    t = T.word_tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"),
                                       F.array_join(t, " ").alias("tokens"))


@register("mask_literals", sql=f"SELECT doc_id, {MASK_SQL} AS masked FROM documents")
def q_mask(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.mask_literals("text").alias("masked"))


@register("strip_includes", sql="""
SELECT doc_id, regexp_replace(text, '(?m)^\\s*#include\\s+.+?(\\n|$)', '', 'g') AS text FROM documents""")
def q_strip_includes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_includes("text").alias("text"))


@register("strip_comments", sql="""
SELECT page_id, regexp_replace(regexp_replace(html, '//.*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g')
       AS html FROM pages""")
def q_strip_comments(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", T.strip_comments("html").alias("html"))


@register("lower_text", sql="SELECT doc_id, lower(text) AS text FROM documents")
def q_lower(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.lower_text("text").alias("text"))


@register("strip_blank_lines", sql="""
SELECT conv_id, turn, regexp_replace(text, '(?m)^\\s*\\n', '', 'g') AS text FROM conversations""")
def q_strip_blank(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.select("conv_id", "turn", T.strip_blank_lines("text").alias("text"))


@register("strip_lines", sql="""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, array_to_string(l, chr(10)) AS lines FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
                                            lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                             lambda x: x <> '') AS l
  FROM documents WHERE text IS NOT NULL)""")
def q_strip_lines(spark, sf_dir):
    arr = T.strip_lines(T.split_lines("text"))
    return _docs(spark, sf_dir).where(F.col("text").isNotNull()).select(
        "doc_id", F.size(arr).alias("n_lines"), F.array_join(arr, "\n").alias("lines"))


_CLEANED = f"""
WITH cleaned AS (SELECT doc_id, {CLEAN_SQL} AS text FROM documents),
occ AS (SELECT doc_id, unnest({TOKS.format(x='text')}) AS tok,
               unnest(generate_series(1, len({TOKS.format(x='text')}))) AS pos FROM cleaned),
cnt AS (SELECT tok, count(*) AS c FROM occ GROUP BY tok),
kept1 AS (SELECT o.* FROM occ o JOIN cnt USING (tok) WHERE cnt.c >= 10),
cnt2 AS (SELECT tok, count(*) AS c FROM kept1 GROUP BY tok),
kept2 AS (SELECT k.* FROM kept1 k JOIN cnt2 USING (tok) WHERE cnt2.c < 10479)"""


@register("clean_source", sql=_CLEANED + """
SELECT c.doc_id, coalesce(string_agg(k.tok, ' ' ORDER BY k.pos), '') AS text
FROM cleaned c LEFT JOIN kept2 k USING (doc_id) GROUP BY c.doc_id""")
def q_clean_source(spark, sf_dir):
    cleaned, _ = Cl.clean_source(_docs(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "text")


@register("clean_token_counts", sql=_CLEANED + """
SELECT tok, CAST(c AS BIGINT) AS count FROM cnt""")
def q_clean_counts(spark, sf_dir):
    _, counts = Cl.clean_source(_docs(spark, sf_dir).select("doc_id", "text"))
    return counts


@register("remove_rare_tokens", sql=f"""
WITH occ AS (SELECT doc_id, unnest({TOKS.format(x='text')}) AS tok,
                    unnest(generate_series(1, len({TOKS.format(x='text')}))) AS pos FROM documents),
cnt AS (SELECT tok, count(*) AS c FROM occ GROUP BY tok)
SELECT d.doc_id, coalesce(string_agg(o.tok, ' ' ORDER BY o.pos) FILTER (WHERE cnt.c >= 10), '') AS text
FROM documents d LEFT JOIN occ o USING (doc_id) LEFT JOIN cnt USING (tok) GROUP BY d.doc_id""")
def q_rare(spark, sf_dir):
    return Cl.remove_rare_tokens(_docs(spark, sf_dir).select("doc_id", "text"))


@register("remove_frequent_tokens", sql=f"""
WITH occ AS (SELECT doc_id, unnest({TOKS.format(x='text')}) AS tok,
                    unnest(generate_series(1, len({TOKS.format(x='text')}))) AS pos FROM documents),
cnt AS (SELECT tok, count(*) AS c FROM occ GROUP BY tok)
SELECT d.doc_id, coalesce(string_agg(o.tok, ' ' ORDER BY o.pos) FILTER (WHERE cnt.c < 10479), '') AS text
FROM documents d LEFT JOIN occ o USING (doc_id) LEFT JOIN cnt USING (tok) GROUP BY d.doc_id""")
def q_frequent(spark, sf_dir):
    return Cl.remove_frequent_tokens(_docs(spark, sf_dir).select("doc_id", "text"))


_FLAWS = S.TEST + """,
fl AS (
  SELECT t.doc_id, t.target,
         string_agg(CAST(s.line_idx AS VARCHAR), ',' ORDER BY s.line_idx)
           FILTER (WHERE s.hit = 1) AS idx,
         string_agg(s.line, '/~/' ORDER BY s.line_idx) FILTER (WHERE s.hit = 1) AS lines
  FROM testset t JOIN tscored s USING (doc_id) GROUP BY t.doc_id, t.target
)"""


@register("encode_lists", sql=_FLAWS + """
SELECT doc_id, coalesce(idx, '') AS flaw_line_index, coalesce(lines, '') AS flaw_line FROM fl""")
def q_encode(spark, sf_dir):
    t = B.test_set(spark, sf_dir)
    return t.select("doc_id", "flaw_line_index", T.encode_lines("flaw_lines").alias("flaw_line"))


@register("decode_line_list", sql=_FLAWS + """
SELECT doc_id, replace(coalesce(lines, ''), '/~/', chr(10)) AS lines FROM fl""")
def q_decode(spark, sf_dir):
    t = B.test_set(spark, sf_dir).select("doc_id", T.encode_lines("flaw_lines").alias("enc"))
    return t.select("doc_id", T.decode_line_list("enc").alias("lines"))


@register("parse_int_list", sql=_FLAWS + """
SELECT doc_id, CAST(CASE WHEN idx IS NULL THEN 0 ELSE len(string_split(idx, ',')) END AS BIGINT) AS n_idx,
       CAST(coalesce(list_sum(list_transform(string_split(idx, ','), lambda x: CAST(x AS INTEGER))), 0)
            AS BIGINT) AS idx_sum FROM fl""")
def q_parse_ints(spark, sf_dir):
    t = B.test_set(spark, sf_dir)
    arr = T.parse_int_list("flaw_line_index")
    return t.select("doc_id", F.size(arr).alias("n_idx"),
                    F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x).alias("idx_sum"))


@register("compare_truncated", sql="""
WITH pairs AS (
  SELECT d.doc_id,
         regexp_replace(replace(d.text, chr(13), ''), '^\\s+|\\s+$', '', 'g') AS a,
         regexp_replace(replace(b.text, chr(13), ''), '^\\s+|\\s+$', '', 'g') AS b
  FROM documents d JOIN benchmark b ON d.doc_id = b.item_id
)
SELECT doc_id, CAST(left(a, least(length(a), length(b))) = left(b, least(length(a), length(b))) AS BIGINT)
       AS same FROM pairs""")
def q_compare_truncated(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("a"))
    b = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("b"))
    return d.join(b, "doc_id").select("doc_id", T.same_prefix("a", "b").alias("same"))


@register("fill_missing_lines", sql=_FLAWS + """
SELECT doc_id, coalesce(replace(lines, '/~/', chr(10)), '') AS lines FROM fl""")
def q_fill(spark, sf_dir):
    t = B.test_set(spark, sf_dir)
    raw = F.when(F.size("flaw_lines") > 0, F.array_join("flaw_lines", "\n"))
    return Fl.fill_missing(t.select("doc_id", raw.alias("lines")), ["lines"])
