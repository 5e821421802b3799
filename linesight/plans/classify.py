"""Step 2a: classification metrics and data profiles."""

from __future__ import annotations

from pyspark.sql import functions as F


from linesight.operators import classification as C
from linesight.operators import profiling as P
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register


@register("confusion_matrix", sql=S.PREDS + """
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tp AS BIGINT) AS tp FROM cm""")
def q_confusion(spark, sf_dir):
    return C.confusion_matrix(B.predictions(spark, sf_dir))


@register("classification_metrics", sql=S.PREDS + """
SELECT round((tp + tn) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy,
       round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1,
       round(CASE WHEN 4 * p + r = 0 THEN 0.0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f2,
       round((r + tnr) / 2.0, 6) AS roc_auc
FROM pr""")
def q_classification(spark, sf_dir):
    return C.classification_metrics(B.predictions(spark, sf_dir))


@register("macro_metrics", sql=S.PREDS + """
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1 FROM pcf""")
def q_macro(spark, sf_dir):
    return C.macro_metrics(B.predictions(spark, sf_dir))


@register("classification_report", sql=S.PREDS + """
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pcf
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(correct) / CAST(sum(support) AS DOUBLE), 6),
       CAST(sum(support) AS BIGINT) FROM pcf
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM pcf
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pcf""")
def q_report(spark, sf_dir):
    return C.classification_report(B.predictions(spark, sf_dir))


@register("soft_confusion_metrics", sql=S.PREDS + """,
soft AS (
  SELECT sum(round_even(least(greatest(target * proba, 0.0), 1.0), 0)) AS tp,
         sum(round_even(least(greatest(CAST(target AS DOUBLE), 0.0), 1.0), 0)) AS pos,
         sum(round_even(least(greatest(proba, 0.0), 1.0), 0)) AS pp
  FROM preds
),
sp AS (SELECT (tp + 1e-7) / (pp + 1e-7) AS p, (tp + 1e-7) / (pos + 1e-7) AS r FROM soft)
SELECT round(p, 6) AS precision, round(r, 6) AS recall,
       round(2 * (p * r) / (p + r + 1e-7), 6) AS f1,
       round(5 * (p * r) / (4 * p + r + 1e-7), 6) AS f2 FROM sp""")
def q_soft(spark, sf_dir):
    return C.soft_confusion_metrics(B.predictions(spark, sf_dir))


@register("mean_loss", sql=S.PREDS + """
SELECT round(avg(-ln(CASE WHEN target = 1 THEN proba ELSE 1.0 - proba END)), 6) AS loss
FROM preds""")
def q_loss(spark, sf_dir):
    return C.mean_loss(B.predictions(spark, sf_dir))


@register("threshold_predict", sql=S.PREDS + """
SELECT doc_id, CAST(proba > 0.5 AS BIGINT) AS pred FROM preds""")
def q_threshold(spark, sf_dir):
    return C.threshold_predict(B.predictions(spark, sf_dir).drop("pred")).select("doc_id", "pred")


@register("value_counts", sql="""
SELECT source, CAST(count(*) AS BIGINT) AS count FROM documents
WHERE source IS NOT NULL GROUP BY source""")
def q_value_counts(spark, sf_dir):
    return P.value_counts(B.table(spark, sf_dir, "documents"), "source")


@register("top_categories", sql="""
SELECT lang, CAST(count(*) AS BIGINT) AS count FROM documents WHERE lang IS NOT NULL
GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 10""")
def q_top_categories(spark, sf_dir):
    return P.top_categories(B.table(spark, sf_dir, "documents"), "lang", 10)


@register("distinct_categories", sql="""
SELECT CAST(count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS BIGINT)
       AS n_distinct FROM documents""")
def q_distinct(spark, sf_dir):
    return P.distinct_categories(B.table(spark, sf_dir, "documents"), "source")


@register("class_ratio", sql="""
SELECT CAST(count_if(toxic = 1) AS BIGINT) AS positives, CAST(count_if(toxic = 0) AS BIGINT) AS negatives,
       round(count_if(toxic = 1) * 100.0 / nullif(count_if(toxic = 0), 0), 6) AS ratio FROM labels""")
def q_class_ratio(spark, sf_dir):
    return P.class_ratio(B.table(spark, sf_dir, "labels"), "toxic")


@register("class_weights", sql="""
SELECT CAST(toxic AS BIGINT) AS toxic, CAST(count(*) AS BIGINT) AS count,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM labels GROUP BY toxic""")
def q_class_weights(spark, sf_dir):
    return P.class_weights(B.table(spark, sf_dir, "labels"), "toxic")


@register("max_word_count", sql=S.WORDS + """
SELECT CAST(max(len(t)) AS BIGINT) AS max_words FROM toks""")
def q_max_words(spark, sf_dir):
    return P.max_word_count(B.table(spark, sf_dir, "documents"))


@register("max_encoded_length", sql=S.WORDS + """
SELECT CAST(max(len(t)) AS BIGINT) AS longest,
       CAST(arg_min(doc_id, (-len(t), doc_id)) AS BIGINT) AS row_id,
       CAST(least(max(len(t)), 512) AS BIGINT) AS max_len FROM toks""")
def q_max_len(spark, sf_dir):
    return P.max_encoded_length(B.table(spark, sf_dir, "documents"))


@register("word_frequency", sql=S.WORDS + """
SELECT w AS word, CAST(count(*) AS BIGINT) AS count FROM (SELECT unnest(t) AS w FROM toks)
GROUP BY w""")
def q_word_freq(spark, sf_dir):
    return P.word_frequency(B.table(spark, sf_dir, "documents"))


@register("word_totals", sql=S.WORDS + """
SELECT CAST(count(*) AS BIGINT) AS all_words, CAST(count(DISTINCT w) AS BIGINT) AS unique_words
FROM (SELECT unnest(t) AS w FROM toks)""")
def q_word_totals(spark, sf_dir):
    return P.word_totals(B.table(spark, sf_dir, "documents"))


_STATS = S.WORDS + """,
ls AS (SELECT len(t) AS len FROM toks),
st AS (
  SELECT avg(len) AS mean, max(len) AS max, min(len) AS min, quantile_cont(len, 0.5) AS median,
         stddev_pop(len) AS std, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.75) AS q3
  FROM ls
)"""


@register("length_stats", sql=_STATS + """
SELECT round(mean, 6) AS mean, CAST(max AS BIGINT) AS max, CAST(min AS BIGINT) AS min,
       round(median, 6) AS median, round(std, 6) AS std, round(q1, 6) AS q1, round(q3, 6) AS q3,
       round(median + 2 * std, 6) AS median_2std, CAST(trunc(median + 2 * std) AS BIGINT) AS split_point_std,
       round(q3 - q1, 6) AS iqr, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower FROM st""")
def q_length_stats(spark, sf_dir):
    return P.length_stats(B.table(spark, sf_dir, "documents"))


@register("length_reduce", sql=_STATS + """,
bounds AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM st),
m AS (SELECT count(*) - count_if(len <= lower OR len >= upper) AS m, count(*) AS n FROM ls, bounds),
sorted AS (SELECT len, row_number() OVER (ORDER BY len) AS k FROM ls),
mx AS (SELECT len AS max_len FROM sorted, m WHERE k = CASE WHEN m.m > 0 THEN m.m ELSE m.n END)
SELECT doc_id, CAST(len(t) AS BIGINT) AS length FROM toks, mx WHERE len(t) < mx.max_len""")
def q_length_reduce(spark, sf_dir):
    return P.length_reduce(B.table(spark, sf_dir, "documents")).select("doc_id", "length")


@register("profile_scan", sql="""
SELECT column_name AS "column", CAST(nulls AS BIGINT) AS nulls, CAST(n AS BIGINT) AS rows FROM (
  SELECT count(*) AS n,
         count_if(l_orderkey IS NULL) AS l_orderkey, count_if(l_partkey IS NULL) AS l_partkey,
         count_if(l_suppkey IS NULL) AS l_suppkey, count_if(l_linenumber IS NULL) AS l_linenumber,
         count_if(l_quantity IS NULL) AS l_quantity, count_if(l_extendedprice IS NULL) AS l_extendedprice,
         count_if(l_discount IS NULL) AS l_discount, count_if(l_tax IS NULL) AS l_tax,
         count_if(l_returnflag IS NULL) AS l_returnflag, count_if(l_linestatus IS NULL) AS l_linestatus,
         count_if(l_shipdate IS NULL) AS l_shipdate
  FROM lineitem) UNPIVOT (nulls FOR column_name IN (l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))""")
def q_profile(spark, sf_dir):
    return P.profile_scan(B.table(spark, sf_dir, "lineitem"))


@register("preview", sql="""
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [truncated]'
                    ELSE text END AS text, source
FROM documents ORDER BY doc_id LIMIT 5""")
def q_preview(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return P.preview(docs, "doc_id", 5)


@register("union_all", sql="""
SELECT 'documents' AS part, CAST(doc_id AS BIGINT) AS id, text FROM documents
UNION ALL SELECT 'benchmark', CAST(item_id AS BIGINT), text FROM benchmark""")
def q_union_all(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.lit("documents").alias("part"),
                                                   F.col("doc_id").alias("id"), "text")
    b = B.table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("part"),
                                                   F.col("item_id").alias("id"), "text")
    return P.union_all(d, b)



