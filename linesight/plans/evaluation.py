"""Step 3b: post-hoc evaluation of generated lines (token budgets, metadata,
multiset overlap, grouped length / correctness metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.functions import text as T
from linesight.operators import budget as Bu
from linesight.operators import generated as Gn
from linesight.operators import overlap as O
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register


def flagged(spark, sf_dir):
    return Bu.budget_flags(B.eval_records_base(spark, sf_dir), "text", "flaw_line_no")


def metadata_text(spark, sf_dir):
    """Metadata as the evaluation sheet stores it: JSON for English documents,
    a Python-literal dict for the others (both forms occur in such sheets)."""
    f = flagged(spark, sf_dir).withColumn("metadata_json", T.metadata_json("metadata"))
    j = F.col("metadata_json")
    pyish = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        j, '"', "'"), "true", "True"), "false", "False"), "null", "None")
    return f.withColumn("metadata_text", F.when(F.col("lang") == "en", j).otherwise(pyish))


def records(spark, sf_dir):
    """One evaluation record per actual-positive document.  The replaced
    predictions are gathered into one ordered array per document (bounded by
    the generator's output) and joined to the document row once; metadata
    parsing, stripping and the counted overlap are then row-local."""
    base = B.eval_records_base(spark, sf_dir)
    preds = B.predicted_lines(spark, sf_dir).join(base.select("doc_id"), "doc_id", "left_semi")
    repl = Gn.similar_line_replace_rows(base.select("doc_id", "text"), preds, skip_last=False,
                                        drop_blank=True)
    arr = Gn.pred_text(repl.select("doc_id", "pred_pos", "line"), out="_pt")
    meta = Bu.parse_budget_metadata(metadata_text(spark, sf_dir), "metadata_text")
    rows = meta.select("doc_id", "actual_text", F.col("pred").alias("pred_g1"), "is_within_128") \
        .join(arr, "doc_id", "left")
    gt = T.strip_lines(T.split_lines(F.coalesce(F.col("actual_text"), F.lit(""))))
    pr = T.strip_lines(F.when(F.col("_pt").isNull(), F.array().cast("array<string>"))
                       .otherwise(T.split_lines("_pt")))
    return rows.select("doc_id", *O.multiset_overlap_arrays(gt, pr), "pred_g1", "is_within_128")


@register("token_budget_index", sql=S.BUDGET + """
SELECT doc_id, CAST(index_words AS BIGINT) AS index_words, CAST(index_chars AS BIGINT) AS index_chars
FROM budget""")
def q_budget_index(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    return d.select("doc_id", Bu.budget_index("text", Bu.words_family).alias("index_words"),
                    Bu.budget_index("text", Bu.chars_family).alias("index_chars"))


@register("token_budget_flags", sql=S.BUDGET + """
SELECT doc_id,
       CAST(metadata.bert.under_128_tokens AS BIGINT) AS bert_under_128_tokens,
       CAST(metadata.bert.vul_line_within_128 AS BIGINT) AS bert_vul_line_within_128,
       CAST(metadata.bert.index_128 AS BIGINT) AS bert_index_128,
       CAST(metadata.bert.total_tokens AS BIGINT) AS bert_total_tokens,
       CAST(metadata.codet5.under_128_tokens AS BIGINT) AS codet5_under_128_tokens,
       CAST(metadata.codet5.vul_line_within_128 AS BIGINT) AS codet5_vul_line_within_128,
       CAST(metadata.codet5.index_128 AS BIGINT) AS codet5_index_128,
       CAST(metadata.codet5.total_tokens AS BIGINT) AS codet5_total_tokens
FROM meta WHERE metadata IS NOT NULL""")
def q_budget_flags(spark, sf_dir):
    f = flagged(spark, sf_dir).where(F.col("metadata").isNotNull())
    cols = [F.col(f"metadata.{fam}.{k}").alias(f"{fam}_{k}")
            for fam in ("bert", "codet5")
            for k in ("under_128_tokens", "vul_line_within_128", "index_128", "total_tokens")]
    return f.select("doc_id", *cols)


@register("nested_metadata_json", sql=S.BUDGET + """
SELECT doc_id, coalesce(CAST(to_json(metadata) AS VARCHAR), '') AS metadata_json FROM meta""")
def q_metadata_json(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", T.metadata_json("metadata").alias("metadata_json"))


@register("budget_summary", sql=S.BUDGET + """
SELECT CAST(count_if(metadata IS NOT NULL) AS BIGINT) AS records_with_vul,
       CAST(count_if(metadata.bert.under_128_tokens) AS BIGINT) AS bert_under_128,
       CAST(count_if(metadata.bert.vul_line_within_128) AS BIGINT) AS bert_vul_within_128,
       CAST(count_if(NOT metadata.bert.vul_line_within_128) AS BIGINT) AS bert_vul_beyond_128,
       CAST(count_if(metadata.codet5.under_128_tokens) AS BIGINT) AS codet5_under_128,
       CAST(count_if(metadata.codet5.vul_line_within_128) AS BIGINT) AS codet5_vul_within_128,
       CAST(count_if(NOT metadata.codet5.vul_line_within_128) AS BIGINT) AS codet5_vul_beyond_128
FROM meta""")
def q_budget_summary(spark, sf_dir):
    return Bu.budget_summary(flagged(spark, sf_dir))


@register("parse_budget_metadata", sql=S.BUDGET + """
SELECT doc_id, CAST(coalesce(metadata.codet5.vul_line_within_128, false) AS BIGINT) AS is_within_128
FROM meta""")
def q_parse_metadata(spark, sf_dir):
    m = Bu.parse_budget_metadata(metadata_text(spark, sf_dir), "metadata_text")
    return m.select("doc_id", "is_within_128")


@register("multiset_overlap", sql=S.EVAL + """
SELECT doc_id, CAST(gt_len AS BIGINT) AS gt_len, CAST(sim_len AS BIGINT) AS sim_len,
       round(msp, 6) AS msp, round(msr, 6) AS msr, round(miou, 6) AS miou FROM rec""")
def q_multiset(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", "gt_len", "sim_len", "msp", "msr", "miou")


@register("length_group_metrics", sql=S.EVAL + """,
cells AS (
  SELECT s.slice, g.grp, r.gt_len, r.sim_len FROM rec r,
    (SELECT 'full_dataset' AS slice UNION ALL SELECT 'reliable_set') s,
    (SELECT 'overall' AS grp UNION ALL SELECT 'true_positive' UNION ALL SELECT 'false_negative') g
  WHERE (s.slice = 'full_dataset' OR r.gt_len <= 20)
    AND (g.grp = 'overall' OR (g.grp = 'true_positive' AND r.pred_g1 = 1)
         OR (g.grp = 'false_negative' AND r.pred_g1 = 0))
),
grid AS (
  SELECT * FROM (SELECT 'full_dataset' AS slice UNION ALL SELECT 'reliable_set'),
                (SELECT 'overall' AS grp UNION ALL SELECT 'true_positive' UNION ALL SELECT 'false_negative')
)
SELECT g.slice, g.grp AS "group", CAST(count(c.gt_len) AS BIGINT) AS count,
       round(coalesce(avg(CAST(c.sim_len = c.gt_len AS DOUBLE)), 0.0), 6) AS accuracy_vlc,
       round(coalesce(avg(abs(c.sim_len - c.gt_len)), 0.0), 6) AS mae,
       round(coalesce(sqrt(avg((c.sim_len - c.gt_len) * (c.sim_len - c.gt_len))), 0.0), 6) AS rmse
FROM grid g LEFT JOIN cells c ON c.slice = g.slice AND c.grp = g.grp GROUP BY g.slice, g.grp""")
def q_length_groups(spark, sf_dir):
    return O.length_group_metrics(records(spark, sf_dir))


@register("correctness_group_metrics", sql=S.EVAL + """,
cells AS (
  SELECT g.grp, r.msp, r.msr, r.miou FROM rec r,
    (SELECT 'overall' AS grp UNION ALL SELECT 'true_positive' UNION ALL SELECT 'false_negative') g
  WHERE r.is_within_128 AND (g.grp = 'overall' OR (g.grp = 'true_positive' AND r.pred_g1 = 1)
         OR (g.grp = 'false_negative' AND r.pred_g1 = 0))
),
grid AS (SELECT 'overall' AS grp UNION ALL SELECT 'true_positive' UNION ALL SELECT 'false_negative')
SELECT 'within_128' AS slice, g.grp AS "group", CAST(count(c.msp) AS BIGINT) AS count,
       round(coalesce(avg(c.msp), 0.0), 6) AS msp, round(coalesce(avg(c.msr), 0.0), 6) AS msr,
       round(coalesce(avg(c.miou), 0.0), 6) AS miou
FROM grid g LEFT JOIN cells c ON c.grp = g.grp GROUP BY g.grp""")
def q_correctness_groups(spark, sf_dir):
    return O.correctness_group_metrics(records(spark, sf_dir))
