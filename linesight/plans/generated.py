"""Step 3: generated-line (text) variant over the predicted-positive test set.

Predictions are the three longest lines of a document plus the first line
of the next document (a hallucination), similarity-replaced (variant a)
before ranking, as the studied evaluation does by default.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.operators import generated as Gn
from linesight.operators import global_order as G
from linesight.operators import lines as L
from linesight.operators import ranking as R
from linesight.operators.document_metrics import generated_flags
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register
from linesight.session import materialize


def replaced_preds(spark, sf_dir):
    """Predictions with unseen lines replaced (variant a), computed inside each
    document row after one join (no token shuffle)."""
    docs = B.generated_positives(spark, sf_dir).select("doc_id", "text")
    return Gn.similar_line_replace_rows(docs, B.positive_preds(spark, sf_dir), skip_last=True)


def generated_ranking(spark, sf_dir):
    """(doc_id, rank, line, is_predicted, hit, n_labels, proba)."""
    pos = B.generated_positives(spark, sf_dir).select("doc_id", "flaw_text", "proba")
    preds = replaced_preds(spark, sf_dir).select("doc_id", "pred_pos", "line")
    ranked = R.rank_lines_generated(B.positive_lines(spark, sf_dir), preds)
    ranked = ranked.join(pos, "doc_id")
    ranked = L.label_lines_by_text(ranked, "flaw_text")
    return ranked.withColumn("n_labels", F.size("flaw_text")).drop("flaw_text")


@register("similar_line_replace", sql=S.GEN + """
SELECT doc_id, CAST(pred_pos AS BIGINT) AS pred_pos, line, CAST(replaced AS BIGINT) AS replaced FROM repl""")
def q_similar_replace(spark, sf_dir):
    return replaced_preds(spark, sf_dir)


@register("lines_not_in_document", sql=S.GEN + """
SELECT doc_id, CAST(pred_pos AS BIGINT) AS pred_pos, line FROM pneed p
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.doc_id = p.doc_id AND s.line = p.line)""")
def q_unseen(spark, sf_dir):
    return Gn.lines_not_in_document(B.positive_preds(spark, sf_dir), B.positive_lines(spark, sf_dir))


@register("rank_lines_generated", sql=S.GEN + """
SELECT doc_id, CAST(rnk AS BIGINT) AS rank, line, CAST(is_predicted AS BIGINT) AS is_predicted FROM gr""")
def q_rank_generated(spark, sf_dir):
    return generated_ranking(spark, sf_dir).select("doc_id", "rank", "line", "is_predicted")


@register("label_lines_by_text", sql=S.GEN + """
SELECT doc_id, CAST(rnk AS BIGINT) AS rank, CAST(hit AS BIGINT) AS hit FROM gr""")
def q_label_by_text(spark, sf_dir):
    return generated_ranking(spark, sf_dir).select("doc_id", "rank", "hit")


@register("text_localization_metrics", sql=S.GEN + """,
metrics AS (SELECT doc_id, """ + S.metric_exprs(True) + """ FROM cum GROUP BY doc_id)
SELECT doc_id, top_x_accuracy, top_x_precision, top_x_recall, rr, ap, ar, ifa FROM metrics""")
def q_text_metrics(spark, sf_dir):
    """Seven metrics with text hits: duplicates count, unlabelled documents
    score their blank lines, recall may exceed 1.  Ranked inside each
    document row after one join with its (replaced) predictions."""
    from linesight.operators.document_metrics import generated_metrics
    pos = B.generated_positives(spark, sf_dir).select("doc_id", "text", "flaw_text")
    preds = replaced_preds(spark, sf_dir).select("doc_id", "pred_pos", "line")
    return generated_metrics(pos, preds)


@register("order_generated_global", sql=S.GEN + """
SELECT doc_id, CAST(rnk AS BIGINT) AS rank, CAST(pos AS BIGINT) AS pos,
       CAST(cum_hits AS BIGINT) AS cum_hits FROM gorder""")
def q_order_generated(spark, sf_dir):
    o = G.generated_order_positions(generated_ranking(spark, sf_dir))
    return o.select("doc_id", "rank", "pos", "cum_hits")


def _gen_totals(spark, sf_dir):
    t = B.test_set.plain(spark, sf_dir)
    row = t.agg(F.coalesce(F.sum("n_loc"), F.lit(0)).alias("loc"),
                F.coalesce(F.sum(F.when(F.col("target") == 1, F.size("flaw_lines"))), F.lit(0))
                .alias("flaws")).first()
    return float(row["flaws"]), float(row["loc"])


@register("effort_recall_generated", sql=S.GEN + """
SELECT
  round(CASE WHEN t.total_flaws = 0 THEN 1.0 ELSE
    coalesce((SELECT min(pos) FROM gorder
              WHERE cum_hits >= greatest(1.0, CAST(0.2 AS DOUBLE) * CAST(t.total_flaws AS DOUBLE))),
             (SELECT count(*) FROM gorder)) / CAST(t.total_loc AS DOUBLE) END, 6) AS effort,
  round((SELECT coalesce(sum(hit), 0) FROM gorder
         WHERE pos <= ceil(greatest(1.0, CAST(0.01 AS DOUBLE) * CAST(t.total_loc AS DOUBLE))))
        / CAST(nullif(t.total_flaws, 0) AS DOUBLE), 6) AS recall
FROM totals t""")
def q_effort_generated(spark, sf_dir):
    """Effort@20%Recall and Recall@1%LOC in the generated global order."""
    flaws, loc = _gen_totals(spark, sf_dir)
    pos = B.generated_positives(spark, sf_dir).select("doc_id", "text", "flaw_text", "proba")
    pos = pos.withColumn("proba", F.coalesce("proba", F.lit(-1.0)))     # documents without one come last
    flags = materialize(generated_flags(pos, replaced_preds(spark, sf_dir).select("doc_id", "pred_pos", "line"), keep=["proba"]))
    r = flags.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("h")).first()
    totals = r["n"], r["h"]
    effort = G.effort_of_order(flags, G.GENERATED_ORDER, flaws, loc, 20.0, totals=totals)
    recall = G.recall_of_order(flags, G.GENERATED_ORDER, flaws, loc, 1.0, totals=totals)
    return spark.createDataFrame([(effort, recall)], "effort double, recall double")


@register("effort_recall_generated_functions", sql=S.GEN + """,
fo AS (
  SELECT hit, row_number() OVER (ORDER BY proba DESC, doc_id, rnk) AS pos,
         sum(hit) OVER (ORDER BY proba DESC, doc_id, rnk ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM gr
)
SELECT
  round(CASE WHEN t.total_flaws = 0 THEN 1.0 ELSE
    coalesce((SELECT min(pos) FROM fo
              WHERE cum_hits >= greatest(1.0, CAST(0.2 AS DOUBLE) * CAST(t.total_flaws AS DOUBLE))),
             (SELECT count(*) FROM fo)) / CAST(t.total_loc AS DOUBLE) END, 6) AS effort,
  round((SELECT coalesce(sum(hit), 0) FROM fo
         WHERE pos <= ceil(greatest(1.0, CAST(0.01 AS DOUBLE) * CAST(t.total_loc AS DOUBLE))))
        / CAST(nullif(t.total_flaws, 0) AS DOUBLE), 6) AS recall
FROM totals t""")
def q_effort_generated_functions(spark, sf_dir):
    """Effort@20%Recall and Recall@1%LOC of the text variant in functions order:
    documents by probability, their generated ranking inside."""
    from linesight.session import materialize
    flaws, loc = _gen_totals(spark, sf_dir)
    ranked = generated_ranking(spark, sf_dir).select("doc_id", "rank", "hit", "proba")
    o = G.function_order_positions(materialize(ranked))   # read for the offsets and for the lines
    return _one_row(G.effort_at_recall(o, flaws, loc, 20.0), G.recall_at_loc(o, flaws, loc, 1.0))


def _one_row(e, r):
    # both inputs are single-row aggregates; stack them into one row through
    # a tagged union and a conditional aggregate (no join)
    u = (e.select(F.lit(0).alias("k"), F.col("effort").alias("v"))
         .unionByName(r.select(F.lit(1).alias("k"), F.col("recall").alias("v"))))
    return u.agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("effort"),
                 F.max(F.when(F.col("k") == 1, F.col("v"))).alias("recall"))


def _texts(spark, sf_dir):
    pos = B.generated_positives(spark, sf_dir).select("doc_id", "project", "label_text")
    before = Gn.pred_text(B.positive_preds(spark, sf_dir), out="pred_text")
    after = Gn.pred_text(replaced_preds(spark, sf_dir).select("doc_id", "pred_pos", "line"),
                         out="sim_text")
    return pos.join(before, "doc_id", "left").join(after, "doc_id", "left")


@register("exact_match_accuracy", sql=S.GEN + """,
pt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pred_pos) AS t FROM preds GROUP BY doc_id),
st AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pred_pos) AS t FROM repl GROUP BY doc_id),
lt AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_idx)
                               FILTER (WHERE hit = 1 AND target = 1), '') AS t
       FROM plines GROUP BY doc_id)
SELECT round(avg(CAST(pt.t = lt.t AS DOUBLE)), 6) AS exact_match_before,
       round(avg(CAST(st.t = lt.t AS DOUBLE)), 6) AS exact_match_after
FROM lt LEFT JOIN pt USING (doc_id) LEFT JOIN st USING (doc_id)""")
def q_exact_match(spark, sf_dir):
    t = _texts(spark, sf_dir).withColumn("label", F.coalesce("label_text", F.lit("")))
    return t.agg(Gn.exact_match(t, "pred_text", "label").alias("exact_match_before"),
                 Gn.exact_match(t, "sim_text", "label").alias("exact_match_after"))


LABEL_CHARS = 80   # the binding's output length, also in the SQL


@register("exact_match_truncated", sql=S.GEN + """,
pt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pred_pos) AS t FROM preds GROUP BY doc_id),
st AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pred_pos) AS t FROM repl GROUP BY doc_id),
lt AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_idx)
                               FILTER (WHERE hit = 1 AND target = 1), '') AS t
       FROM plines GROUP BY doc_id)
SELECT round(avg(CAST(pt.t = substr(lt.t, 1, 80) AS DOUBLE)), 6) AS exact_match_before,
       round(avg(CAST(st.t = substr(lt.t, 1, 80) AS DOUBLE)), 6) AS exact_match_after
FROM lt LEFT JOIN pt USING (doc_id) LEFT JOIN st USING (doc_id)""")
def q_exact_match_truncated(spark, sf_dir):
    """Against labels cut to the output length."""
    t = _texts(spark, sf_dir).withColumn("label", F.coalesce("label_text", F.lit("")))
    return t.agg(Gn.exact_match_truncated(t, "pred_text", "label", LABEL_CHARS).alias("exact_match_before"),
                 Gn.exact_match_truncated(t, "sim_text", "label", LABEL_CHARS).alias("exact_match_after"))


@register("line_count_stats", sql=S.GEN + """,
pt AS (SELECT doc_id, count(*) AS n FROM preds GROUP BY doc_id),
lt AS (SELECT doc_id, greatest(count_if(hit = 1 AND target = 1), 1) AS n FROM plines GROUP BY doc_id)
SELECT round(avg(pt.n), 6) AS mean_pred_lines, round(quantile_cont(pt.n, 0.5), 6) AS median_pred_lines,
       round(avg(lt.n), 6) AS mean_actual_lines, round(quantile_cont(lt.n, 0.5), 6) AS median_actual_lines
FROM lt JOIN pt USING (doc_id)""")
def q_line_counts(spark, sf_dir):
    return Gn.line_count_stats(_texts(spark, sf_dir))


@register("hallucination_flag", sql=S.GEN + """
SELECT doc_id, CAST(max(CASE WHEN s.line IS NULL AND NOT is_last THEN 1 ELSE 0 END) AS BIGINT) AS hallucinated
FROM (SELECT p.*, p.pred_pos = max(p.pred_pos) OVER (PARTITION BY p.doc_id) AS is_last FROM preds p) q
LEFT JOIN seen s USING (doc_id, line) GROUP BY doc_id""")
def q_hallucination(spark, sf_dir):
    return Gn.hallucination_flag(B.positive_preds(spark, sf_dir), B.positive_lines(spark, sf_dir))


@register("category_rate_join", sql=S.GEN + """,
flags AS (
  SELECT doc_id, max(CASE WHEN s.line IS NULL AND NOT is_last THEN 1 ELSE 0 END) AS h
  FROM (SELECT p.*, p.pred_pos = max(p.pred_pos) OVER (PARTITION BY p.doc_id) AS is_last FROM preds p) q
  LEFT JOIN seen s USING (doc_id, line) GROUP BY doc_id
)
SELECT d.source AS project, CAST(sum(h) AS BIGINT) AS flagged, CAST(count(*) AS BIGINT) AS total,
       round(sum(h) / CAST(count(*) AS DOUBLE), 6) AS rate
FROM flags JOIN documents d USING (doc_id) GROUP BY d.source HAVING sum(h) > 0""")
def q_category_rate(spark, sf_dir):
    flags = Gn.hallucination_flag(B.positive_preds(spark, sf_dir), B.positive_lines(spark, sf_dir))
    proj = B.generated_positives(spark, sf_dir).select("doc_id", "project")
    return Gn.category_rate(flags.join(proj, "doc_id"), "project")


@register("order_generated_doc_order", sql=S.GEN + """,
gdoc AS (
  SELECT doc_id, rnk, hit,
         row_number() OVER (ORDER BY is_predicted DESC, doc_id, rnk) AS pos,
         sum(hit) OVER (ORDER BY is_predicted DESC, doc_id, rnk ROWS UNBOUNDED PRECEDING) AS cum_hits
  FROM gr
)
SELECT doc_id, CAST(rnk AS BIGINT) AS rank, CAST(pos AS BIGINT) AS pos,
       CAST(cum_hits AS BIGINT) AS cum_hits FROM gdoc""")
def q_order_generated_doc(spark, sf_dir):
    """The older generated order: predicted lines first, documents in
    document order (no probability), then rank."""
    o = G.generated_order_positions(generated_ranking(spark, sf_dir), proba=None)
    return o.select("doc_id", "rank", "pos", "cum_hits")
