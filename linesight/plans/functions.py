"""Step 4b: array / vector functions and token-to-line score aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.functions import arrays as A
from linesight.functions import text as T
from linesight.operators import lines as L
from linesight.operators import profiling as P
from linesight.operators import scores as Sc
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register

PAD_LEN = 16
WC = "len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> ''))"


def _emb(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@register("softmax_argmax", sql="""
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS pred, round(list_max(p), 6) AS proba
FROM (SELECT vec_id, list_transform(e, lambda x: exp(x - m) / s) AS p
      FROM (SELECT vec_id, e, m, list_sum(list_transform(e, lambda x: exp(x - m))) AS s
            FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
                         list_max(CAST(embedding AS DOUBLE[])) AS m FROM embeddings)))""")
def q_softmax(spark, sf_dir):
    r = A.softmax_argmax("embedding")
    return _emb(spark, sf_dir).select("vec_id", r["pred"].alias("pred"), r["proba"].alias("proba"))


@register("cosine_similarity", sql="""
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
                                              CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine(spark, sf_dir):
    e = _emb(spark, sf_dir)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("nxt"))
    return e.join(nxt, "vec_id").select("vec_id", A.cosine_similarity("embedding", "nxt").alias("cosine"))


@register("mean_pool", sql="""
SELECT CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim, round(avg(v), 6) AS value FROM (
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v,
         unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings)
GROUP BY label, dim""")
def q_mean_pool(spark, sf_dir):
    return Sc.mean_pool(_emb(spark, sf_dir), "label", "embedding")


@register("zero_special_tokens", sql="""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
lz AS (SELECT vec_id, v,
              coalesce(list_max(list_filter(generate_series(0, len(v) - 1), lambda i: v[i + 1] <> 0)), -1) AS last_nz
       FROM e)
SELECT vec_id, round(list_sum(list_transform(generate_series(0, len(v) - 1),
                     lambda i: CASE WHEN i = 0 OR i = last_nz THEN 0.0 ELSE v[i + 1] END)), 6) AS total,
       CAST(last_nz AS BIGINT) AS zeroed,
       round(list_sum(list_transform(generate_series(0, len(v) - 1),
                     lambda i: CASE WHEN i = 0 OR i = len(v) - 1 THEN 0.0 ELSE v[i + 1] END)), 6) AS total_unpadded
FROM lz""")
def q_zero_special(spark, sf_dir):
    z = A.zero_special_tokens("embedding", padding=True)
    plain = A.zero_special_tokens("embedding", padding=False)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)
    # place of the last value that the padded form set to 0
    changed = F.transform(F.arrays_zip(z.alias("z"), F.col("embedding").alias("e")),
                          lambda x, i: F.when((x["z"] == 0) & (x["e"] != 0), i).otherwise(-1))
    return _emb(spark, sf_dir).select("vec_id", total(z).alias("total"), F.array_max(changed).alias("zeroed"),
                                      total(plain).alias("total_unpadded"))


@register("pad_sequence", sql=f"""
SELECT doc_id, array_to_string(list_resize(
         list_transform(string_split(text, chr(10)), lambda l: {WC.format(x='l')}), {PAD_LEN}, 0), ',')
       AS padded
FROM documents WHERE text IS NOT NULL""")
def q_pad(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    counts = F.transform(T.split_lines("text"), lambda l: F.size(T.word_tokens(l)))
    return d.select("doc_id", F.array_join(A.pad_sequence(counts, PAD_LEN), ",").alias("padded"))


@register("fbeta", sql=S.PREDS + """,
pp AS (
  SELECT d.source AS project, count_if(target = 1 AND p.pred = 1) AS tp,
         count_if(target = 0 AND p.pred = 1) AS fp, count_if(target = 1 AND p.pred = 0) AS fn
  FROM preds p JOIN documents d USING (doc_id) GROUP BY d.source
),
pr2 AS (SELECT project, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
               CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM pp)
SELECT project, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN 4 * p + r = 0 THEN 0.0 ELSE 5 * p * r / (4 * p + r) END, 6) AS f2,
       round(p * 100.0, 2) AS precision_pct
FROM pr2""")
def q_fbeta(spark, sf_dir):
    p = B.predictions(spark, sf_dir).join(
        B.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project")), "doc_id")
    a, pr = F.col("target"), F.col("pred")
    c = p.groupBy("project").agg(F.count_if((a == 1) & (pr == 1)).alias("tp"),
                                 F.count_if((a == 0) & (pr == 1)).alias("fp"),
                                 F.count_if((a == 1) & (pr == 0)).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    rec = F.when(F.col("tp") + F.col("fn") == 0, 0.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    c = c.select("project", prec.alias("precision"), rec.alias("recall"))
    return c.select("project", "precision", "recall", A.fbeta("precision", "recall", 2.0).alias("f2"),
                    A.percent("precision").alias("precision_pct"))


_SEG_SQL = S.LINES + f""",
lt AS (SELECT doc_id, line_idx, {WC.format(x='line')} AS n_tok FROM lines),
rng AS (SELECT *, coalesce(sum(n_tok) OVER (PARTITION BY doc_id ORDER BY line_idx
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM lt),
toks AS (
  SELECT doc_id, unnest(t) AS tok, unnest(generate_series(0, len(t) - 1)) AS tok_pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t
    FROM documents WHERE text IS NOT NULL)
)"""


@register("segment_sum", sql=_SEG_SQL + """
SELECT r.doc_id, r.line_idx, round(coalesce(sum(length(t.tok)), 0), 6) AS score
FROM rng r LEFT JOIN toks t ON t.doc_id = r.doc_id AND t.tok_pos >= r.start AND t.tok_pos < r.start + r.n_tok
GROUP BY r.doc_id, r.line_idx""")
def q_segment_sum(spark, sf_dir):
    """Token scores (token length as the stand-in attribution) summed per line
    through consecutive token slices (offset 0)."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    return Sc.segment_sum_rows(d.select(
        "doc_id", F.transform(T.word_tokens("text"), lambda t: F.length(t).cast("double")).alias("scores"),
        F.transform(T.split_lines("text"), lambda line: F.size(T.word_tokens(line))).alias("n_tok")), offset=0)


@register("lookup_sum", sql=_SEG_SQL + """,
w AS (SELECT tok, CAST(count(*) AS DOUBLE) AS weight FROM toks GROUP BY tok),
lt2 AS (SELECT doc_id, line_idx, unnest(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS tok
        FROM lines)
SELECT l.doc_id, l.line_idx, round(coalesce(sum(w.weight), 0.0), 6) AS score
FROM lines l LEFT JOIN lt2 USING (doc_id, line_idx) LEFT JOIN w USING (tok)
GROUP BY l.doc_id, l.line_idx""")
def q_lookup_sum(spark, sf_dir):
    """Line score = Σ corpus frequency of its tokens (a per-token weight table)."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    weights = d.select(F.explode(T.word_tokens("text")).alias("tok")).groupBy("tok").agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    return Sc.lookup_sum(L.split_lines(d), weights)


@register("attention_token_scores", sql="""
WITH h AS (SELECT user_id, count(DISTINCT event_type) AS nh FROM events GROUP BY user_id),
r AS (SELECT user_id, hour(ts) AS dst, sum(value) AS s FROM events GROUP BY user_id, hour(ts))
SELECT r.user_id AS doc_id, CAST(r.dst AS BIGINT) AS tok_pos, round(r.s / h.nh, 6) AS score
FROM r JOIN h USING (user_id)""")
def q_attention(spark, sf_dir):
    """Attention rows from events: document = user, head = event type,
    receiving position = hour of day, weight = value."""
    ev = B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("head"),
        F.col("event_id").alias("src"), F.hour("ts").alias("dst"), F.col("value").alias("w"))
    return Sc.attention_token_scores(ev)
