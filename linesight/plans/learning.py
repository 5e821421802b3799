"""Step 7: features, learning, scoring, ROUGE, early stopping, top lines."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from linesight.functions import text as T
from linesight.operators import attribution as At
from linesight.operators import features as Fe
from linesight.operators import fold_stats as Fs
from linesight.operators import rouge as Rg
from linesight.operators import runs as U
from linesight.operators import sampling as Sm
from linesight.operators import word_vectors as Wv
from linesight.operators.classification import classification_metrics
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register
from linesight.session import dropped

SEED = Sm.SEEDS[0]
TOKS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"
TERMS = ("list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}\\p{Mn}\\p{Mc}\\p{Me}\\p{Pc}]+'),"
         " lambda t: length(t) >= 2)")

_TRAIN = """
WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS ri, count(*) OVER () AS n
           FROM documents WHERE text IS NOT NULL),
train AS (SELECT doc_id, text FROM r WHERE ri < n - 2 * CAST(floor(0.1 * n) AS BIGINT))"""


def train_docs(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    return Sm.positional_split(d, "doc_id").where(F.col("split") == "train").drop("split")


@register("bag_of_words", sql=_TRAIN + f"""
SELECT term, CAST(count(*) AS BIGINT) AS df FROM (
  SELECT DISTINCT doc_id, unnest({TERMS}) AS term FROM train) GROUP BY term HAVING count(*) >= 20""")
def q_bow(spark, sf_dir):
    """Bag-of-words vocabulary with document frequencies (train split, min df 20)."""
    return Fe.bow_vocabulary(train_docs(spark, sf_dir))


@register("token_index", sql=f"""
WITH c AS (SELECT tok, count(*) AS count FROM (
             SELECT unnest({TOKS.format(x='lower(text)')}) AS tok FROM documents) GROUP BY tok)
SELECT tok, CAST(row_number() OVER (ORDER BY count DESC, tok) AS BIGINT) AS idx,
       CAST(count AS BIGINT) AS count FROM c""")
def q_token_index(spark, sf_dir):
    return Fe.token_index(B.table(spark, sf_dir, "documents"))


@register("token_sequences", sql=f"""
WITH c AS (SELECT tok, count(*) AS count FROM (
             SELECT unnest({TOKS.format(x='lower(text)')}) AS tok FROM documents) GROUP BY tok),
v AS (SELECT tok, row_number() OVER (ORDER BY count DESC, tok) AS idx FROM c),
o AS (SELECT doc_id, unnest({TOKS.format(x='lower(text)')}) AS tok,
             unnest(generate_series(1, len({TOKS.format(x='lower(text)')}))) AS pos FROM documents)
SELECT d.doc_id, coalesce(string_agg(CAST(v.idx AS VARCHAR), ',' ORDER BY o.pos), '') AS seq
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN v USING (tok) GROUP BY d.doc_id""")
def q_token_sequences(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    seqs = Fe.index_sequences(d, Fe.token_index(d))
    return seqs.select("doc_id", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",")
                       .alias("seq"))


def _det_vectors(spark, sf_dir):
    """Deterministic token vectors for the join/pool oracles: [length, count]
    of every token seen at least twice (hapaxes are out of vocabulary)."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    c = d.select(F.explode(T.word_tokens("text")).alias("word")).groupBy("word").count()
    return c.where(F.col("count") >= 2).select(
        "word", F.array(F.length("word").cast("double"), F.col("count").cast("double")).alias("vector"))


_VEC = f"""
WITH c AS (SELECT tok AS word, count(*) AS count FROM (
             SELECT unnest({TOKS.format(x='text')}) AS tok FROM documents) GROUP BY tok HAVING count(*) >= 2),
o AS (SELECT doc_id, unnest({TOKS.format(x='text')}) AS tok,
             unnest(generate_series(0, len({TOKS.format(x='text')}) - 1)) AS pos FROM documents)"""


@register("token_vector_join", sql=_VEC + """
SELECT o.doc_id, CAST(o.pos AS BIGINT) AS pos, o.tok, CAST(length(c.word) AS DOUBLE) AS v0,
       CAST(c.count AS DOUBLE) AS v1
FROM o JOIN c ON c.word = o.tok""")
def q_token_vectors(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return Fe.token_vector_join(d, _det_vectors(spark, sf_dir)).select(
        "doc_id", "pos", "tok", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"))


@register("vocabulary_vectors", sql=f"""
WITH c AS (SELECT tok, count(*) AS count FROM (
             SELECT unnest({TOKS.format(x='lower(text)')}) AS tok FROM documents) GROUP BY tok),
v AS (SELECT tok, row_number() OVER (ORDER BY count DESC, tok) AS idx FROM c),
w AS (SELECT tok, count(*) AS count FROM (
        SELECT unnest({TOKS.format(x='text')}) AS tok FROM documents) GROUP BY tok HAVING count(*) >= 2)
SELECT CAST(0 AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS tok, 0.0 AS v0, 0.0 AS v1
UNION ALL
SELECT CAST(idx AS BIGINT), v.tok, CASE WHEN w.tok IS NULL THEN 0.0 ELSE CAST(length(v.tok) AS DOUBLE) END,
       CAST(coalesce(w.count, 0) AS DOUBLE)
FROM v LEFT JOIN w USING (tok)""")
def q_vocabulary_vectors(spark, sf_dir):
    """Vector of every indexed (lower-cased) token; zeros for tokens without one
    and for the padding id."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    m = Fe.vocabulary_vectors(Fe.token_index(d), _det_vectors(spark, sf_dir))
    return m.select("idx", "tok", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1"))


@register("document_vectors", sql=_VEC + """,
j AS (SELECT o.doc_id, CAST(length(c.word) AS DOUBLE) AS v0, CAST(c.count AS DOUBLE) AS v1
      FROM o JOIN c ON c.word = o.tok),
m AS (SELECT doc_id, avg(v0) AS a0, avg(v1) AS a1 FROM j GROUP BY doc_id),
z AS (SELECT d.doc_id, coalesce(m.a0, 0.0) AS a0, coalesce(m.a1, 0.0) AS a1
      FROM documents d LEFT JOIN m USING (doc_id))
SELECT doc_id, CAST(0 AS BIGINT) AS dim, round(a0, 6) AS value FROM z
UNION ALL SELECT doc_id, CAST(1 AS BIGINT), round(a1, 6) FROM z""")
def q_document_vectors(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return Fe.document_vectors(d, _det_vectors(spark, sf_dir))


_PAIRS = _TRAIN + f""",
o AS (SELECT doc_id, unnest({TOKS.format(x='text')}) AS tok,
             unnest(generate_series(0, len({TOKS.format(x='text')}) - 1)) AS pos FROM train),
pairs AS (SELECT a.tok AS word, b.tok AS context, CAST(count(*) AS BIGINT) AS n
          FROM o a JOIN (SELECT o.*, unnest(generate_series(-20, 20)) AS gap FROM o) b
            ON a.doc_id = b.doc_id AND a.pos = b.pos - b.gap
          WHERE b.gap <> 0 GROUP BY a.tok, b.tok)"""


@register("word_pair_weights", sql=_PAIRS + """,
t AS (SELECT word, sum(n) AS total, count(*) AS contexts FROM pairs GROUP BY word),
w AS (SELECT p.word, ln(CAST(p.n AS DOUBLE) * CAST((SELECT sum(total) FROM t) AS DOUBLE)
               / (CAST(a.total AS DOUBLE) * CAST(b.total AS DOUBLE))) AS weight
      FROM pairs p JOIN t a ON a.word = p.word JOIN t b ON b.word = p.context)
SELECT t.word, CAST(any_value(t.contexts) AS BIGINT) AS contexts, CAST(any_value(t.total) AS BIGINT) AS total,
       CAST(count(w.weight) AS BIGINT) AS weights, round(coalesce(sum(w.weight), 0.0), 6) AS weight
FROM t LEFT JOIN (SELECT * FROM w WHERE weight > 0) w USING (word) GROUP BY t.word""")
def q_word_pair_weights(spark, sf_dir):
    """Co-occurrence counts within 20 tokens on the train split and their positive
    pointwise mutual information, all pairs summed by word."""
    pairs = Wv.context_pairs(train_docs(spark, sf_dir), window=20, packed=True)
    weights = Wv.pair_weights(pairs)
    dropped(pairs.cells)
    return weights.select("word", "contexts", "total", "weights", "weight")


@register("train_word_vectors")
def q_word_vectors(spark, sf_dir):
    """Word vectors (dim 100, window 20, min count 1) of the train split from the
    randomised SVD of the weights above; (word, norm) of every vector.  No SQL:
    tests compare with a dense SVD."""
    v = Wv.word_vectors(train_docs(spark, sf_dir))
    return v.select("word", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
                    .alias("norm"))


def _labelled(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = B.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    return d.join(lab, "doc_id")


@register("train_classifier")
def q_train_classifier(spark, sf_dir):
    """Random forest (100 trees, sqrt features, balanced class weights) on
    bag-of-words features of the labelled train split; predictions on the
    held-out split (rows check)."""
    lab = _labelled(spark, sf_dir)
    sp = Sm.stratified_split(lab, "label", "doc_id", SEED)
    train = sp.where(F.col("split") == "train")
    bow = Fe.bag_of_words(train, min_df=Fe.MIN_DF)
    tr = Fe.with_class_weights(Fe.featurize(bow, train), "label")
    model = Fe.classifier("rf", weight="weight", seed=SEED).fit(tr)
    test = Fe.featurize(bow, sp.where(F.col("split") != "train"))
    from pyspark.ml.functions import vector_to_array
    pred = model.transform(test)
    return pred.select("doc_id", "split", F.col("label").cast("int").alias("target"),
                       F.col("prediction").cast("int").alias("pred"),
                       F.element_at(vector_to_array("probability"), 2).alias("proba"))


@register("classifier_kinds")
def q_classifier_kinds(spark, sf_dir):
    """Decision tree, Gaussian naive Bayes and linear SVM on the same features
    and split as the forest: metrics on the held-out rows, one row per kind."""
    from linesight.session import materialize
    sp = Sm.stratified_split(_labelled(spark, sf_dir), "label", "doc_id", SEED)
    train = sp.where(F.col("split") == "train")
    bow = Fe.bag_of_words(train, min_df=Fe.MIN_DF)
    tr = materialize(Fe.featurize(bow, train).select("label", "features"))
    test = materialize(Fe.featurize(bow, sp.where(F.col("split") != "train")).select("label", "features"))
    rows = None
    for kind in ("dt", "gnb", "svm"):
        pred = Fe.classifier(kind, seed=SEED).fit(tr).transform(test).select(
            F.col("label").cast("int").alias("target"), F.col("prediction").cast("int").alias("pred"))
        m = classification_metrics(pred).withColumn("kind", F.lit(kind))
        rows = m if rows is None else rows.unionByName(m)
    return rows


def _folded(spark, sf_dir):
    return Sm.stratified_kfold(_labelled(spark, sf_dir), "label", "doc_id", SEED, 10)


_FOLDS = f"""
WITH ds AS (SELECT d.doc_id, coalesce(d.text, '') AS text, CAST(l.toxic AS DOUBLE) AS label FROM documents d JOIN labels l USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5(doc_id || ':{SEED}'), 1, 15) AS BIGINT), doc_id) - 1 AS r,
              count(*) OVER (PARTITION BY label) // 10 AS s, count(*) OVER (PARTITION BY label) % 10 AS m FROM ds),
f AS (SELECT doc_id, text, label, CASE WHEN r < m * (s + 1) THEN r // (s + 1) ELSE m + (r - m * (s + 1)) // s END AS fold FROM rk),
occ AS (SELECT doc_id, label, fold, term, count(*) AS x FROM (SELECT doc_id, label, fold, unnest({TERMS}) AS term FROM f) GROUP BY ALL),
st AS (SELECT term, fold, label, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM occ GROUP BY ALL),
h AS (SELECT CAST(range AS BIGINT) AS held FROM range(10)),
size AS (SELECT held, label, count(*) AS n FROM f JOIN h ON fold <> held GROUP BY ALL),
rows_ AS (SELECT held, sum(n) AS n FROM size GROUP BY held),
voc AS (SELECT held, term FROM st JOIN h ON fold <> held GROUP BY ALL HAVING sum(n) >= 20),
tr AS (SELECT voc.held, voc.term, size.label, size.n, coalesce(t.s, 0) AS s, coalesce(t.q, 0) AS q
       FROM voc JOIN size ON size.held = voc.held
       LEFT JOIN (SELECT held, term, label, sum(s) AS s, sum(q) AS q FROM st JOIN h ON fold <> held GROUP BY ALL) AS t
         ON t.held = voc.held AND t.term = voc.term AND t.label = size.label),
extra AS (SELECT held, 1e-9 * max(greatest((CAST(q AS DOUBLE) * n - CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) / (CAST(n AS DOUBLE) * n), 0)) AS e
          FROM (SELECT tr.held, term, sum(s) AS s, sum(q) AS q, max(rows_.n) AS n FROM tr JOIN rows_ ON rows_.held = tr.held GROUP BY ALL) GROUP BY held),
model AS (SELECT tr.held, term, label, CAST(s AS DOUBLE) / n AS mean,
                 greatest((CAST(q AS DOUBLE) * n - CAST(s AS DOUBLE) * CAST(s AS DOUBLE)) / (CAST(n AS DOUBLE) * n), 0) + e AS var
          FROM tr JOIN extra ON extra.held = tr.held),
base AS (SELECT size.held, size.label, ln(size.n / rows_.n) + coalesce(a.absent, 0) AS base
         FROM size JOIN rows_ ON rows_.held = size.held
         LEFT JOIN (SELECT held, label, sum(-0.5 * ln(2 * pi() * var) - mean * mean / (2 * var)) AS absent FROM model GROUP BY ALL) AS a ON a.held = size.held AND a.label = size.label),
score AS (SELECT occ.doc_id, model.label, sum((2 * x * mean - x * x) / (2 * var)) AS score
          FROM occ JOIN model ON model.held = occ.fold AND model.term = occ.term GROUP BY ALL),
pred AS (SELECT f.doc_id, f.fold, CAST(f.label AS BIGINT) AS target, CAST(base.label AS BIGINT) AS pred
         FROM f JOIN base ON base.held = f.fold LEFT JOIN score ON score.doc_id = f.doc_id AND score.label = base.label
         QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY base + coalesce(score, 0) DESC, base.label) = 1)"""


@register("cross_predictions", sql=_FOLDS + """
SELECT doc_id, fold, target, pred FROM pred""")
def q_cross_predictions(spark, sf_dir):
    """Each labelled document's class by the model trained without its fold."""
    pred = Fs.cross_predict(_folded(spark, sf_dir), "label", "fold", 10)
    return pred.select("doc_id", "fold", F.col("target").cast("int").alias("target"), F.col("pred").cast("int").alias("pred"))


@register("fold_statistics", sql=_FOLDS + """
SELECT term, fold, CAST(label AS BIGINT) AS label, n, CAST(s AS BIGINT) AS s, CAST(q AS BIGINT) AS q FROM st""")
def q_fold_statistics(spark, sf_dir):
    """Documents, sum and sum of squares of each term's counts by fold and class."""
    return Fs.fold_statistics(_folded(spark, sf_dir), "label", "fold").withColumn("label", F.col("label").cast("int"))


@register("cross_validate", sql=_FOLDS + """,
c AS (SELECT fold, count_if(target = 0 AND pred = 0) AS tn, count_if(target = 0 AND pred = 1) AS fp,
             count_if(target = 1 AND pred = 0) AS fn, count_if(target = 1 AND pred = 1) AS tp FROM pred GROUP BY fold),
p AS (SELECT fold, (tp + tn) / (tn + fp + fn + tp) AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS tnr FROM c),
m AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
             CASE WHEN 4 * precision + recall = 0 THEN 0.0 ELSE 5 * precision * recall / (4 * precision + recall) END AS f2,
             (recall + tnr) / 2 AS roc_auc FROM p),
long AS (SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'f2', 'roc_auc']) AS metric, unnest([accuracy, precision, recall, f1, f2, roc_auc]) AS value FROM m)
SELECT 'gnb' AS method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM long GROUP BY metric""")
def q_cross_validate(spark, sf_dir):
    """10-fold stratified cross-validation of Gaussian naive Bayes on bag-of-words
    features (vocabulary of the training folds); mean and population std of the
    fold metrics.  All ten models come from one count by fold."""
    from linesight.session import materialize
    pred = materialize(Fs.cross_predict(_folded(spark, sf_dir), "label", "fold", 10))
    rows = None
    for k in range(10):
        m = classification_metrics(pred.where(F.col("fold") == k)).withColumn("fold", F.lit(k))
        rows = m if rows is None else rows.unionByName(m)
    metrics = ["accuracy", "precision", "recall", "f1", "f2", "roc_auc"]
    return U.fold_summary(rows.withColumn("method", F.lit("gnb")), metrics, ["method"])


@register("score_batches", sql=S.PREDS + """
SELECT doc_id, round(proba, 6) AS score FROM preds""")
def q_score_batches(spark, sf_dir):
    """A numpy batch predictor applied in Arrow batches (here the document
    probability model n / (n + 1000) of the bindings)."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    d = d.join(B.table(spark, sf_dir, "labels").select("doc_id"), "doc_id")

    def predictor(pdf):
        n = pdf["n_chars"].to_numpy(dtype="float64")
        return n / (n + 1000.0)
    return Fe.score_batches(d, ["n_chars"], predictor, "score", batch_size=256).select("doc_id", "score")


def _token_weights(spark, sf_dir):
    """Linear token scorer trained on the labelled documents: smoothed log
    ratio of a token's frequency in positive vs negative documents."""
    lab = _labelled(spark, sf_dir)
    t = lab.select(F.col("label"), F.explode(T.word_tokens("text")).alias("tok"))
    c = t.groupBy("tok").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"),
                             F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("n"))
    return c.select("tok", F.log((F.col("p") + 1.0) / (F.col("n") + 1.0)).alias("weight"))


@register("perturbation_attribution")
def q_attribution(spark, sf_dir):
    """Top-20 token attributions of every actual-positive labelled document
    (50 perturbed samples each; rows check: hash-seeded samples)."""
    docs = _labelled(spark, sf_dir).where(F.col("label") == 1).select("doc_id", "text")
    return At.attribute(docs, _token_weights(spark, sf_dir), seed=SEED)


_ROUGE = S.GEN + """,
pt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pred_pos) AS t FROM preds GROUP BY doc_id),
lt AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_idx) FILTER (WHERE hit = 1 AND target = 1) AS t
       FROM plines GROUP BY doc_id),
rr AS (SELECT lt.doc_id, regexp_extract_all(lower(coalesce(pt.t, '')), '[a-z0-9]+') AS p,
              regexp_extract_all(lower(coalesce(lt.t, '')), '[a-z0-9]+') AS r
       FROM lt LEFT JOIN pt USING (doc_id)),
g AS (
  SELECT doc_id, 'p' AS side, 1 AS n, unnest(p) AS gram FROM rr
  UNION ALL SELECT doc_id, 'r', 1, unnest(r) FROM rr
  UNION ALL SELECT doc_id, 'p', 2, unnest(list_transform(generate_series(1, len(p) - 1),
                                                          lambda i: p[i] || ' ' || p[i + 1])) FROM rr WHERE len(p) >= 2
  UNION ALL SELECT doc_id, 'r', 2, unnest(list_transform(generate_series(1, len(r) - 1),
                                                          lambda i: r[i] || ' ' || r[i + 1])) FROM rr WHERE len(r) >= 2
),
gc AS (SELECT doc_id, n, gram, count_if(side = 'p') AS cp, count_if(side = 'r') AS cr FROM g GROUP BY ALL),
o AS (SELECT doc_id, n, sum(least(cp, cr)) AS ov, sum(cp) AS pn, sum(cr) AS rn FROM gc GROUP BY ALL),
f AS (
  SELECT doc_id, n, CASE WHEN pn > 0 THEN ov / pn ELSE 0.0 END AS pp,
         CASE WHEN rn > 0 THEN ov / rn ELSE 0.0 END AS rc FROM o
),
ff AS (SELECT doc_id, n, CASE WHEN pp + rc > 0 THEN 2 * pp * rc / (pp + rc) ELSE 0.0 END AS fm FROM f)"""


@register("rouge_n", sql=_ROUGE + """
SELECT rr.doc_id, round(coalesce(a.fm, 0.0), 6) AS rouge1_f, round(coalesce(b.fm, 0.0), 6) AS rouge2_f
FROM rr LEFT JOIN ff a ON a.doc_id = rr.doc_id AND a.n = 1 LEFT JOIN ff b ON b.doc_id = rr.doc_id AND b.n = 2""")
def q_rouge_n(spark, sf_dir):
    """ROUGE-1 / ROUGE-2 F between predicted lines and the labelled lines."""
    return _rouge_scores(spark, sf_dir)


def _rouge_scores(spark, sf_dir):
    from linesight.operators import generated as Gn
    pos = B.generated_positives(spark, sf_dir).select("doc_id", "label_text")
    pt = Gn.pred_text(B.positive_preds(spark, sf_dir), out="pred_text")
    return Rg.rouge_n(pos.join(pt, "doc_id", "left"), "pred_text", "label_text", n=(1, 2))


@register("rouge_mean", sql=_ROUGE + """
SELECT round(avg(coalesce(a.fm, 0.0)), 6) AS rouge1_f, round(avg(coalesce(b.fm, 0.0)), 6) AS rouge2_f
FROM rr LEFT JOIN ff a ON a.doc_id = rr.doc_id AND a.n = 1 LEFT JOIN ff b ON b.doc_id = rr.doc_id AND b.n = 2""")
def q_rouge_mean(spark, sf_dir):
    """Mean ROUGE-1 / ROUGE-2 F over all rows."""
    return Rg.rouge_means(_rouge_scores(spark, sf_dir))


@register("rouge_l")
def q_rouge_l(spark, sf_dir):
    """ROUGE-L and ROUGE-Lsum F (LCS in an Arrow-batched pandas UDF)."""
    from linesight.operators import generated as Gn
    pos = B.generated_positives(spark, sf_dir).select("doc_id", "label_text")
    pt = Gn.pred_text(B.positive_preds(spark, sf_dir), out="pred_text")
    return Rg.rouge_l(pos.join(pt, "doc_id", "left"), "pred_text", "label_text")


@register("select_best_epoch", sql="""
WITH logs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         value AS score FROM events
),
imp AS (
  SELECT *, (max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             IS NULL OR score > max(score) OVER (PARTITION BY run ORDER BY epoch
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS improved
  FROM logs
),
li AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch
                                                                ROWS UNBOUNDED PRECEDING) AS last_imp FROM imp),
st AS (SELECT run, min(epoch) AS stop_epoch FROM li WHERE epoch - last_imp >= 5 GROUP BY run),
kept AS (SELECT li.* FROM li LEFT JOIN st USING (run) WHERE st.stop_epoch IS NULL OR li.epoch <= st.stop_epoch)
SELECT run, CAST(arg_max(epoch, (score, -epoch)) AS BIGINT) AS best_epoch, round(max(score), 6) AS best_score,
       CAST(max(epoch) AS BIGINT) AS last_epoch
FROM kept GROUP BY run""")
def q_best_epoch(spark, sf_dir):
    """Early stopping (patience 5) over per-epoch logs: run = user, epoch =
    event order, validation score = value."""
    ev = B.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    logs = ev.select(F.col("user_id").alias("run"), F.row_number().over(w).alias("epoch"),
                     F.col("value").alias("score"))
    return U.select_best_epoch(logs)


@register("sort_desc", sql=S.SCORED + """
SELECT doc_id, CAST(rnk AS BIGINT) AS rank, line_idx FROM ranked WHERE rnk <= 3""")
def q_sort_desc(spark, sf_dir):
    """Top-3 lines of every document by score (a per-document top-k report)."""
    from linesight.operators import ranking as R
    ranked = R.rank_lines_by_score(B.scored_lines(spark, sf_dir))
    return ranked.where(F.col("rank") <= 3).select("doc_id", "rank", "line_idx")



