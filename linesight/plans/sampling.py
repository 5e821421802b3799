"""Step 6: splits, folds and rebalancing over the labelled documents
(class = labels.toxic).  Rows are chosen by a seeded md5 key that SQL can
repeat, so the oracles check the chosen rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.functions import text as T
from linesight.operators import sampling as Sm
from linesight.operators import synthetic as Sy
from linesight.operators.matching import with_row_index
from linesight.plans import bindings as B
from linesight.plans.registry import register

SEED = Sm.SEEDS[0]

_LAB = """
WITH ds AS (SELECT d.doc_id, d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT label, count(*) AS n FROM ds GROUP BY label)"""


def labelled(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = B.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return d.join(lab, "doc_id")


def _counts(df, *keys):
    """Rows and different documents of each cell: the quotas, and that no
    document is in a cell twice."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("doc_id").alias("ids"))


_KEY = f"CAST('0x' || substr(md5(doc_id || ':{SEED}'), 1, 15) AS BIGINT)"
_RANK = _LAB + f""",
r AS (SELECT doc_id, CAST(label AS BIGINT) AS label, n, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, doc_id) AS r
      FROM ds JOIN c USING (label))"""


@register("positional_split", sql=_LAB + """,
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ri, count(*) OVER () AS n FROM ds)
SELECT doc_id, CASE WHEN ri >= n - CAST(floor(0.1 * n) AS BIGINT) THEN 'test'
                    WHEN ri >= n - 2 * CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'train' END AS split
FROM r""")
def q_positional(spark, sf_dir):
    return Sm.positional_split(labelled(spark, sf_dir), "doc_id").select("doc_id", "split")


@register("stratified_split", sql=_RANK + """,
q AS (SELECT *, CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) AS t FROM r),
q2 AS (SELECT *, CAST(ceil(CAST(0.1 AS DOUBLE) * (n - t)) AS BIGINT) AS v FROM q)
SELECT doc_id, label, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM q2""")
def q_stratified(spark, sf_dir):
    return Sm.stratified_split(labelled(spark, sf_dir), "label", "doc_id", SEED).select("doc_id", "label", "split")


@register("stratified_kfold", sql=_RANK + """
SELECT doc_id, label, CASE WHEN r <= n % 10 * (n // 10 + 1) THEN (r - 1) // (n // 10 + 1)
                           ELSE n % 10 + (r - 1 - n % 10 * (n // 10 + 1)) // (n // 10) END AS fold FROM r""")
def q_kfold(spark, sf_dir):
    return Sm.stratified_kfold(labelled(spark, sf_dir), "label", "doc_id", SEED, 10).select("doc_id", "label", "fold")


_BAL = _LAB + """,
mm AS (SELECT max(n) AS maj, min(n) AS mino, count(*) AS k FROM c),
majc AS (SELECT label FROM c, mm WHERE n = maj ORDER BY label DESC LIMIT 1)"""
_CUT = _RANK + """,
mm AS (SELECT max(n) AS maj, min(n) AS mino, count(*) AS k FROM c),
majc AS (SELECT label FROM c, mm WHERE n = maj ORDER BY label DESC LIMIT 1)
SELECT doc_id, label FROM r, mm WHERE NOT (k = 2 AND label = (SELECT label FROM majc)) OR r <= """


@register("undersample_ratio", sql=_CUT + "least(n, 4 * mino)")
def q_under_ratio(spark, sf_dir):
    return Sm.undersample(labelled(spark, sf_dir), "label", "doc_id", SEED, ratio=4.0).select("doc_id", "label")


@register("undersample_half", sql=_CUT + "n // 2")
def q_under_half(spark, sf_dir):
    return Sm.undersample(labelled(spark, sf_dir), "label", "doc_id", SEED, ratio=None, fraction=0.5).select("doc_id", "label")


@register("oversample_random", sql=_BAL + """
SELECT CAST(label AS BIGINT) AS label, CAST(maj AS BIGINT) AS count, CAST(n AS BIGINT) AS ids FROM c, mm""")
def q_over(spark, sf_dir):
    return _counts(Sm.oversample(labelled(spark, sf_dir), "label", "doc_id", SEED), "label")


@register("stratified_exact_sample", sql=_LAB + f""",
l AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9@]'))) > 0 AS flawed FROM ds),
r AS (SELECT doc_id, label, {_KEY} AS key, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, doc_id) AS r FROM l WHERE label = 0 OR flawed),
s AS (SELECT * FROM r WHERE r <= CASE WHEN label = 0 THEN 100 ELSE 50 END)
SELECT doc_id, CAST(label AS BIGINT) AS label, row_number() OVER (ORDER BY key, doc_id) - 1 AS place FROM s""")
def q_exact_sample(spark, sf_dir):
    """100 negatives and 50 positives that have flawed lines, then shuffled: each
    row with its place in the shuffled order."""
    flawed = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(B.FLAW_PATTERN))
    rows = labelled(spark, sf_dir).select("doc_id", "label", F.array_join(F.transform(flawed, lambda x: F.lit("x")), ",").alias("lines"))
    s = Sm.exact_sample(rows, "label", "doc_id", SEED, {0: 100, 1: 50}, lines="lines").select("doc_id", "label")
    return with_row_index(s, [Sm.seeded_key("doc_id", SEED), F.col("doc_id")], "place")


@register("augment_minority", sql=_BAL + """
SELECT CAST(label AS BIGINT) AS label,
       CAST(CASE WHEN label = 1 THEN n * (1 + ((SELECT max(n) FROM c WHERE label <> 1) - n) // n)
                 ELSE n END AS BIGINT) AS count, CAST(n AS BIGINT) AS ids
FROM c""")
def q_augment(spark, sf_dir):
    return _counts(Sm.augment_minority(labelled(spark, sf_dir), "text", "label", "doc_id", SEED), "label")


@register("seeded_shuffle", sql=_LAB + """
SELECT doc_id, CAST(label AS BIGINT) AS label FROM ds""")
def q_shuffle(spark, sf_dir):
    """Reproducible shuffle of the labelled documents: a permutation of them."""
    s = Sm.seeded_shuffle(labelled(spark, sf_dir).select("doc_id", "label"), "doc_id", SEED)
    return s


_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> ''))"


@register("perturb_delete", sql=_LAB + f"""
SELECT doc_id, CAST({_WORDS} AS BIGINT) AS n_before, CAST(1 AS BIGINT) AS bounded, CAST(1 AS BIGINT) AS only_own FROM ds""")
def q_perturb_delete(spark, sf_dir):
    """Word deletion (p = 0.3, 1..10 words) on every labelled document: words
    before, whether 1 to 10 (or all) went, and whether only own words are left."""
    d = labelled(spark, sf_dir)
    d = d.select("doc_id", T.word_tokens(F.coalesce("text", F.lit(""))).alias("toks"))
    d = d.select("doc_id", "toks", Sm.perturb_delete(F.col("toks"), SEED, F.xxhash64("doc_id")).alias("out"))
    gone = F.size("toks") - F.size("out")
    return d.select("doc_id", F.size("toks").alias("n_before"),
                    ((gone >= F.least(F.lit(1), F.size("toks"))) & (gone <= 10)).cast("int").alias("bounded"),
                    (F.size(F.array_except("out", "toks")) == 0).cast("int").alias("only_own"))


@register("perturb_synonym", sql=_LAB + f"""
SELECT doc_id, CAST({_WORDS} AS BIGINT) AS n_tokens, CAST(1 AS BIGINT) AS bounded, CAST(1 AS BIGINT) AS same_but_case FROM ds""")
def q_perturb_synonym(spark, sf_dir):
    """Synonym substitution (p = 0.3, 1..10 words) on every labelled document;
    synonyms = other-case spellings of a word in the corpus, so the words are
    the same but for their case, and at most 10 differ."""
    d = labelled(spark, sf_dir)
    syn = Sm.case_variant_synonyms(B.table(spark, sf_dir, "documents"), "text")
    out = Sm.perturb_synonym(d.withColumn("before", F.col("text")), syn, "text", "doc_id", SEED)
    before, after = T.word_tokens(F.coalesce("before", F.lit(""))), T.word_tokens("text")
    return out.select("doc_id", F.size(after).alias("n_tokens"),
                      F.col("replaced").between(0, 10).cast("int").alias("bounded"),
                      (F.lower(F.array_join(before, " ")) == F.lower(F.array_join(after, " "))).cast("int")
                      .alias("same_but_case"))


_VECS = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, CAST(label = 0 AS BIGINT) AS own FROM embeddings),
pts AS (SELECT vec_id, x FROM v WHERE own = 1),
near AS (SELECT a.vec_id, b.vec_id AS to_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
         FROM pts AS a JOIN pts AS b ON a.vec_id <> b.vec_id),
lists AS (SELECT vec_id, list(to_id ORDER BY rank) AS near FROM near WHERE rank <= 5 GROUP BY vec_id),
place AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM pts),
total AS (SELECT count_if(own = 0) AS most, count_if(own = 1) AS n FROM v)"""


def _hash(*parts):
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 15) AS BIGINT)"


_MADE = f"""
SELECT CAST(d.draw AS VARCHAR) AS draw, d.base, d.neighbour, round(d.u, 6) AS u, round(a.x[1] + d.u * (b.x[1] - a.x[1]), 6) AS first,
       round(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] + d.u * (b.x[i] - a.x[i]))), 6) AS total
FROM (SELECT draw, base, near[1 + {_hash("'neighbour'", "draw", f"'{SEED}'")} % len(near)] AS neighbour,
             ({_hash("'gap'", "draw", f"'{SEED}'")} % 1073741824) / 1073741824.0 AS u FROM draws JOIN lists ON lists.vec_id = draws.base) AS d
JOIN pts AS a ON a.vec_id = d.base JOIN pts AS b ON b.vec_id = d.neighbour"""


def _vectors(spark, sf_dir):
    """embeddings as vectors of two classes: label 0 is the minority."""
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("int").alias("own"))


def _made(df):
    return df.select(F.col("draw").cast("string").alias("draw"), "base", "neighbour", "u", F.element_at("x", 1).alias("first"),
                     F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


@register("smote", sql=_VECS + f""",
draws AS (SELECT d.draw, p.vec_id AS base FROM (SELECT range AS draw, {_hash("'base'", "range", f"'{SEED}'")} AS h FROM range((SELECT CAST(greatest(most - n, 0) AS BIGINT) FROM total))) AS d
          JOIN place AS p ON p.place = d.h % p.n)""" + _MADE)
def q_smote(spark, sf_dir):
    """Synthetic vectors of the smaller class up to the size of the larger."""
    return _made(Sy.smote(_vectors(spark, sf_dir), "x", "own", "vec_id", SEED))


_SHARES = """,
all_near AS (SELECT a.vec_id, b.own, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
             FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.own = 1),
others AS (SELECT vec_id, count_if(own = 0) AS others FROM all_near WHERE rank <= 5 GROUP BY vec_id),
w AS (SELECT sum(others) AS w FROM others),
part AS (SELECT vec_id, others, CASE WHEN w = 0 THEN 0 ELSE (most - n) * others // w END AS whole, CASE WHEN w = 0 THEN 0 ELSE (most - n) * others % w END AS rest,
                CASE WHEN w = 0 THEN 0 ELSE most - n END AS total FROM others, w, total),
shares AS (SELECT vec_id AS id, others, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, vec_id) <= total - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM part)"""


@register("adasyn_shares", sql=_VECS + _SHARES + """
SELECT id, CAST(others AS BIGINT) AS others, n FROM shares""")
def q_adasyn_shares(spark, sf_dir):
    """Neighbours of the other class and synthetic rows of each minority vector."""
    return Sy.adasyn_shares(_vectors(spark, sf_dir), "x", "own", "vec_id", 1)


@register("adasyn", sql=_VECS + _SHARES + """,
draws AS (SELECT id || ':' || j AS draw, id AS base FROM (SELECT id, unnest(range(1, n + 1)) AS j FROM shares))""" + _MADE)
def q_adasyn(spark, sf_dir):
    """Synthetic vectors of the smaller class, more of them where the other one is near."""
    return _made(Sy.adasyn(_vectors(spark, sf_dir), "x", "own", "vec_id", SEED, 1))


_WORD_LIST = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '')"
_DIMS = ", ".join(f"CAST('0x' || substr(md5(word), {4 * i + 1}, 4) AS BIGINT) - 32767.5" for i in range(8))
_NEAR_WORDS = f"""
WITH ds AS (SELECT d.doc_id, d.text FROM documents d JOIN labels l USING (doc_id)),
voc AS (SELECT word, [{_DIMS}] AS x FROM (SELECT unnest({_WORD_LIST}) AS word FROM documents) GROUP BY word HAVING count(*) >= 30),
unit AS (SELECT word, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x FROM voc),
near AS (SELECT a.word, b.word AS other, row_number() OVER (PARTITION BY a.word ORDER BY list_distance(a.x, b.x), b.word) AS rank
         FROM unit AS a JOIN unit AS b ON a.word <> b.word),
lists AS (SELECT word, list(other ORDER BY rank) AS near FROM near WHERE rank <= 10 GROUP BY word)"""


def _word_vectors(spark, sf_dir):
    """Vectors of the words that stand 30 times or more, eight numbers from the
    digits of the word's md5 (any vector table will do; this one SQL can repeat)."""
    words = B.table(spark, sf_dir, "documents").select(F.explode(T.word_tokens(F.coalesce("text", F.lit("")))).alias("word"))
    voc = words.groupBy("word").count().where("count >= 30")
    return voc.select("word", F.array(*[F.conv(F.substring(F.md5("word"), 4 * i + 1, 4), 16, 10).cast("double") - 32767.5 for i in range(8)]).alias("vector"))


@register("word_neighbours", sql=_NEAR_WORDS + """
SELECT word AS tok, array_to_string(near, ' ') AS neighbours FROM lists""")
def q_word_neighbours(spark, sf_dir):
    """The ten words with the largest cosine to each word of a vector table."""
    return Sm.word_neighbours(_word_vectors(spark, sf_dir)).select("tok", F.array_join("neighbours", " ").alias("neighbours"))


@register("perturb_neighbour", sql=_NEAR_WORDS + f""",
occ AS (SELECT doc_id, unnest({_WORD_LIST}) AS tok, unnest(range(len({_WORD_LIST}))) AS pos FROM ds),
cand AS (SELECT doc_id, pos, tok, near[1 + {_hash("'neighbour'", "doc_id", "pos", f"'{SEED}'")} % len(near)] AS new,
                ({_hash("'word'", "doc_id", "pos", f"'{SEED}'")} % 1000000) / 1000000.0 AS u FROM occ JOIN lists ON lists.word = occ.tok),
many AS (SELECT doc_id, least(greatest(count_if(u < 0.3), 1), 10) AS m FROM cand GROUP BY doc_id),
gone AS (SELECT doc_id, pos, new FROM cand JOIN many USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY u, pos) <= m),
made AS (SELECT occ.doc_id, string_agg(coalesce(gone.new, tok), ' ' ORDER BY occ.pos) AS t, count(gone.pos) AS c
         FROM occ LEFT JOIN gone ON gone.doc_id = occ.doc_id AND gone.pos = occ.pos GROUP BY occ.doc_id)
SELECT ds.doc_id, coalesce(t, '') AS text, CAST(coalesce(c, 0) AS BIGINT) AS replaced FROM ds LEFT JOIN made ON made.doc_id = ds.doc_id""")
def q_perturb_neighbour(spark, sf_dir):
    """Labelled documents with 1 to 10 words replaced by near words."""
    docs = labelled(spark, sf_dir).select("doc_id", "text")
    return Sm.perturb_neighbour(docs, _word_vectors(spark, sf_dir), "text", "doc_id", SEED)
