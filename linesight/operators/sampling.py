"""Splits, folds and class rebalancing without per-class windows.

Classes are heavily skewed (the majority class can be almost all rows), so a
``Window.partitionBy(label)`` would put a whole class in one task.  A class is
ordered by a seeded 60-bit key of the id (md5, so any engine can repeat it) and
the id.  Splits, folds and samples only need the rows at some ranks of that
order: a histogram of the keys finds the bucket of each, one bucket is sorted,
and the rows themselves are told apart by a narrow comparison with the keys
found.  No row is shuffled, whatever its width.  The order is reproducible under
any partitioning (unlike ``rand``), and every quota is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linesight.operators.global_order import with_global_position

# Fixed seeds of the studied runs (seed index 0-9).
SEEDS = [123456, 789012, 345678, 901234, 567890, 123, 456, 789, 135, 680]


def draw(*parts):
    """Seeded 60-bit number of some values: the first 15 hex digits of the md5 of
    the values joined by colons."""
    text = F.concat_ws(":", *[(p if hasattr(p, "cast") else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def seeded_key(id_col: str, seed: int):
    return draw(F.col(id_col), seed)


KEY_BITS, BUCKET_BITS = 60, 12


def class_cuts(df: DataFrame, label: str, id_col: str, seed: int, ranks: dict) -> dict:
    """{class: [(key, id), ...]}: the rows at the wanted ranks (1-based) of the
    seeded order of each class (``ranks``: {class: [rank, ...]}, each at most the
    class's size).  One pass counts keys by bucket, another sorts the buckets
    that hold a wanted rank; ids are unique."""
    spark, wanted = df.sparkSession, [(c, r) for c, rs in ranks.items() for r in rs if r > 0]
    if not wanted:
        return {c: [] for c in ranks}
    bucket = F.shiftright("_k", KEY_BITS - BUCKET_BITS)
    keyed = df.select(F.col(label).alias("_label"), F.col(id_col).alias("_id"), seeded_key(id_col, seed).alias("_k")).withColumn("_b", bucket)
    counts = keyed.groupBy("_label", "_b").count()
    before = F.sum("count").over(Window.partitionBy("_label").orderBy("_b")) - F.col("count")      # at most 2 ** BUCKET_BITS rows a class
    schema = Ty.StructType([Ty.StructField("_c", df.schema[label].dataType), Ty.StructField("_rank", Ty.LongType())])
    asked = spark.createDataFrame(wanted, schema)
    hit = F.col("_label").eqNullSafe(F.col("_c")) & (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("count"))
    at = counts.withColumn("_before", before).join(F.broadcast(asked), hit).select("_label", "_b", "_rank", (F.col("_rank") - F.col("_before")).alias("_place"))
    at = [tuple(r) for r in at.collect()]                                                          # one row a wanted rank
    buckets = F.lit(False)
    for c, b in {(c, b) for c, b, _, _ in at}:
        buckets = buckets | (F.col("_label").eqNullSafe(F.lit(c)) & (F.col("_b") == b))
    place = F.row_number().over(Window.partitionBy("_label", "_b").orderBy("_k", "_id"))
    rows = keyed.where(buckets).withColumn("_place", place)
    exact = F.lit(False)
    for c, b, _, p in at:
        exact = exact | (F.col("_label").eqNullSafe(F.lit(c)) & (F.col("_b") == b) & (F.col("_place") == p))
    found = {(r["_label"], r["_b"], r["_place"]): (r["_k"], r["_id"]) for r in rows.where(exact).collect()}
    by_rank = {(c, r): found[c, b, p] for c, b, r, p in at}
    return {c: [by_rank[c, r] for r in rs if r > 0] for c, rs in ranks.items()}


def _within(cut: tuple, label: str, cls, id_col: str, seed: int):
    """Rows of a class up to a row of ``class_cuts``."""
    key = seeded_key(id_col, seed)
    return F.col(label).eqNullSafe(F.lit(cls)) & ((key < cut[0]) | ((key == cut[0]) & (F.col(id_col) <= F.lit(cut[1]))))


def _first_rows(df: DataFrame, label: str, id_col: str, seed: int, quotas: dict, counts: dict):
    """Whether a row is among the first quotas[c] of its class (all, if there are fewer)."""
    cuts = class_cuts(df, label, id_col, seed, {c: [min(q, counts[c])] for c, q in quotas.items() if c in counts})
    kept = F.lit(False)
    for c, cut in cuts.items():
        for one in cut:
            kept = kept | _within(one, label, c, id_col, seed)
    return kept


def seeded_shuffle(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Reproducible shuffle: global order by hash(id, seed), ties by id."""
    return df.orderBy(seeded_key(id_col, seed), F.col(id_col))


def class_counts(df: DataFrame, label: str) -> dict:
    """{class: rows}; one row per class, so a bounded collect."""
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


def class_rank(df: DataFrame, label: str, id_col: str, seed: int,
               counts: dict | None = None) -> tuple[DataFrame, dict]:
    """Adds ``crank`` (1-based rank inside the class in seeded order); ids are unique."""
    counts = counts if counts is not None else class_counts(df, label)
    starts, acc = {}, 0
    for c in sorted(counts, key=lambda v: (v is None, v)):
        starts[c] = acc
        acc += counts[c]
    start_col = F.lit(0)
    for c, s in starts.items():
        start_col = F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(s)).otherwise(start_col)
    # only keys go through the global sort; the rows meet their rank by id
    zero = df.select(label, id_col).withColumn("_z", F.lit(0))
    pos = with_global_position(zero, [F.col(label).asc_nulls_last(), seeded_key(id_col, seed),
                                      F.col(id_col)], hit="_z")
    ranks = pos.select(F.col(id_col).alias("_rank_id"), (F.col("pos") - start_col).alias("crank"))
    ranked = df.join(ranks, F.col(id_col).eqNullSafe(F.col("_rank_id"))).drop("_rank_id")
    return ranked, counts


def positional_split(df: DataFrame, order: str, frac: float = 0.1) -> DataFrame:
    """k = int(frac * n): test = last k rows, val = the k before, train = rest
    (k = 0 gives empty val and test).  ``order`` is unique.

    Only the order column is sorted, to find the first key of val and of test;
    the rows themselves are split by a narrow comparison (a null key sorts
    first)."""
    keys = df.select(order).withColumn("_z", F.lit(0))
    n = df.count()
    k = int(frac * n)
    if k == 0:
        return df.withColumn("split", F.lit("train"))
    pos = with_global_position(keys, [F.col(order).asc()], hit="_z")
    first = {r["pos"]: r[order] for r in pos.where(F.col("pos").isin(n - 2 * k + 1, n - k + 1)).collect()}   # two rows

    def from_(key):   # rows at or after the boundary key; a null boundary is before all others
        return F.lit(True) if key is None else F.coalesce(F.col(order) >= F.lit(key), F.lit(False))
    return df.withColumn("split", F.when(from_(first[n - k + 1]), F.lit("test"))
                         .when(from_(first[n - 2 * k + 1]), F.lit("val")).otherwise(F.lit("train")))


def split_quotas(n: int, test: float, val: float) -> tuple[int, int]:
    """Per-class quotas: test = ceil(test * n), val = ceil(val * (n - test))."""
    t = math.ceil(test * n)
    return t, math.ceil(val * (n - t))


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int, test: float = 0.1,
                     val: float = 0.1) -> DataFrame:
    """test = the first ceil(test * n) rows of each class, val = the next
    ceil(val * rest), train = the others."""
    counts = class_counts(df, label)
    quotas = {c: split_quotas(n, test, val) for c, n in counts.items()}
    is_test = _first_rows(df, label, id_col, seed, {c: t for c, (t, _) in quotas.items()}, counts)
    is_either = _first_rows(df, label, id_col, seed, {c: t + v for c, (t, v) in quotas.items()}, counts)
    return df.withColumn("split", F.when(is_test, "test").when(is_either, "val").otherwise("train"))


def stratified_kfold(df: DataFrame, label: str, id_col: str, seed: int, k: int = 10) -> DataFrame:
    """k runs of each class's seeded order, the first n mod k of them one longer:
    every fold gets each class evenly."""
    counts = class_counts(df, label)
    ends = {c: [sum(n // k + (f < n % k) for f in range(to + 1)) for to in range(k - 1)] for c, n in counts.items()}
    cuts = class_cuts(df, label, id_col, seed, ends)
    fold = F.lit(0)
    for c, own in cuts.items():
        empty = sum(1 for e in ends[c] if e == 0)
        beyond = F.lit(empty)
        for cut in own:
            beyond = beyond + (~_within(cut, label, c, id_col, seed)).cast("int")
        fold = F.when(F.col(label).eqNullSafe(F.lit(c)), beyond).otherwise(fold)
    return df.withColumn("fold", fold)


def undersample(df: DataFrame, label: str, id_col: str, seed: int, ratio: float | None = 4.0,
                fraction: float | None = None) -> DataFrame:
    """Cut the majority class to ratio x minority (two classes only), or to
    int(fraction x majority)."""
    counts = class_counts(df, label)
    if len(counts) != 2:
        return df
    maj = max(counts, key=lambda c: (counts[c], str(c)))
    mino = min(counts, key=lambda c: (counts[c], str(c)))
    if fraction is not None:
        quota = int(counts[maj] * fraction)
    else:
        quota = min(counts[maj], int(ratio * counts[mino]))
    return df.where(~F.col(label).eqNullSafe(F.lit(maj)) | _first_rows(df, label, id_col, seed, {maj: quota}, counts))


def oversample(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """Random over-sampling with replacement: every smaller class gets
    (majority - n_c) extra draws; draw j picks the row of class rank
    1 + hash(j, seed) mod n_c.  Draw ids come from ``spark.range`` sized by the
    class counts, so the work is distributed and the size exact."""
    counts = class_counts(df, label)
    maj_n = max(counts.values(), default=0)
    spark = df.sparkSession
    smaller = F.lit(False)          # only they are ranked and moved
    for c, n in counts.items():
        smaller = smaller | (F.col(label).eqNullSafe(F.lit(c)) if n < maj_n else F.lit(False))
    ranked, _ = class_rank(df.where(smaller), label, id_col, seed, {c: n for c, n in counts.items() if n < maj_n})
    extra = None
    for c, n in counts.items():
        need = maj_n - n
        if need <= 0 or n == 0:
            continue
        draws = spark.range(need).select(
            F.lit(c).cast(df.schema[label].dataType).alias(label),
            (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)) + 1).alias("crank"))
        extra = draws if extra is None else extra.unionByName(draws)
    base = df
    if extra is None:
        return base
    drawn = extra.select(F.col(label).alias("_drawn_label"), F.col("crank").alias("_drawn"))
    picked = drawn.join(ranked, F.col("_drawn_label").eqNullSafe(F.col(label)) & (F.col("_drawn") == F.col("crank")))
    return base.unionByName(picked.select(*base.columns))


def exact_sample(df: DataFrame, label: str, id_col: str, seed: int, quotas: dict,
                 lines: str | None = None, positive=1) -> DataFrame:
    """Exactly quotas[c] rows (or all) of each class, in seeded order.  With
    ``lines`` (a column of line labels), only positives that have any are drawn."""
    if lines is not None:
        has = F.col(lines).isNotNull() & (F.col(lines).cast("string") != "")
        df = df.where(~F.col(label).eqNullSafe(F.lit(positive)) | has)
    return df.where(_first_rows(df, label, id_col, seed, quotas, class_counts(df, label)))


def perturb_delete(tokens, seed: int, key, p: float = 0.3, max_n: int = 10):
    """Delete words with probability p (hash-decided per position), at least
    one and at most max_n deletions per text: the k positions with the
    smallest draws go, k = clamp(#draws < p, 1, max_n).  Sorts and slices
    only, so no lambda reads an outer array (no per-element recomputation)."""
    scored = F.transform(tokens, lambda t, i: F.struct(
        (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1000000)) / 1000000.0).alias("u"),
        i.alias("i"), t.alias("t")))
    n = F.size(scored)
    k = F.least(F.greatest(F.size(F.filter(scored, lambda s: s["u"] < p)), F.lit(1)),
                F.lit(max_n), n)
    kept = F.slice(F.array_sort(scored), k + 1, F.greatest(n - k, F.lit(0)))
    kept = F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t"))))
    return F.transform(kept, lambda s: s["t"])


def augment_minority(df: DataFrame, text: str, label: str, id_col: str, seed: int,
                     minority=1) -> DataFrame:
    """Append (n_maj - n_min) // n_min perturbed copies of every minority row,
    labelled as minority; perturbation = word deletion (copy-specific hash)."""
    from linesight.functions import text as T
    counts = class_counts(df, label)
    if len(counts) < 2 or counts.get(minority, 0) == 0:
        return df
    n_min = counts[minority]
    n_maj = max(v for c, v in counts.items() if c != minority)
    copies = (n_maj - n_min) // n_min
    if copies <= 0:
        return df
    m = df.where(F.col(label) == F.lit(minority)).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    key = F.xxhash64(F.col(id_col), F.col("_copy"))
    new_text = F.array_join(perturb_delete(T.word_tokens(text), seed, key), " ")
    aug = m.withColumn(text, new_text).drop("_copy")
    return df.unionByName(aug.select(*df.columns))


def perturb_synonym(docs: DataFrame, synonyms: DataFrame, text: str, id_col: str, seed: int,
                    p: float = 0.3, max_n: int = 10) -> DataFrame:
    """Replace words that have a synonym (``synonyms(tok, syn)``, one row per
    word): each candidate occurrence draws u = hash(doc, pos, seed); the k
    candidates with the smallest draws are replaced, k = clamp(#(u < p), 1,
    max_n).  The per-document choice is a window over that document's
    candidates only; the text is rebuilt from its own tokens."""
    from linesight.functions import text as T
    from linesight.operators.cleaning import _token_join
    occ = docs.select(id_col, F.posexplode(T.word_tokens(text)).alias("pos", "tok"))
    cand = _token_join(occ, synonyms.select("tok", "syn"), id_col)
    cand = cand.withColumn("u", F.pmod(F.xxhash64(id_col, "pos", F.lit(seed)), F.lit(1000000))
                           / 1000000.0)
    w_all = Window.partitionBy(id_col)
    w_ord = Window.partitionBy(id_col).orderBy("u", "pos")
    cand = (cand.withColumn("_k", F.least(F.greatest(F.sum((F.col("u") < p).cast("int")).over(w_all),
                                                     F.lit(1)), F.lit(max_n)))
            .withColumn("_r", F.row_number().over(w_ord)))
    chosen = cand.where(F.col("_r") <= F.col("_k")).select(id_col, "pos", "syn")
    out = occ.join(chosen, [id_col, "pos"], "left").withColumn(
        "tok", F.coalesce("syn", "tok")).withColumn("_rep", F.col("syn").isNotNull().cast("int"))
    rebuilt = out.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))),
                                 lambda s: s["tok"]), " ").alias("_t"),
        F.sum("_rep").alias("replaced"))
    return (docs.join(rebuilt, id_col, "left")
            .withColumn(text, F.coalesce("_t", F.lit(""))).withColumn(
                "replaced", F.coalesce("replaced", F.lit(0))).drop("_t"))


def case_variant_synonyms(docs: DataFrame, text: str) -> DataFrame:
    """A synonym table from the corpus: a word's synonym is the most frequent
    other spelling of it that differs only by letter case (one row per word
    that has one).  The window runs over the spellings of one word."""
    from linesight.functions import text as T
    c = (docs.select(F.explode(T.word_tokens(text)).alias("tok")).groupBy("tok").count()
         .withColumn("low", F.lower("tok")))
    w = Window.partitionBy("low").orderBy(F.desc("count"), F.asc("tok"))
    r = c.withColumn("_r", F.row_number().over(w))
    top = r.where(F.col("_r") <= 2).groupBy("low").agg(
        F.min_by("tok", "_r").alias("first"), F.max_by("tok", "_r").alias("second"),
        F.count(F.lit(1)).alias("_n"))
    j = r.join(top.where(F.col("_n") == 2), "low")
    return j.select("tok", F.when(F.col("tok") == F.col("first"), F.col("second"))
                    .otherwise(F.col("first")).alias("syn"))


NEIGHBOURS = 10         # nearest words that may stand for a word


def word_neighbours(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(tok, neighbours): the k words with the largest cosine to each word of
    ``vectors`` (word, vector), nearest first, ties by word order.  Exact: unit
    vectors are the nearer the larger their cosine.  Zero vectors take no part."""
    from linesight.operators.matching import with_row_index
    from linesight.operators.nearest import nearest
    from linesight.session import materialize
    # computed once: a filter on the norm of a computed vector would else sink below the
    # count of the words and make a vector for every occurrence
    vectors = materialize(vectors.select("word", "vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.select("word", "vector", norm.alias("_n")).where(F.col("_n") > 0)
    unit = unit.select("word", F.zip_with("vector", F.array_repeat("_n", F.size("vector")), lambda x, n: x / n).alias("x"))
    ids = materialize(with_row_index(unit.select("word"), ["word"], "id"))
    points = materialize(unit.join(ids, "word").select("id", "x"))
    found = nearest(points, points, k)
    names = ids.select(F.col("id"), F.col("word").alias("to"))
    lists = found.join(names, "id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "to"))), lambda s: s["to"]).alias("neighbours"))
    return lists.join(ids, F.col("query_id") == F.col("id")).select(F.col("word").alias("tok"), "neighbours")


def neighbour_replacements(docs: DataFrame, vectors: DataFrame, text: str, id_col: str, seed: int,
                           p: float = 0.3, max_n: int = 10, k: int = NEIGHBOURS) -> DataFrame:
    """(id, pos, tok, new): the words that ``perturb_neighbour`` replaces.  Each
    word with neighbours draws u by document and place; the m with the smallest
    draws go, m = clamp(#(u < p), 1, max_n), and one of the word's neighbours,
    drawn too, takes the place."""
    from linesight.functions import text as T
    from linesight.operators.cleaning import _token_join
    occ = docs.select(id_col, F.posexplode(T.word_tokens(text)).alias("pos", "tok"))
    cand = _token_join(occ, word_neighbours(vectors, k), id_col)
    u = F.pmod(draw("word", F.col(id_col), F.col("pos"), seed), F.lit(1000000)) / 1000000.0
    which = (F.pmod(draw("neighbour", F.col(id_col), F.col("pos"), seed), F.size("neighbours")) + 1).cast("int")
    cand = cand.select(id_col, "pos", "tok", F.element_at("neighbours", which).alias("new"), u.alias("u"))
    # how many go is counted ahead; ranks beyond max_n are cut in each task before the window's shuffle
    many = cand.groupBy(id_col).agg(F.least(F.greatest(F.count_if(F.col("u") < p), F.lit(1)), F.lit(max_n)).alias("_m"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("u", "pos"))
    first = cand.withColumn("_r", rank).where(F.col("_r") <= max_n)
    return first.join(many, id_col).where(F.col("_r") <= F.col("_m")).select(id_col, "pos", "tok", "new")


def perturb_neighbour(docs: DataFrame, vectors: DataFrame, text: str, id_col: str, seed: int,
                      p: float = 0.3, max_n: int = 10, k: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with 1 to ``max_n`` words of each text replaced by near words in
    the vector table (``neighbour_replacements``), and ``replaced``, how many.
    Texts without a word that has neighbours only lose their spacing.  At most
    ``max_n`` replacements travel to a document; its words stay in the row."""
    from linesight.functions import text as T
    chosen = neighbour_replacements(docs, vectors, text, id_col, seed, p, max_n, k)
    lists = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("_new"))
    joined = docs.join(lists, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")
    toks = T.word_tokens(F.coalesce(F.col(text), F.lit("")))
    out = F.transform(toks, lambda t, i: F.coalesce(F.try_element_at(F.col("_new"), i), t))
    return (joined.withColumn(text, F.array_join(out, " "))
            .withColumn("replaced", F.coalesce(F.size(F.map_keys("_new")), F.lit(0))).drop("_new"))
