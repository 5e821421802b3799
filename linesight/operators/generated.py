"""Generated-line evaluation: unseen lines, similarity replacement,
hallucination flags and rates, exact match and line-count statistics.

Predicted lines are a relation ``preds(doc_id, pred_pos, line)``; document
lines the core relation ``lines(doc_id, line_idx, line)``.  Membership is an
equi join on (doc_id, line), never a scan of lists.  Similarity replacement
compares an unseen predicted line only with the lines of its own document
that share a token (sparse term-count cosine), so the work is bounded by
(#unseen predictions x document length), and a line of a hot token never
meets lines of other documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesight.functions import text as T


def lines_not_in_document(preds: DataFrame, lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Predicted lines whose exact text is not a line of the document."""
    return preds.join(lines.select(id_col, "line").distinct(), [id_col, "line"], "left_anti")


def _with_last(preds: DataFrame, id_col: str) -> DataFrame:
    w = Window.partitionBy(id_col)
    return preds.withColumn("_is_last", F.col("pred_pos") == F.max("pred_pos").over(w))


def line_tokens(col) -> "F.Column":
    """Term tokens for line vectors: lower-cased whitespace tokens."""
    return T.word_tokens(F.lower(col if not isinstance(col, str) else F.col(col)))


def _term_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return (df.select(*keys, F.explode(line_tokens("line")).alias("tok"))
            .groupBy(*keys, "tok").agg(F.count(F.lit(1)).cast("double").alias("c")))


def similar_line_replace(preds: DataFrame, lines: DataFrame, skip_last: bool = True,
                         drop_blank: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Replace every predicted line absent from its document by the most
    cosine-similar document line (term-count vectors; the first maximum in
    line order wins; all-zero similarity -> the first line).

    skip_last=True: the last predicted line is never replaced (variant a).
    drop_blank=True: blank predictions are removed first and every unseen
    line is replaced (variant b).  Output: (doc_id, pred_pos, line, replaced).
    """
    p = preds
    if drop_blank:
        p = p.where(F.regexp_replace("line", r"(?U)\s+", "") != "")
    p = _with_last(p, id_col)
    seen = lines.select(id_col, "line").distinct().withColumn("_seen", F.lit(True))
    p = p.join(seen, [id_col, "line"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    need = ~F.col("_seen")
    if skip_last:
        need = need & ~F.col("_is_last")
    p = p.withColumn("_need", need)
    todo = p.where("_need").select(id_col, "pred_pos", "line")

    # sparse cosine: only (prediction, line) pairs of one document sharing a token
    pt = _term_counts(todo, [id_col, "pred_pos"])
    docs_needed = todo.select(id_col).distinct()
    cand = lines.join(docs_needed, id_col, "left_semi")
    # identical lines have identical vectors and the first one wins a tie, so
    # each distinct line of a document is vectorized once (its first index)
    cand = cand.groupBy(id_col, "line").agg(F.min("line_idx").alias("line_idx"))
    lt = _term_counts(cand.select(id_col, "line_idx", "line"), [id_col, "line_idx"])
    pn = pt.groupBy(id_col, "pred_pos").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("pn"))
    ln = lt.groupBy(id_col, "line_idx").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("ln"))
    dots = (pt.withColumnRenamed("c", "cp").join(lt.withColumnRenamed("c", "cl"), [id_col, "tok"])
            .groupBy(id_col, "pred_pos", "line_idx").agg(F.sum(F.col("cp") * F.col("cl")).alias("dot")))
    sims = (dots.join(pn, [id_col, "pred_pos"]).join(ln, [id_col, "line_idx"])
            .withColumn("sim", F.col("dot") / (F.col("pn") * F.col("ln"))))
    best = sims.groupBy(id_col, "pred_pos").agg(
        F.max_by("line_idx", F.struct(F.col("sim"), -F.col("line_idx"))).alias("best_idx"))
    best = todo.select(id_col, "pred_pos").join(best, [id_col, "pred_pos"], "left") \
        .withColumn("best_idx", F.coalesce("best_idx", F.lit(0)))
    best_line = best.join(lines.select(id_col, F.col("line_idx").alias("best_idx"),
                                       F.col("line").alias("best_line")), [id_col, "best_idx"])
    out = p.join(best_line.select(id_col, "pred_pos", "best_line"), [id_col, "pred_pos"], "left")
    return out.select(id_col, "pred_pos",
                      F.when(F.col("_need"), F.col("best_line")).otherwise(F.col("line")).alias("line"),
                      F.col("_need").cast("int").alias("replaced"))


def hallucination_flag(preds: DataFrame, lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: 1 iff some predicted line other than the last is absent."""
    p = _with_last(preds, id_col)
    unseen = lines_not_in_document(p, lines, id_col).where(~F.col("_is_last"))
    flagged = unseen.select(id_col).distinct().withColumn("hallucinated", F.lit(1))
    return (preds.select(id_col).distinct().join(flagged, id_col, "left")
            .select(id_col, F.coalesce("hallucinated", F.lit(0)).alias("hallucinated")))


def category_rate(flags: DataFrame, category: str, flag: str = "hallucinated") -> DataFrame:
    """hallucinated / positives per category, only categories with at least one,
    highest rate first."""
    agg = flags.groupBy(category).agg(F.sum(flag).alias("flagged"), F.count(F.lit(1)).alias("total"))
    return (agg.where(F.col("flagged") > 0)
            .withColumn("rate", F.col("flagged") / F.col("total"))
            .orderBy(F.desc("rate"), F.asc(category)))


def pred_text(preds: DataFrame, id_col: str = "doc_id", out: str = "pred_text") -> DataFrame:
    """Predicted lines -> newline-joined text per document (in emitted order;
    the list per document is bounded by the generator's output length)."""
    return preds.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pred_pos", "line"))),
                                 lambda s: s["line"]), "\n").alias(out))


def exact_match(df: DataFrame, pred: str, label: str) -> "F.Column":
    return F.avg((F.col(pred) == F.col(label)).cast("double"))


def exact_match_truncated(df: DataFrame, pred: str, label: str, max_chars: int) -> "F.Column":
    """Share of rows whose prediction equals the label cut to the generator's
    output length."""
    return F.avg((F.col(pred) == F.substring(F.col(label), 1, max_chars)).cast("double"))


def line_count_stats(df: DataFrame, pred: str = "pred_text", label: str = "label_text") -> DataFrame:
    """Mean / median number of predicted and actual lines (``""`` counts one)."""
    pn = F.size(T.split_lines(F.coalesce(F.col(pred), F.lit(""))))
    an = F.size(T.split_lines(F.coalesce(F.col(label), F.lit(""))))
    d = df.select(pn.alias("p"), an.alias("a"))
    return d.agg(F.avg("p").alias("mean_pred_lines"), F.percentile("p", 0.5).alias("median_pred_lines"),
                 F.avg("a").alias("mean_actual_lines"), F.percentile("a", 0.5).alias("median_actual_lines"))


_TAGGED = "struct<t:string,s:int>"


def _sorted_tokens(line) -> "F.Column":
    return F.array_sort(line_tokens(line))


def _sum_sq_runs(sorted_toks) -> "F.Column":
    """Σ over distinct tokens of count² (the squared norm of the term-count
    vector) from sorted tokens, in one fold."""
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"),
                    F.lit(0).alias("tot"))

    def step(acc, t):
        same = acc["prev"].isNotNull() & (acc["prev"] == t)
        return F.struct(t.alias("prev"), F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
                        F.when(same, acc["tot"]).otherwise(acc["tot"] + acc["run"] * acc["run"]).alias("tot"))
    return F.aggregate(sorted_toks, init, step, lambda a: a["tot"] + a["run"] * a["run"])


def _dot_sorted(a, b) -> "F.Column":
    """Σ_t count_a(t) * count_b(t) of two token arrays: tag, sort, fold runs."""
    merged = F.array_sort(F.concat(
        F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(0).alias("s"))).cast(f"array<{_TAGGED}>"),
        F.transform(b, lambda t: F.struct(t.alias("t"), F.lit(1).alias("s"))).cast(f"array<{_TAGGED}>")))
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("ca"), F.lit(0).alias("cb"),
                    F.lit(0).alias("tot"))

    def step(acc, e):
        same = acc["prev"].isNotNull() & (acc["prev"] == e["t"])
        tot = F.when(same, acc["tot"]).otherwise(acc["tot"] + acc["ca"] * acc["cb"])
        ca = F.when(same, acc["ca"]).otherwise(F.lit(0)) + (e["s"] == 0).cast("int")
        cb = F.when(same, acc["cb"]).otherwise(F.lit(0)) + (e["s"] == 1).cast("int")
        return F.struct(e["t"].alias("prev"), ca.alias("ca"), cb.alias("cb"), tot.alias("tot"))
    return F.aggregate(merged, init, step, lambda x: x["tot"] + x["ca"] * x["cb"])


def similar_line_replace_rows(docs: DataFrame, preds: DataFrame, text: str = "text",
                              skip_last: bool = True, drop_blank: bool = False,
                              id_col: str = "doc_id") -> DataFrame:
    """Row-local form of ``similar_line_replace`` after one join: the
    predictions of a document (one ordered array, bounded by the generator's
    output) meet the document row, and the cosine of every unseen prediction
    with every line is computed from sorted term lists (norms by a fold over
    runs, dot products by a sort-merge fold), so no token is shuffled.
    Output: (doc_id, pred_pos, line, replaced)."""
    p = preds
    if drop_blank:
        p = p.where(F.regexp_replace("line", r"(?U)\s+", "") != "")
    arr = p.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col("pred_pos").alias("pos"), F.col("line").alias("line")))).alias("_p"))
    d = arr.join(docs.select(id_col, F.col(text).alias("_text")), id_col)
    lines = T.split_lines("_text")
    linfo = F.transform(lines, lambda l, i: F.struct(
        i.alias("idx"), l.alias("line"), _sorted_tokens(l).alias("toks")))
    linfo = F.transform(linfo, lambda e: F.struct(
        e["idx"].alias("idx"), e["line"].alias("line"), e["toks"].alias("toks"),
        F.sqrt(_sum_sq_runs(e["toks"]).cast("double")).alias("nrm")))
    # terms and norm of a prediction once, not once per document line
    pinfo = F.transform("_p", lambda e: F.struct(
        e["pos"].alias("pos"), e["line"].alias("line"), _sorted_tokens(e["line"]).alias("toks")))
    pinfo = F.transform(pinfo, lambda e: F.struct(
        e["pos"].alias("pos"), e["line"].alias("line"), e["toks"].alias("toks"),
        F.sqrt(_sum_sq_runs(e["toks"]).cast("double")).alias("nrm")))
    staged = d.select(id_col, pinfo.alias("_p"), linfo.alias("_l"), lines.alias("_lines"),
                      F.element_at("_p", -1)["pos"].alias("_last"))

    def choose(pr):
        utoks, unrm = pr["toks"], pr["nrm"]
        sims = F.transform(F.col("_l"), lambda e: F.struct(
            F.when(((unrm * e["nrm"]) == 0) | ~F.arrays_overlap(utoks, e["toks"]), F.lit(0.0))
             .otherwise(_dot_sorted(utoks, e["toks"]).cast("double") / (unrm * e["nrm"])).alias("sim"),
            (-e["idx"]).alias("neg"), e["line"].alias("line")))
        need = ~F.array_contains(F.col("_lines"), pr["line"])
        if skip_last:
            need = need & (pr["pos"] != F.col("_last"))
        best = F.array_max(sims)["line"]
        return F.struct(pr["pos"].alias("pred_pos"),
                        F.when(need, best).otherwise(pr["line"]).alias("line"),
                        need.cast("int").alias("replaced"))
    # the explode (a Generate) keeps ``_l`` a computed column of the row below
    # it, so the per-prediction lambda reads it instead of recomputing it
    out = staged.select(id_col, F.explode(F.transform("_p", choose)).alias("r"))
    return out.select(id_col, "r.pred_pos", "r.line", "r.replaced")
