"""Profiles, counts, length statistics and length-based reduction.

Everything is a (partially pre-aggregated) groupBy.  Where an order over
values is needed (k-th smallest length, token ranks) it runs over the
histogram of distinct values, whose size is bounded by the value domain
(document lengths, vocabulary), never over the rows themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.functions import text as T

MAX_MODEL_LEN = 512  # fixed cap of the encoded length


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per non-null value, most frequent first (ties by value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), F.asc(col)))


def top_categories(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n largest categories (a top-k report: the limit is the feature)."""
    return value_counts(df, col).limit(n)


def distinct_categories(df: DataFrame, col: str) -> DataFrame:
    """Number of distinct values, counting null as a value (``unique()``)."""
    return df.agg((F.count_distinct(F.col(col)) +
                   F.max(F.col(col).isNull().cast("int"))).alias("n_distinct"))


def class_ratio(df: DataFrame, label: str = "target") -> DataFrame:
    """positives / negatives * 100 (not over the total); null without negatives."""
    agg = df.agg(F.count_if(F.col(label) == 1).alias("positives"),
                 F.count_if(F.col(label) == 0).alias("negatives"))
    return agg.select("positives", "negatives",
                      F.try_divide(F.col("positives") * 100.0, F.col("negatives")).alias("ratio"))


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Balanced weights n / (k * n_c) per class.  The class table has one row
    per class; n and k are two scalars of that table."""
    counts = df.groupBy(label).count()
    tot = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n, k = float(tot["n"] or 0), float(tot["k"] or 0)
    return counts.select(label, "count", (F.lit(n) / (F.lit(k) * F.col("count"))).alias("weight"))


def max_word_count(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.max(F.size(T.word_tokens(text))).alias("max_words"))


def max_encoded_length(df: DataFrame, text: str = "text", id_col: str = "doc_id",
                       cap: int = MAX_MODEL_LEN) -> DataFrame:
    """Longest token sequence, its row (first max: smallest id), capped length."""
    n = F.size(T.word_tokens(text))
    agg = df.select(id_col, n.alias("_n")).agg(
        F.max("_n").alias("longest"),
        F.min_by(F.col(id_col), F.struct(-F.col("_n"), F.col(id_col))).alias("row_id"))
    return agg.select("longest", "row_id", F.least(F.col("longest"), F.lit(cap)).alias("max_len"))


def word_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) over whitespace tokens, most frequent first.  Token counts
    are pre-aggregated map side before the shuffle on the word."""
    return (df.select(F.explode(T.word_tokens(text)).alias("word")).groupBy("word").count()
            .orderBy(F.desc("count"), F.asc("word")))


def word_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """All-words and unique-words counts."""
    words = df.select(F.explode(T.word_tokens(text)).alias("word"))
    return words.agg(F.count(F.lit(1)).alias("all_words"),
                     F.count_distinct("word").alias("unique_words"))


def _lengths(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.size(T.word_tokens(text)).alias("len"))


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """mean/max/min/median/population std of token lengths, median + 2 std and
    its integer position, quartiles (linear interpolation), IQR and whiskers."""
    ln = _lengths(df, text)
    s = ln.agg(F.avg("len").alias("mean"), F.max("len").alias("max"), F.min("len").alias("min"),
               F.percentile("len", 0.5).alias("median"), F.stddev_pop("len").alias("std"),
               F.percentile("len", 0.25).alias("q1"), F.percentile("len", 0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return s.select("*", (F.col("median") + 2 * F.col("std")).alias("median_2std"),
                    (F.col("median") + 2 * F.col("std")).cast("long").alias("split_point_std"),
                    iqr.alias("iqr"), (F.col("q3") + 1.5 * iqr).alias("upper"),
                    (F.col("q1") - 1.5 * iqr).alias("lower"))


def length_reduce(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop long documents (IQR rule as the earlier study applied it):
    m = n - #{len <= lower or len >= upper}; max_len = m-th smallest length
    (the largest when m = 0); keep rows with len < max_len (strict).

    Two passes over the texts: one builds the histogram of lengths (one row per
    distinct length), which gives the quartiles and the m-th smallest length;
    the other filters."""
    from linesight.operators.global_order import with_global_position
    from linesight.session import materialize
    withlen = df.withColumn("length", F.size(T.word_tokens(text)))
    hist = materialize(withlen.groupBy("length").agg(F.count(F.lit(1)).alias("count")))
    q = hist.agg(F.percentile("length", 0.25, F.col("count")).alias("q1"),
                 F.percentile("length", 0.75, F.col("count")).alias("q3")).first()
    if q["q1"] is None:
        return withlen
    iqr = q["q3"] - q["q1"]
    lower, upper = q["q1"] - 1.5 * iqr, q["q3"] + 1.5 * iqr
    tot = hist.agg(F.sum("count").alias("n"),
                   F.sum(F.when((F.col("length") <= lower) | (F.col("length") >= upper),
                                F.col("count")).otherwise(0)).alias("out")).first()
    m = tot["n"] - tot["out"]
    k = m if m > 0 else tot["n"]
    cum = with_global_position(hist, [F.col("length").asc()], hit="count", partitions=1)
    max_len = cum.where(F.col("cum_hits") >= k).agg(F.min("length")).first()[0]
    return withlen.where(F.col("length") < F.lit(int(max_len)))


def profile_scan(df: DataFrame) -> DataFrame:
    """(column, nulls, rows) for every column from one aggregate and a
    ``stack`` unpivot; label counts come from ``value_counts``."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', n_{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, nulls)", "__rows AS rows")


def preview(df: DataFrame, order: str, n: int = 5, width: int = T.PREVIEW_WIDTH) -> DataFrame:
    """First n rows by ``order`` with long strings cut (a head report)."""
    cols = [T.preview_text(F.col(f.name), width).alias(f.name)
            if f.dataType.simpleString() == "string" else F.col(f.name)
            for f in df.schema.fields]
    return df.orderBy(order).limit(n).select(*cols)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
