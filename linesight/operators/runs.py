"""Comparison of repeated runs (seeds, folds, projects) and of methods.

Inputs are long or wide run tables: one row per (method, run) with metric
columns.  Long format (method, run, metric, value) comes from ``stack``.
Window partitions here are per metric over runs, i.e. bounded by the number
of runs, not by the data volume behind them.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

EXACT_MAX_N = 50  # exact null distribution up to this many non-zero pairs


def to_long(runs: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return runs.selectExpr(*[f"`{k}`" for k in keys],
                           f"stack({len(metrics)}, {pairs}) AS (metric, value)")


def average_runs(runs: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def describe_runs(runs: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles (exact, interpolated), max per
    (group, metric)."""
    lg = to_long(runs, metrics, by)
    v = F.col("value")
    return lg.groupBy(*by, "metric").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.percentile(v, 0.25).alias("p25"),
        F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.75).alias("p75"),
        F.max(v).alias("max"))


def fold_summary(runs: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """mean and population std over folds."""
    lg = to_long(runs, metrics, by)
    return lg.groupBy(*by, "metric").agg(F.avg("value").alias("mean"),
                                         F.stddev_pop("value").alias("std"))


def pair_runs(runs: DataFrame, metrics: list[str], method_col: str, a: str, b: str,
              run_col: str = "run") -> DataFrame:
    """(run, metric, a, b): two methods' values paired on the run key."""
    lg = to_long(runs, metrics, [method_col, run_col])
    left = lg.where(F.col(method_col) == a).select(run_col, "metric", F.col("value").alias("a"))
    right = lg.where(F.col(method_col) == b).select(run_col, "metric", F.col("value").alias("b"))
    return left.join(right, [run_col, "metric"])


@pandas_udf(DoubleType())
def _norm_sf(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal distribution."""
    return z.map(lambda v: None if v is None or (isinstance(v, float) and math.isnan(v))
                 else 0.5 * math.erfc(v / math.sqrt(2.0)))


def wilcoxon_signed_rank(pairs: DataFrame, less_metrics=("ifa", "median_ifa", "effort"),
                         alpha: float = 0.05, p_values: bool = True) -> DataFrame:
    """One-sided paired test per metric of a > b ("less" for the metrics where
    lower is better).  d = a - b, zeros dropped, average ranks of |d|,
    W+ = Σ ranks of d > 0.  z uses the tie-corrected variance without
    continuity correction; p is exact (dynamic programme over rank sums, as a
    higher-order function) for n <= 50 without ties, normal otherwise."""
    d = pairs.withColumn("d", F.col("a") - F.col("b")).where(F.col("d") != 0)
    d = d.withColumn("ad", F.abs("d"))
    w_min = Window.partitionBy("metric").orderBy("ad")
    w_tie = Window.partitionBy("metric", "ad")
    r = (d.withColumn("_r0", F.rank().over(w_min))
         .withColumn("_t", F.count(F.lit(1)).over(w_tie))
         .withColumn("r", F.col("_r0") + (F.col("_t") - 1) / 2.0))
    ties = r.groupBy("metric", "ad").agg(F.count(F.lit(1)).alias("t")) \
        .groupBy("metric").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie_sum"),
                               F.max("t").alias("max_tie"))
    agg = r.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"))
    out = agg.join(ties, "metric")
    n = F.col("n").cast("double")
    mn = n * (n + 1) / 4.0
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_sum") / 48.0)
    out = out.withColumn("z", F.when(se > 0, (F.col("w_plus") - mn) / se))
    less = F.col("metric").isin(list(less_metrics))
    out = out.withColumn("alternative", F.when(less, F.lit("less")).otherwise(F.lit("greater")))
    if not p_values:
        return out.select("metric", "alternative", "n", "w_plus", "w_minus", "z")
    # exact null distribution of W+: counts of subsets of {1..n} per rank sum
    max_sum = (F.col("n") * (F.col("n") + 1) / 2).cast("int")
    counts = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)).cast("int")),
        F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), max_sum)),
        lambda acc, k: F.transform(acc, lambda v, s: v + F.when(
            (s >= k) & (k <= F.col("n")), F.element_at(acc, F.greatest(s - k + 1, F.lit(1))))
            .otherwise(F.lit(0.0))))
    total = F.pow(F.lit(2.0), n)
    w = F.col("w_plus")
    ge = F.aggregate(F.transform(counts, lambda v, s: F.when(s >= w, v).otherwise(0.0)),
                     F.lit(0.0), lambda a_, v: a_ + v)
    le = F.aggregate(F.transform(counts, lambda v, s: F.when(s <= w, v).otherwise(0.0)),
                     F.lit(0.0), lambda a_, v: a_ + v)
    exact_ok = (F.col("n") <= EXACT_MAX_N) & (F.col("max_tie") == 1)
    p_exact = F.when(less, le / total).otherwise(ge / total)
    out = out.withColumn("_sf", _norm_sf(F.col("z")))
    p_norm = F.when(less, 1.0 - F.col("_sf")).otherwise(F.col("_sf"))
    p = F.when(exact_ok, p_exact).otherwise(p_norm)
    return out.select("metric", "alternative", "n", "w_plus", "w_minus", "z",
                      p.alias("p_value"), exact_ok.alias("exact"),
                      (p < alpha).alias("significant"))


def method_comparison(ours: DataFrame, published: DataFrame, methods: list[str],
                      method_col: str = "method", digits: int = 2) -> DataFrame:
    """Metrics x methods wide table: our values next to published constants.
    Both inputs are long (method, metric, value) tables in display units
    (percent or lines); ours are rounded to ``digits``.  The pivot values are
    given explicitly, so no extra job discovers them."""
    mine = ours.select(method_col, "metric", F.round(F.col("value"), digits).alias("value"))
    both = mine.unionByName(published.select(method_col, "metric", "value"))
    return both.groupBy("metric").pivot(method_col, methods).agg(F.first("value"))


def select_best_epoch(logs: DataFrame, run: str = "run", epoch: str = "epoch",
                      score: str = "score", patience: int = 5) -> DataFrame:
    """Early stopping over per-epoch validation logs: the best score so far
    (higher is better), training stops at the first epoch that is
    ``patience`` epochs past the last improvement; the answer is the best
    epoch up to there.  Windows run per training run (epochs of one run)."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev_best = F.max(score).over(w)
    imp = logs.withColumn("_imp", prev_best.isNull() | (F.col(score) > prev_best))
    w2 = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    imp = imp.withColumn("_last_imp", F.max(F.when(F.col("_imp"), F.col(epoch))).over(w2))
    stop = imp.where(F.col(epoch) - F.col("_last_imp") >= patience).groupBy(run).agg(
        F.min(epoch).alias("stop_epoch"))
    j = imp.join(stop, run, "left")
    kept = j.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return kept.groupBy(run).agg(
        F.max_by(epoch, F.struct(F.col(score), -F.col(epoch))).alias("best_epoch"),
        F.max(score).alias("best_score"), F.max(epoch).alias("last_epoch"))


def ifa_dispersion(series: DataFrame, value: str = "ifa", by: list[str] | None = None) -> DataFrame:
    """Per method: mean and sample std; median, quartiles (interpolated),
    IQR and median + IQR / 2 of an IFA series."""
    v = F.col(value).cast("double")
    g = series.groupBy(*(by or []))
    s = g.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
              F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q1"),
              F.percentile(v, 0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return s.select("*", iqr.alias("iqr"), (F.col("median") + iqr / 2.0).alias("median_half_iqr"))
