"""Step 2b: repeated runs and method comparison.

A "run" is one project (documents.source); a "method" is a line ranking:
``score`` (line score desc) or ``position`` (read top to bottom).  Each
(method, run) row carries the averaged metrics, as one per-seed result file
of the studied evaluation does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linesight.operators import runs as U
from linesight.operators.document_metrics import document_metrics
from linesight.plans import bindings as B
from linesight.plans import sql_parts as S
from linesight.plans.registry import register

RUN_METRICS = ["accuracy", "precision", "recall", "mrr", "map", "mar", "median_ifa"]

# Published literature numbers the comparison table lists
# (Top-10 accuracy %, median IFA, Effort@20%Recall %, Recall@1%LOC %).
PUBLISHED = [
    ("LineVul", 65.0, 1.0, 0.75, 24.0),
    ("Saliency", 58.0, 4.0, 1.51, 13.0),
    ("DeepLift", 57.0, 3.0, 1.51, 13.0),
    ("DeepLiftSHAP", 57.0, 3.0, 1.51, 13.0),
    ("LIG", 53.0, 4.0, 1.06, 19.0),
    ("GradientSHAP", 52.0, 3.0, 1.60, 13.0),
    ("CppCheck", 15.0, 4.0, 13.0, 4.0),
]


def method_doc_metrics(spark, sf_dir):
    """Per-document metrics of both rankings (method, project, doc_id, ...), made
    inside the document row: no line is shuffled."""
    f = B.function_table(spark, sf_dir)
    scores = {"score": F.length, "position": lambda line: F.lit(0.0)}     # equal scores keep the line order
    both = [document_metrics(f.withColumn("method", F.lit(m)), score, carry=["method", "project"]) for m, score in scores.items()]
    return both[0].unionByName(both[1])


def run_table(spark, sf_dir):
    m = method_doc_metrics(spark, sf_dir)
    return m.groupBy("method", F.col("project").alias("run")).agg(
        F.round(F.avg("top_x_accuracy"), 9).alias("accuracy"),
        F.round(F.avg("top_x_precision"), 9).alias("precision"),
        F.round(F.avg("top_x_recall"), 9).alias("recall"),
        F.round(F.avg("rr"), 9).alias("mrr"), F.round(F.avg("ap"), 9).alias("map"),
        F.round(F.avg("ar"), 9).alias("mar"),
        F.round(F.percentile("ifa", 0.5), 9).alias("median_ifa"))


@register("run_results", sql=S.RUNS + """
SELECT method, run, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(map, 6) AS map, round(mar, 6) AS mar,
       round(median_ifa, 6) AS median_ifa FROM runs""")
def q_run_results(spark, sf_dir):
    return run_table(spark, sf_dir)


@register("average_runs", sql=S.RUNS + """
SELECT method, round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision,
       round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(map), 6) AS map,
       round(avg(mar), 6) AS mar, round(avg(median_ifa), 6) AS median_ifa
FROM runs GROUP BY method""")
def q_average_runs(spark, sf_dir):
    return U.average_runs(run_table(spark, sf_dir), RUN_METRICS, ["method"])


@register("describe_runs", sql=S.RUNS + """
SELECT method, metric, CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
FROM long GROUP BY method, metric""")
def q_describe_runs(spark, sf_dir):
    return U.describe_runs(run_table(spark, sf_dir), RUN_METRICS, ["method"])


@register("fold_summary", sql=S.RUNS + """
SELECT method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM long GROUP BY method, metric""")
def q_fold_summary(spark, sf_dir):
    return U.fold_summary(run_table(spark, sf_dir), RUN_METRICS, ["method"])


_PAIRS = S.RUNS + """,
pairs AS (
  SELECT a.run, a.metric, a.value AS a, b.value AS b
  FROM long a JOIN long b ON a.run = b.run AND a.metric = b.metric
  WHERE a.method = 'score' AND b.method = 'position'
)"""


@register("run_pair_join", sql=_PAIRS + """
SELECT run, metric, round(a, 6) AS a, round(b, 6) AS b FROM pairs""")
def q_pairs(spark, sf_dir):
    return U.pair_runs(run_table(spark, sf_dir), RUN_METRICS, "method", "score", "position")


@register("wilcoxon_signed_rank", sql=_PAIRS + """,
d AS (SELECT metric, a - b AS d, abs(a - b) AS ad FROM pairs WHERE a - b <> 0),
r AS (
  SELECT metric, d, ad,
         rank() OVER (PARTITION BY metric ORDER BY ad)
           + (count(*) OVER (PARTITION BY metric, ad) - 1) / 2.0 AS r
  FROM d
),
ties AS (
  SELECT metric, sum(t * t * t - t) AS tie_sum FROM (
    SELECT metric, ad, count(*) AS t FROM d GROUP BY metric, ad) GROUP BY metric
),
agg AS (
  SELECT metric, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus,
         sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY metric
)
SELECT agg.metric, CASE WHEN agg.metric IN ('ifa', 'median_ifa', 'effort') THEN 'less' ELSE 'greater' END
         AS alternative,
       CAST(n AS BIGINT) AS n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus,
       round(CASE WHEN n * (n + 1) * (2 * n + 1) / 24.0 - tie_sum / 48.0 > 0 THEN
         (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie_sum / 48.0) END, 6) AS z
FROM agg JOIN ties USING (metric)""")
def q_wilcoxon(spark, sf_dir):
    pairs = U.pair_runs(run_table(spark, sf_dir), RUN_METRICS, "method", "score", "position")
    return U.wilcoxon_signed_rank(pairs, p_values=False)


@register("wilcoxon_p_value")
def q_wilcoxon_p(spark, sf_dir):
    """Exact (n <= 50, no ties) or normal-approximation p values and verdicts."""
    pairs = U.pair_runs(run_table(spark, sf_dir), RUN_METRICS, "method", "score", "position")
    return U.wilcoxon_signed_rank(pairs, p_values=True)


def _published(spark):
    rows = []
    for name, acc, ifa, effort, rloc in PUBLISHED:
        rows += [(name, "top10_accuracy", acc), (name, "median_ifa", ifa),
                 (name, "effort_20_recall", effort), (name, "recall_1_loc", rloc)]
    return spark.createDataFrame(rows, "method string, metric string, value double")


_PUB_SQL = ", ".join(
    f"('{n}', '{m}', {v})" for n, a, i, e, r in PUBLISHED
    for m, v in (("top10_accuracy", a), ("median_ifa", i), ("effort_20_recall", e), ("recall_1_loc", r)))


@register("method_comparison", sql=S.RUNS + f""",
pub(method, metric, value) AS (VALUES {_PUB_SQL}),
ours AS (
  SELECT method, 'top10_accuracy' AS metric, round(avg(accuracy) * 100.0, 2) AS value FROM runs GROUP BY method
  UNION ALL SELECT method, 'median_ifa', round(avg(median_ifa), 2) FROM runs GROUP BY method
),
allm AS (SELECT * FROM ours UNION ALL SELECT method, metric, CAST(value AS DOUBLE) FROM pub)
SELECT metric,
  max(CASE WHEN method = 'score' THEN value END) AS score,
  max(CASE WHEN method = 'position' THEN value END) AS position,
""" + ",\n".join(f"  max(CASE WHEN method = '{n}' THEN value END) AS \"{n}\"" for n, *_ in PUBLISHED)
    + "\nFROM allm GROUP BY metric")
def q_method_comparison(spark, sf_dir):
    """Our two rankings next to the published methods (percent / lines)."""
    runs = run_table(spark, sf_dir)
    ours = runs.groupBy("method").agg(F.avg("accuracy").alias("a"), F.avg("median_ifa").alias("i"))
    ours = ours.selectExpr("method", "stack(2, 'top10_accuracy', round(a * 100.0, 2), "
                           "'median_ifa', round(i, 2)) AS (metric, value)")
    methods = ["score", "position"] + [n for n, *_ in PUBLISHED]
    return U.method_comparison(ours, _published(spark), methods)


@register("ifa_dispersion", sql=S.RUNS + """
SELECT method, round(avg(ifa), 6) AS mean, round(stddev_samp(ifa), 6) AS std,
       round(quantile_cont(ifa, 0.5), 6) AS median, round(quantile_cont(ifa, 0.25), 6) AS q1,
       round(quantile_cont(ifa, 0.75), 6) AS q3,
       round(quantile_cont(ifa, 0.75) - quantile_cont(ifa, 0.25), 6) AS iqr,
       round(quantile_cont(ifa, 0.5) + (quantile_cont(ifa, 0.75) - quantile_cont(ifa, 0.25)) / 2.0, 6)
         AS median_half_iqr
FROM metrics GROUP BY method""")
def q_ifa_dispersion(spark, sf_dir):
    """IFA series of the two rankings: spread statistics per method."""
    return U.ifa_dispersion(method_doc_metrics(spark, sf_dir), "ifa", ["method"])
