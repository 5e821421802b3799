"""Multiset line overlap and the grouped length / correctness metrics.

Overlap counts lines per (document, line) on each side and meets them in a
full outer join on that key: intersection = Σ min, union = Σ max, which is
the counted (multiset) overlap; ``array_intersect`` would de-duplicate.
Grouped metrics use overlapping slices, so each record is exploded into the
(slice, group) cells it belongs to and aggregated once; empty cells come
from a left join of the fixed cell grid (at most 6 rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.functions import text as T

RELIABLE_MAX_GT = 20  # fixed: "reliable set" = at most 20 ground-truth lines


def stripped_lines(df: DataFrame, text: str, id_col: str = "doc_id") -> DataFrame:
    """Newline text -> (doc_id, line) with lines stripped, blanks removed."""
    arr = T.strip_lines(T.split_lines(F.coalesce(F.col(text), F.lit(""))))
    return df.select(id_col, F.explode(arr).alias("line"))


def multiset_overlap(docs: DataFrame, gt: DataFrame, pred: DataFrame,
                     id_col: str = "doc_id") -> DataFrame:
    """Per document MSP = ∩/|pred|, MSR = ∩/|gt|, MIoU = ∩/∪ over line
    multisets; empty denominators give 0.  Also gt_len and sim_len."""
    g = gt.groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("g"))
    p = pred.groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("p"))
    both = g.join(p, [id_col, "line"], "full").na.fill(0, ["g", "p"])
    agg = both.groupBy(id_col).agg(
        F.sum(F.least("g", "p")).alias("inter"), F.sum(F.greatest("g", "p")).alias("uni"),
        F.sum("g").alias("gt_len"), F.sum("p").alias("sim_len"))
    out = docs.select(id_col).join(agg, id_col, "left").na.fill(0, ["inter", "uni", "gt_len", "sim_len"])

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(id_col, F.col("gt_len").cast("long"), F.col("sim_len").cast("long"),
                      ratio("inter", "sim_len").alias("msp"), ratio("inter", "gt_len").alias("msr"),
                      ratio("inter", "uni").alias("miou"))


def _grid(spark, slices, groups):
    return spark.createDataFrame([(s, g) for s in slices for g in groups], "slice string, grp string")


def _group_of(pred_g1: str):
    return F.array_compact(F.array(
        F.lit("overall"),
        F.when(F.col(pred_g1) == 1, F.lit("true_positive"))
         .when(F.col(pred_g1) == 0, F.lit("false_negative"))))


def length_group_metrics(records: DataFrame, gt_len: str = "gt_len", sim_len: str = "sim_len",
                         pred_g1: str = "pred_g1") -> DataFrame:
    """count, Acc_VLC (equal counts), MAE, RMSE for {full, gt_len <= 20} x
    {overall, pred=1, pred=0}; empty cells are zeros."""
    slices = F.array_compact(F.array(
        F.lit("full_dataset"),
        F.when(F.col(gt_len) <= RELIABLE_MAX_GT, F.lit("reliable_set"))))
    cells = (records.select(gt_len, sim_len, F.explode(slices).alias("slice"), pred_g1)
             .select("*", F.explode(_group_of(pred_g1)).alias("grp")))
    err = (F.col(sim_len) - F.col(gt_len)).cast("double")
    agg = cells.groupBy("slice", "grp").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg((F.col(sim_len) == F.col(gt_len)).cast("double")).alias("accuracy_vlc"),
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    grid = _grid(records.sparkSession, ["full_dataset", "reliable_set"],
                 ["overall", "true_positive", "false_negative"])
    return (F.broadcast(grid).join(agg, ["slice", "grp"], "left")
            .na.fill(0, ["count"]).na.fill(0.0, ["accuracy_vlc", "mae", "rmse"])
            .select("slice", F.col("grp").alias("group"), F.col("count").cast("long"),
                    "accuracy_vlc", "mae", "rmse"))


def correctness_group_metrics(records: DataFrame, within: str = "is_within_128",
                              pred_g1: str = "pred_g1") -> DataFrame:
    """Mean MSP / MSR / MIoU on the records inside the token budget, for
    {overall, pred=1, pred=0}; empty cells are zeros."""
    cells = records.where(F.col(within)).select("msp", "msr", "miou",
                                                F.explode(_group_of(pred_g1)).alias("grp"))
    agg = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("count"), F.avg("msp").alias("msp"),
                                   F.avg("msr").alias("msr"), F.avg("miou").alias("miou"))
    grid = _grid(records.sparkSession, ["within_128"], ["overall", "true_positive", "false_negative"])
    return (F.broadcast(grid).join(agg, "grp", "left")
            .na.fill(0, ["count"]).na.fill(0.0, ["msp", "msr", "miou"])
            .select("slice", F.col("grp").alias("group"), F.col("count").cast("long"),
                    "msp", "msr", "miou"))


def multiset_overlap_arrays(gt, pred) -> "list":
    """Row-local counted overlap of two line arrays (already stripped, blanks
    removed): one sort of the tagged lines and one pass that folds each run of
    equal lines into Σ min / Σ max, with scalars only in the accumulator.
    Returns [gt_len, sim_len, msp, msr, miou] columns."""
    tag = "struct<v:string,side:int>"
    merged = F.array_sort(F.concat(
        F.transform(gt, lambda x: F.struct(x.alias("v"), F.lit(0).alias("side"))).cast(f"array<{tag}>"),
        F.transform(pred, lambda x: F.struct(x.alias("v"), F.lit(1).alias("side"))).cast(f"array<{tag}>")))
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("cg"), F.lit(0).alias("cp"),
                    F.lit(0).alias("inter"), F.lit(0).alias("uni"))

    def step(acc, e):
        same = acc["prev"].isNotNull() & (acc["prev"] == e["v"])
        inter = F.when(same, acc["inter"]).otherwise(acc["inter"] + F.least(acc["cg"], acc["cp"]))
        uni = F.when(same, acc["uni"]).otherwise(acc["uni"] + F.greatest(acc["cg"], acc["cp"]))
        cg = F.when(same, acc["cg"]).otherwise(F.lit(0)) + (e["side"] == 0).cast("int")
        cp = F.when(same, acc["cp"]).otherwise(F.lit(0)) + (e["side"] == 1).cast("int")
        return F.struct(e["v"].alias("prev"), cg.alias("cg"), cp.alias("cp"), inter.alias("inter"),
                        uni.alias("uni"))

    def finish(acc):
        return F.struct((acc["inter"] + F.least(acc["cg"], acc["cp"])).alias("inter"),
                        (acc["uni"] + F.greatest(acc["cg"], acc["cp"])).alias("uni"))
    res = F.aggregate(merged, init, step, finish)
    g_n, p_n = F.size(gt), F.size(pred)
    inter, uni = res["inter"].cast("double"), res["uni"]

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [g_n.cast("long").alias("gt_len"), p_n.cast("long").alias("sim_len"),
            ratio(inter, p_n).alias("msp"), ratio(inter, g_n).alias("msr"), ratio(inter, uni).alias("miou")]
