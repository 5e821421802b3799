"""Function-level classification metrics.

All metrics are one pass of conditional counts (partial aggregation map
side, one tiny final merge).  Per-class tables are built from the confusion
cells ``groupBy(actual, pred)``, whose size is bounded by classes².
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.functions.arrays import fbeta

EPS = 1e-7  # fixed smoothing constant of the soft metrics


def _div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def threshold_predict(df: DataFrame, proba: str = "proba", out: str = "pred",
                      p: float = 0.5) -> DataFrame:
    return df.withColumn(out, (F.col(proba) > p).cast("int"))


def confusion_matrix(df: DataFrame, actual: str = "target", pred: str = "pred") -> DataFrame:
    a, p = F.col(actual), F.col(pred)
    return df.agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"), F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"), F.count_if((a == 1) & (p == 1)).alias("tp"))


def classification_metrics(df: DataFrame, actual: str = "target", pred: str = "pred") -> DataFrame:
    """accuracy, precision, recall, F1, F2 = 5PR/(4P+R), AUC on hard labels =
    (TPR + TNR) / 2.  Zero denominators give 0 (the library's zero_division)."""
    cm = confusion_matrix(df, actual, pred)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    tnr = _div(tn, tn + fp)
    return cm.select(
        _div(tp + tn, n).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        fbeta(prec, rec, 1.0).alias("f1"), fbeta(prec, rec, 2.0).alias("f2"),
        ((rec + tnr) / 2.0).alias("roc_auc"))


def _per_class(df: DataFrame, actual: str, pred: str) -> DataFrame:
    cells = df.groupBy(F.col(actual).alias("a"), F.col(pred).alias("p")).count()
    per_actual = cells.groupBy(F.col("a").alias("label")).agg(F.sum("count").alias("support"))
    per_pred = cells.groupBy(F.col("p").alias("label")).agg(F.sum("count").alias("predicted"))
    diag = cells.where(F.col("a") == F.col("p")).select(F.col("a").alias("label"),
                                                         F.col("count").alias("correct"))
    t = (per_actual.join(per_pred, "label", "full").join(diag, "label", "left")
         .na.fill(0, ["support", "predicted", "correct"]))
    prec, rec = _div(F.col("correct"), F.col("predicted")), _div(F.col("correct"), F.col("support"))
    return t.select("label", prec.alias("precision"), rec.alias("recall"),
                    fbeta(prec, rec, 1.0).alias("f1"), F.col("support").cast("long"),
                    F.col("correct"))


def macro_metrics(df: DataFrame, actual: str = "target", pred: str = "pred") -> DataFrame:
    pc = _per_class(df, actual, pred)
    return pc.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                  F.avg("f1").alias("f1"))


def classification_report(df: DataFrame, actual: str = "target", pred: str = "pred") -> DataFrame:
    """Per class precision/recall/F1/support, then accuracy, macro avg and
    weighted avg rows (accuracy carries only f1 = accuracy and support)."""
    pc = _per_class(df, actual, pred)
    rows = pc.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1",
                     "support")
    tot = pc.agg(F.sum("support").alias("n"), F.sum("correct").alias("c"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 F.sum(F.col("precision") * F.col("support")).alias("wp"),
                 F.sum(F.col("recall") * F.col("support")).alias("wr"),
                 F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n")
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), _div(F.col("c"), n).alias("f1"),
                     n.cast("long").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1"), n.cast("long").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("label"), _div(F.col("wp"), n).alias("precision"),
                     _div(F.col("wr"), n).alias("recall"), _div(F.col("wf"), n).alias("f1"),
                     n.cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(mac).unionByName(wei)


def soft_confusion_metrics(df: DataFrame, actual: str = "target", proba: str = "proba",
                           eps: float = EPS) -> DataFrame:
    """Smoothed precision/recall/F1/F2 from rounded, clipped products (the
    training-time metric of the earlier study); rounding is half-to-even."""
    y, p = F.col(actual).cast("double"), F.col(proba).cast("double")

    def rclip(c):
        return F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 0)
    agg = df.agg(F.sum(rclip(y * p)).alias("tp"), F.sum(rclip(y)).alias("pos"),
                 F.sum(rclip(p)).alias("pp"))
    prec = (F.col("tp") + eps) / (F.col("pp") + eps)
    rec = (F.col("tp") + eps) / (F.col("pos") + eps)
    return agg.select(prec.alias("precision"), rec.alias("recall"),
                      (2 * (prec * rec) / (prec + rec + eps)).alias("f1"),
                      (5 * (prec * rec) / (4 * prec + rec + eps)).alias("f2"))


def mean_loss(df: DataFrame, actual: str = "target", proba: str = "proba") -> DataFrame:
    """Mean binary cross-entropy: -avg(ln p_label), p_label = p for class 1
    and 1 - p for class 0."""
    p = F.col(proba).cast("double")
    pl = F.when(F.col(actual) == 1, p).otherwise(1.0 - p)
    return df.agg(F.avg(-F.ln(pl)).alias("loss"))
