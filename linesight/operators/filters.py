"""Projections and row filters of the function table (all narrow, pushed
down to the scan where the predicate allows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed model-facing column names.
MODEL_COLUMNS = {"processed_func": "Text", "target": "Labels", "flaw_line": "Lines",
                 "flaw_line_index": "Line_Index", "CWE ID": "CWE", "metadata": "metadata"}


def to_model_columns(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Keep and rename the model columns; optional ones only when present."""
    m = mapping or MODEL_COLUMNS
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in m.items() if src in df.columns])


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def fill_missing(df: DataFrame, cols: list[str], value: str = "") -> DataFrame:
    return df.na.fill(value, cols)


def positives_with_lines(df: DataFrame, label: str = "target",
                         index: str = "flaw_line_index") -> DataFrame:
    return df.where((F.col(label) == 1) & F.col(index).isNotNull())


def drop_unlabelled_positives(df: DataFrame, label: str = "target",
                              index: str = "flaw_line_index") -> DataFrame:
    """NOT (positive AND no line labels); negatives stay."""
    return df.where(~((F.col(label) == 1) & F.col(index).isNull()))


def filter_category(df: DataFrame, col: str, value: str) -> DataFrame:
    """Keep one category; ``"all"`` keeps everything."""
    return df if value == "all" else df.where(F.col(col) == value)


def filter_modal(df: DataFrame, col: str) -> DataFrame:
    """Rows of the most frequent (non-null) category, ties to the smallest
    value.  The modal value is one row, joined back as a broadcast semi join."""
    top = (df.where(F.col(col).isNotNull()).groupBy(col).count()
           .orderBy(F.desc("count"), F.asc(col)).limit(1).select(col))
    return df.join(F.broadcast(top), col, "left_semi")


def holdout_split(df: DataFrame, col: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """train = categories NOT in the list (null categories stay in train, as
    pandas ``~isin`` keeps them), test = categories in the list."""
    inlist = F.coalesce(F.col(col).isin(values), F.lit(False))
    return df.where(~inlist), df.where(inlist)


def select_cells(df: DataFrame, mode: str, actual: str = "target", pred: str = "pred") -> DataFrame:
    """Row sets by (prediction, label): predicted positives, true positives
    only, predicted negatives, or actual positives."""
    a, p = F.col(actual), F.col(pred)
    cond = {"positives": p == 1, "tp_only": (p == 1) & (a == 1), "negatives": p == 0,
            "actual_positives": a == 1}[mode]
    return df.where(cond)


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """First n rows by ``order`` (a smoke slice: the limit is the feature)."""
    return df.orderBy(order).limit(n)


def flatten_pairs(df: DataFrame, vul: str = "vul", before: str = "func_before",
                  after: str = "func_after") -> DataFrame:
    """vul = 0 -> (after, 0); else (before, 1) and (after, 0)."""
    s_after = F.struct(F.col(after).alias("func"), F.lit(0).alias("vul"))
    s_before = F.struct(F.col(before).alias("func"), F.lit(1).alias("vul"))
    rows = F.when(F.col(vul) == 0, F.array(s_after)).otherwise(F.array(s_before, s_after))
    return df.select(F.inline(rows))
