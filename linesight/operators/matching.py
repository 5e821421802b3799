"""Ground-truth matching joins and positional verification.

Exact match: the ground truth is first reduced to one row per normalized
text carrying the first index overall and the first index per class, so a
text duplicated across a third of the table still meets every left row in
a single one-row-per-key equi join (AQE splits a hot left key; no pairs).
Texts are joined by the 128-bit digest of their normalized form, so exact
matching shuffles no text.

Prefix fallback (rows without an exact match): candidates share the first
150 normalized characters, and those where one text starts with the other
win.  A block can hold a third of all texts (a shared licence header), so
the starts-with candidates are found without comparing pairs, by one sorted
scan of all texts (``prefix_scan``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.functions import text as T
from linesight.operators.prefix_scan import prefix_minima

UNKNOWN_PROJECT = "unknown"  # fixed default of unmatched rows


def _coerce_target(col) -> "F.Column":
    """True or 1 -> 1, anything else -> 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.cast("string").isin("true", "1"), 1).otherwise(0)


def digest(col) -> "F.Column":
    """Join key of a text: 128 bits instead of the text itself."""
    return F.unhex(F.md5(F.encode(col, "UTF-8")))


def _first_by_class(g: DataFrame, key: str) -> DataFrame:
    return g.groupBy(key).agg(
        F.min("gt_idx").alias("first_any"),
        F.min(F.when(F.col("gt_target") == 1, F.col("gt_idx"))).alias("first_1"),
        F.min(F.when(F.col("gt_target") == 0, F.col("gt_idx"))).alias("first_0"))


def _digests(df: DataFrame, func: str, n: int, *cols) -> DataFrame:
    """``cols`` with the digest of the normalized text and that of its first n
    characters (the block): all that matching needs of most texts."""
    norm = df.select(*cols, T.normalize_whitespace(func).alias("_norm"))
    return norm.select(*norm.columns[:-1], digest(F.col("_norm")).alias("dig"),
                       digest(F.substring("_norm", 1, n)).alias("block"))


def _left_digests(left: DataFrame, id_col: str, func: str, target: str, n: int) -> DataFrame:
    return _digests(left, func, n, F.col(id_col), F.col(target).alias("_t"))


def _gt_digests(gt: DataFrame, n: int) -> DataFrame:
    return _digests(gt, "func", n, F.col("gt_idx"), _coerce_target("target").alias("gt_target"))


def _exact(rows: DataFrame, g: DataFrame, id_col: str) -> DataFrame:
    m = rows.join(_first_by_class(g, "dig"), "dig")
    pick = F.coalesce(F.when(F.col("_t") == 1, F.col("first_1")).otherwise(F.col("first_0")),
                      F.col("first_any"))
    return m.select(id_col, pick.alias("gt_idx"))


def match_exact(left: DataFrame, gt: DataFrame, id_col: str = "row_id", func: str = "func",
                target: str = "target") -> DataFrame:
    """(row_id, gt_idx) for rows whose normalized text equals a ground-truth
    text: the first candidate with the same class, else the first."""
    n = T.PREFIX_LEN
    return _exact(_left_digests(left, id_col, func, target, n), _gt_digests(gt, n), id_col)


def match_prefix(left: DataFrame, gt: DataFrame, id_col: str = "row_id", func: str = "func",
                 target: str = "target", n: int = T.PREFIX_LEN) -> DataFrame:
    """(row_id, gt_idx) for rows (already without an exact match) whose first
    n normalized characters equal a ground-truth prefix.  One candidate is
    taken as is; otherwise candidates where either text starts with the other
    win, among them the same class first, each time the first index; with no
    such candidate, the block's first.  Blocks are keyed by the digest of the
    prefix, and no two texts of a block are compared as a pair."""
    from linesight.session import materialize
    rows, g = materialize(_left_digests(left, id_col, func, target, n)), materialize(_gt_digests(gt, n))
    return _prefix(left, gt, rows, g, id_col, func, n)


def _prefix(left: DataFrame, gt: DataFrame, rows: DataFrame, g: DataFrame, id_col: str, func: str,
            n: int) -> DataFrame:
    """``match_prefix`` on the digests ``rows`` and ``g``; ids are unique.  Texts
    are read again for blocks of several candidates only, once per different text."""
    from linesight.session import materialize
    blocks = g.groupBy("block").agg(F.count(F.lit(1)).alias("n_cand"), F.min("gt_idx").alias("block_first"))
    in_block = materialize(rows.withColumnRenamed("dig", "rdig").join(blocks, "block"))
    several = in_block.where(F.col("n_cand") > 1)
    one = several.groupBy(F.col("rdig").alias("dig")).agg(F.min(id_col).alias(id_col))
    r = left.select(id_col, func).join(one, id_col).select("dig", T.normalize_whitespace(func).alias("norm"))
    firsts = _first_by_class(g.join(several.select("block").distinct(), "block", "left_semi"), "dig")
    gd = (gt.select(F.col("gt_idx").alias("first_any"), "func").join(firsts, "first_any")
          .select("dig", T.normalize_whitespace("func").alias("norm"), "first_any", "first_1", "first_0"))
    r, gd = materialize(r), materialize(gd)   # counted, sampled and sorted
    res = in_block.join(prefix_minima(r, gd.where(F.length("norm") >= n)), "rdig", "left")
    same = F.when(F.col("_t") == 1, F.col("first_1")).otherwise(F.col("first_0"))
    pick = F.when(F.col("n_cand") == 1, F.col("block_first")).otherwise(
        F.coalesce(same, F.col("first_any"), F.col("block_first")))
    return res.select(id_col, pick.alias("gt_idx"))


def match_ground_truth(left: DataFrame, gt: DataFrame, id_col: str = "row_id", func: str = "func",
                       target: str = "target", n: int = T.PREFIX_LEN) -> DataFrame:
    """Exact, then prefix, then defaults.  ``gt`` carries gt_idx, func, target,
    project, code (array<string>), line_no (array<int>), metadata (struct).
    Output: left columns + project, flaw_line, flaw_line_index, metadata."""
    from linesight.session import materialize
    rows, g = materialize(_left_digests(left, id_col, func, target, n)), materialize(_gt_digests(gt, n))
    exact = materialize(_exact(rows, g, id_col))
    rest = rows.join(exact.select(id_col), id_col, "left_anti")
    prefix = _prefix(left, gt, rest, g, id_col, func, n)
    resolved = exact.unionByName(prefix)
    props = gt.select(
        "gt_idx", F.col("project").alias("_project"),
        F.array_join(F.coalesce(F.col("code"), F.array().cast("array<string>")), T.LIST_SEP)
        .alias("_flaw_line"),
        F.array_join(F.transform(F.coalesce(F.col("line_no"), F.array().cast("array<int>")),
                                 lambda x: x.cast("string")), T.INT_SEP).alias("_flaw_line_index"),
        T.metadata_json("metadata").alias("_metadata"))
    out = left.join(resolved, id_col, "left").join(props, "gt_idx", "left")
    return out.select(
        *[F.col(c) for c in left.columns],
        F.coalesce(F.col("_project"), F.lit(UNKNOWN_PROJECT)).alias("project"),
        F.coalesce(F.col("_flaw_line"), F.lit("")).alias("flaw_line"),
        F.coalesce(F.col("_flaw_line_index"), F.lit("")).alias("flaw_line_index"),
        F.coalesce(F.col("_metadata"), F.lit("")).alias("metadata"))


def zip_verified(a: DataFrame, b: DataFrame, pos: str = "pos", text_a: str = "text",
                 text_b: str = "text", label_b: str = "label", strict: bool = True) -> DataFrame:
    """Align two tables on their row position, verify the texts agree up to the
    shorter one (``\\r`` removed, ends stripped) and take b's label.  Rows past
    the shorter table are dropped (zip semantics); a mismatch raises."""
    j = (a.join(b.select(F.col(pos), F.col(text_b).alias("_tb"), F.col(label_b).alias("_lb")), pos)
         .withColumn("_ok", T.same_prefix(F.col(text_a), F.col("_tb"))))
    if strict:
        bad = j.where(~F.col("_ok")).select(pos).orderBy(pos).limit(1).collect()
        if bad:
            raise ValueError(f"text mismatch at position {bad[0][0]}")
    return j.drop("_tb", "_ok").withColumnRenamed("_lb", label_b)


def with_row_index(df: DataFrame, order: list, out: str = "row_index", key: str | None = None) -> DataFrame:
    """Dense 0-based position in ``order`` from range-partitioned offsets (no
    single-partition window).  With ``key``, a unique column that the order
    can be told from, only that column is sorted and the rows meet their
    position by it."""
    from linesight.operators.global_order import with_global_position
    if key is not None:
        ranks = with_row_index(df.select(key), order, out).withColumnRenamed(key, "_key")
        return df.join(ranks, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    pos = with_global_position(df.withColumn("_one", F.lit(0)), order, hit="_one")
    return (pos.withColumn("_ri", F.col("pos") - 1).drop("pos", "cum_hits", "_one")
            .withColumnRenamed("_ri", out))
