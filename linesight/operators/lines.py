"""The core relation: documents exploded into lines, and line labelling.

``split_lines`` is a generator (narrow, no shuffle): every line stays in the
partition of its document.  Index labels are marked inside the row by a sort-merge
(``split_labelled_lines``); ``array_contains`` over a carried label array and
a join form remain for lines that arrive already exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.functions import text as T


def split_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                keep: list[str] | tuple = ()) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, line_idx INT 0-based, line, *keep).

    Splits on ``\\n`` only, keeps empty and trailing pieces (``""`` -> one
    empty line); null texts produce no lines.
    """
    return docs.select(
        F.col(id_col), *[F.col(k) for k in keep],
        F.posexplode(T.split_lines(text)).alias("line_idx", "line"),
    ).select(id_col, "line_idx", "line", *keep)


def label_lines_by_index(lines: DataFrame, flaw_idx: str = "flaw_idx",
                         out: str = "hit") -> DataFrame:
    """hit = 1 iff the 0-based ``line_idx`` is in the document's index list."""
    return lines.withColumn(
        out, F.coalesce(F.array_contains(F.col(flaw_idx), F.col("line_idx")), F.lit(False))
        .cast("int"))


def split_labelled_lines(docs: DataFrame, flaw_idx: str = "flaw_idx", text: str = "text",
                         id_col: str = "doc_id", keep: list[str] | tuple = (),
                         out: str = "hit") -> DataFrame:
    """``split_lines`` and ``label_lines_by_index`` in one row-local pass.

    Index markers and lines are sorted together (a marker sorts before its
    line), so marking is n log n and the label array is never copied onto the
    lines.  Null texts produce no lines, null label arrays no hits."""
    entry = "struct<line_idx:int,kind:int,line:string>"
    lines = F.transform(T.split_lines(text), lambda l, i: F.struct(
        i.alias("line_idx"), F.lit(1).alias("kind"), l.alias("line")))
    marks = F.transform(F.coalesce(F.col(flaw_idx), F.array().cast("array<int>")), lambda f: F.struct(
        f.cast("int").alias("line_idx"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    merged = F.array_sort(F.concat(marks.cast(f"array<{entry}>"), lines.cast(f"array<{entry}>")))
    staged = docs.select(id_col, *keep, merged.alias("_merged"))
    prev = F.concat(F.array(F.lit(None).cast(entry)),
                    F.slice("_merged", 1, F.greatest(F.size("_merged") - 1, F.lit(0))))
    flagged = F.zip_with("_merged", prev, lambda x, y: F.struct(
        x["line_idx"].alias("line_idx"), x["line"].alias("line"), x["kind"].alias("kind"),
        F.coalesce((y["kind"] == 0) & (y["line_idx"] == x["line_idx"]), F.lit(False)).cast("int").alias(out)))
    rows = staged.select(id_col, *keep, flagged.alias("_flagged"))
    rows = rows.select(id_col, *keep, F.inline("_flagged")).where("kind = 1")
    return rows.select(id_col, "line_idx", "line", *keep, out)


def label_lines_by_index_join(lines: DataFrame, flaws: DataFrame, id_col: str = "doc_id",
                              out: str = "hit") -> DataFrame:
    """Join form: ``flaws(doc_id, line_idx)`` rows (duplicates allowed) flag lines."""
    marks = flaws.select(id_col, "line_idx").distinct().withColumn(out, F.lit(1))
    return (lines.join(marks, [id_col, "line_idx"], "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(0))))


def label_lines_by_text(lines: DataFrame, flaw_lines: str = "flaw_lines",
                        out: str = "hit") -> DataFrame:
    """hit = 1 iff the line's text is in the label list.  The caller passes
    ``[""]`` for documents without labels, so their blank lines are hits."""
    return lines.withColumn(
        out, F.coalesce(F.array_contains(F.col(flaw_lines), F.col("line")), F.lit(False))
        .cast("int"))


def text_labels_or_blank(col) -> "F.Column":
    """Newline-joined label text (nullable) -> label list, null -> ``[""]``."""
    return T.split_lines(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
