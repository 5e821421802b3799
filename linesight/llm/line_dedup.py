"""Removal of repeated passages: overlapping three-line windows.

Every run of three consecutive lines is hashed (128 bits); a text of one or two
lines is one window of them all.  A window that occurs again anywhere has a first
occurrence, by (doc_id, place); the others are later ones.
A line goes when a later occurrence covers it and no first occurrence of a
repeated window does, so every passage stays whole where it stands first.
Built from DataFrame functions alone: the windows are the only rows shuffled
beside the documents that lose lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.llm.common import collision_free, row_key, staged

LINES = 3


def covered_lines(docs: DataFrame, k: int = LINES) -> DataFrame:
    """(doc_id, key, gone): places of the windows' lines that go, for the
    documents that lose any."""
    lined = docs.select("doc_id", "key", F.split("text", "\n", -1).alias("l")).where("l is not null")
    hashed = lined.select("doc_id", "key", F.least(F.size("l"), F.lit(k)).alias("n"), F.transform("l", lambda x: F.when(F.trim(x) != "", F.xxhash64(x)).otherwise(F.lit(0).cast("long"))).alias("h"))
    # a short text is filled up; n tells its window from those of longer texts
    full = F.concat("h", F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.col("n")))
    zipped = F.arrays_zip(*[F.slice(full, 1 + i, F.size(full) - (k - 1)).alias(f"h{i}") for i in range(k)])
    w = hashed.select("doc_id", "key", "n", F.posexplode(zipped).alias("place", "w")).where(" or ".join(f"w.h{i} <> 0" for i in range(k)))
    words = ["n", *[f"w.h{i}" for i in range(k)]]
    w = staged(w.select("doc_id", "key", "n", "place", F.xxhash64(*words).alias("window"), F.xxhash64(F.lit(1), *words).alias("window2")), "windows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place")).alias("first")
    repeated = w.groupBy("window", "window2").agg(F.count(F.lit(1)).alias("c"), first).where("c > 1").select("window", "window2", "first")
    hit = w.join(repeated, ["window", "window2"])
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place") == F.col("first")
    spots = hit.select("doc_id", "key", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("line"), own.alias("own"))
    gone = spots.groupBy("doc_id", "key", "line").agg(F.max("own").alias("own")).where("not own")
    # gathers the lines of one document at most
    return gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def drop_repeated_windows(docs: DataFrame, k: int = LINES) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and n_lines and
    n_removed (long) appended (underscores added where the name is taken).

    Lines end at "\\n".  Windows of blank lines only never count.  A text of fewer
    than k lines is one window of them all, and repeats only such a text.  Null
    and empty texts stay as they are; n_lines of a null text is 0.  Rows without doc_id come after all others in the order of
    occurrences; rows that repeat id and text count as one occurrence each of
    the same document, so they keep and lose the same lines.  All columns and rows stay;
    an empty table stays empty."""
    key = collision_free(docs.columns, "key")
    n_lines, n_removed = (collision_free(docs.columns, c) for c in ("n_lines", "n_removed"))
    rows = docs.withColumn(key, row_key("text"))
    gone = covered_lines(rows.select(F.col("doc_id"), F.col(key).alias("key"), F.col("text")), k)
    mark, at, own_id = (collision_free([*docs.columns, key], c) for c in ("gone", "row_key", "row_doc"))
    gone = gone.select(F.col("doc_id").alias(own_id), F.col("key").alias(at), F.col("gone").alias(mark))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(at)), "left")
    lines = F.split("text", "\n", -1)
    # one flag a line, laid out gap by gap between the sorted places that go
    gap = lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.when(i > 0, F.get(mark, i - 1)).otherwise(-1) - 1), F.array(F.lit(True)))
    flags = F.concat(F.flatten(F.transform(mark, gap)), F.array_repeat(F.lit(False), F.size(lines) - 1 - F.element_at(mark, -1)))
    left = F.transform(F.filter(F.arrays_zip(lines.alias("line"), flags.alias("goes")), lambda z: ~z["goes"]), lambda z: z["line"])
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    keep = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*keep, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines), F.coalesce(F.size(mark), F.lit(0)).cast("long").alias(n_removed))
