"""Token scores -> line scores, vector pooling.

Line scores of documents that carry their token scores in the row are sums of
slices, taken in Arrow batches without a shuffle (``segment_sum_rows``).  Where
token scores arrive as their own relation, a token meets its line through an
equi join on (document, position).  Weight lookups by token meet the weights block by block
(``token_blocks``), so frequent tokens are no hot keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from linesight.functions import text as T
from linesight.operators.token_blocks import Lookup, looked_up


def line_token_ranges(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, line_idx, n_tok) -> + start: first token position of the line."""
    w = Window.partitionBy(id_col).orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum("n_tok").over(w), F.lit(0)))


def segment_sum(token_scores: DataFrame, ranges: DataFrame, offset: int = 0,
                id_col: str = "doc_id") -> DataFrame:
    """Line score = sum of the token scores of its consecutive slice
    [start + offset, start + offset + n_tok); positions past the scored tokens
    contribute 0.  ``token_scores(doc_id, tok_pos, score)``."""
    # a line without tokens has no slots (a sequence would count down from its start)
    slots = ranges.where("n_tok > 0").select(id_col, "line_idx", F.explode(F.sequence(
        F.col("start") + offset, F.col("start") + offset + F.col("n_tok") - 1)).alias("tok_pos"))
    slots = slots.unionByName(  # lines without tokens still get a row
        ranges.where(F.col("n_tok") == 0).select(id_col, "line_idx", F.lit(None).cast("int").alias("tok_pos")))
    j = slots.join(token_scores, [id_col, "tok_pos"], "left")
    return j.groupBy(id_col, "line_idx").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))


def segment_sum_rows(df: DataFrame, scores: str = "scores", n_tok: str = "n_tok", offset: int = 0,
                     id_col: str = "doc_id") -> DataFrame:
    """``segment_sum`` inside the row: ``scores`` array<double> holds the token scores of
    the document, ``n_tok`` array<int> the tokens of each of its lines.  (id, line_idx,
    score), one row a line, no shuffle.  Null scores, null counts and positions outside
    the scored tokens contribute 0; null arrays count as empty."""
    def run(batches):
        for batch in batches:
            values, counts = batch.column(1), batch.column(2)
            sizes, lines = (c.value_lengths().fill_null(0).to_numpy().astype("int64") for c in (values, counts))
            flat = np.append(values.flatten().fill_null(0.0).to_numpy(), 0.0)
            n = counts.flatten().fill_null(0).to_numpy().astype("int64")
            doc = np.repeat(np.arange(len(lines)), lines)
            first_line = np.repeat(np.cumsum(lines) - lines, lines)
            ends = np.cumsum(n)
            starts = ends - n
            in_doc = starts - starts[first_line] + offset   # place among the document's tokens
            base = (np.cumsum(sizes) - sizes)[doc]
            left = base + np.clip(in_doc, 0, sizes[doc])
            right = base + np.clip(in_doc + n, 0, sizes[doc])
            total = np.zeros(len(n))
            some = right > left
            if some.any():   # slices in turn with the gaps between them; each slice is summed by itself
                total[some] = np.add.reduceat(flat, np.column_stack([left[some], right[some]]).ravel())[::2]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(np.arange(len(n)) - first_line),
                                              pa.array(total)], names=[id_col, "line_idx", "score"])

    rows = df.select(id_col, F.col(scores).cast("array<double>"), F.col(n_tok).cast("array<int>"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, line_idx long, score double")


def lookup_sum(lines: DataFrame, weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Line score = Σ weight(token) over the line's whitespace tokens, missing
    weights 0.  ``weights(tok, weight)`` has one row per token.  A line's tokens
    stay in its row."""
    schema = Ty.StructType([lines.schema[id_col], lines.schema["line_idx"], Ty.StructField("score", Ty.DoubleType())])

    def run(x: Lookup):
        weight = np.append(x.values.column("weight").to_numpy(), 0.0)     # code -1: no weight
        total = np.bincount(x.row, weight[x.code], minlength=x.rows.num_rows).astype("float64")
        yield pa.RecordBatch.from_arrays([x.rows.column(0), x.rows.column(1), pa.array(total)], names=[id_col, "line_idx", "score"])
    table = weights.select("tok", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    return looked_up(lines, F.col("line"), T.word_tokens("line"), table, [F.col(id_col), F.col("line_idx")], schema, run, [id_col, "line_idx"])


def attention_token_scores(att: DataFrame, id_col: str = "doc_id", head: str = "head",
                           dst: str = "dst", w: str = "w") -> DataFrame:
    """Layer attention rows (doc, head, src, dst, w) -> per token: attention
    received summed over sources, averaged over heads."""
    heads = att.groupBy(id_col).agg(F.count_distinct(head).alias("_h"))
    recv = att.groupBy(id_col, dst).agg(F.sum(w).alias("_s"))
    return recv.join(heads, id_col).select(id_col, F.col(dst).alias("tok_pos"),
                                           (F.col("_s") / F.col("_h")).alias("score"))


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, dim, value): mean vector per key, computed per dimension."""
    ex = df.select(key, F.posexplode(vec).alias("dim", "v"))
    return ex.groupBy(key, "dim").agg(F.avg(F.col("v").cast("double")).alias("value"))
