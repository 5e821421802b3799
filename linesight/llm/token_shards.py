"""Training-order materialisation: fixed-stride token shards in permuted order.

Every document becomes windows of ``stride`` ids (the last one padded).
Windows are numbered 0..N-1 by file split and place in it; a keyed Feistel
network over the next even power of two, walked until the value is below N,
permutes the numbers into slots without any sort or table.  Shard s holds slots
s * rows .. (s + 1) * rows - 1: one task each, in slot order, every record
equally long, so record i of a shard begins at byte i * stride * width and
training resumes from any slot.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linesight.llm.common import shared_folder
from linesight.llm.tokens import encoder
from linesight.llm.words import mix

STRIDE = 1024
SEPARATOR = 0
ROWS_PER_SHARD = 8192
ROUNDS = 6
WINDOW = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary, split int, place long"


def _round_keys(key: int, n: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64) + np.uint64(n))


def _feistel(x: np.ndarray, keys, half: np.uint64) -> np.ndarray:
    low = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & low
    for k in keys:
        left, right = right, left ^ (mix(right + k) & low)
    return (left << half) | right


def _unfeistel(x: np.ndarray, keys, half: np.uint64) -> np.ndarray:
    low = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & low
    for k in keys[::-1]:
        left, right = right ^ (mix(left + k) & low), left
    return (left << half) | right


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slot of each index under ``key``: a permutation of 0..n-1 (or its inverse)."""
    half, keys, step = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2)), _round_keys(key, n), _unfeistel if inverse else _feistel
    x = np.asarray(index).astype(np.uint64)
    if len(x):
        x = step(x, keys, half)
        while (out := x >= n).any():   # cycle-walking: four rounds at most on average
            x[out] = step(x[out], keys, half)
    return x.astype(np.int64)


def id_type(path: str, pattern: str | None = None) -> str:
    """Smallest unsigned little-endian type that holds every id of the tokenizer."""
    return "<u2" if encoder(path, pattern).exact.get_vocab_size() <= 2**16 else "<u4"


def windows(docs: DataFrame, path: str, pattern: str | None, stride: int, separator: int, dtype: str) -> DataFrame:
    def run(it):
        from pyspark import TaskContext
        enc, split, place = encoder(path, pattern), TaskContext.get().partitionId(), 0
        for batch in it:
            out: list[tuple] = []

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)
            names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32", "ids", "split", "place"], [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int64()]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(separator)).astype(dtype)
                for s in range(0, len(ids), stride):
                    raw = ids[s:s + stride].tobytes()
                    out.append((doc, s, len(raw) // ids.itemsize, zlib.crc32(raw), raw, split, place))
                    place += 1
                    if len(out) >= 4096:
                        yield flush()
                        out.clear()
            yield flush()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, WINDOW)


def training_order(docs: DataFrame, path: str, pattern: str | None = None, key: int = 0, stride: int = STRIDE, separator: int = SEPARATOR, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Records in training order: slot, shard, byte_offset, doc_id, start,
    n_tokens, ids_crc32 (of the unpadded ids) and ids (fixed-stride bytes, zeros
    after n_tokens).

    ``docs`` needs doc_id and text; further columns are ignored.  A null or
    empty text is one window with the separator alone; rows without doc_id and
    repeated rows have windows like others; an empty table has no records."""
    spark, dtype = docs.sparkSession, id_type(path, pattern)
    width = int(dtype[-1])
    folder = shared_folder(spark, "windows")
    # the numbering is frozen in these files: a lost task cannot renumber
    (seen := windows(docs, path, pattern, stride, separator, dtype)).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.schema(seen.schema).parquet(folder)
    splits = stored.groupBy("split").agg(F.count(F.lit(1)).alias("c"))   # one row per task
    n = splits.agg(F.sum("c")).first()[0] or 0
    before = splits.select("split", (F.sum("c").over(Window.orderBy("split")) - F.col("c")).alias("before"))
    shards = max(1, -(-n // rows_per_shard))

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), n, key))

    # one row of two numbers for each task that wrote: broadcast, so that ids move once
    out = stored.join(F.broadcast(before), "split").withColumn("slot", slot(F.col("before") + F.col("place"))).withColumn("shard", F.floor(F.col("slot") / rows_per_shard).cast("int"))
    dealt = out.select("slot", "shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids").repartitionById(shards, "shard").sortWithinPartitions("slot")
    full = F.rpad("ids", stride * width, F.lit(bytes(1)))
    return dealt.select("slot", "shard", (F.col("slot") % rows_per_shard * stride * width).alias("byte_offset"), "doc_id", "start", "n_tokens", "ids_crc32", full.alias("ids"))


def write_shards(records: DataFrame, path: str) -> None:
    """One file per shard below ``shard=<s>``, records in slot order."""
    records.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Records from a slot on: earlier shards are not opened."""
    return spark.read.parquet(path).where((F.col("shard") >= from_slot // rows_per_shard) & (F.col("slot") >= from_slot)).sortWithinPartitions("slot")
