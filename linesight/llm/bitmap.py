"""Bitmaps of 64-bit keys, of a fixed size whatever the number of keys.

A bitmap lets every key it was built from through, and others by chance; the
fuller it is, the more.  It is used where an exact test follows, so that its
size bounds what is broadcast and its fill costs work only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesight.llm import words as W

BITS = 27       # 2**27 bits, 16 MB


def place(key: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each key in a bitmap of so many words (a power of two)."""
    at = W.mix(key) & np.uint64(64 * words - 1)
    return at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))


def known(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    word, bit = place(key, len(bitmap))
    return (bitmap[word] & bit) != 0


def build(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of the first column of ``keys`` (long).  Words are put together by
    an aggregate; at most one row a word reaches the driver."""
    size = 1 << (bits - 6)

    def run(it):
        for batch in it:
            word, bit = place(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[:len(word)])
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], names=["word", "bits"])
    found = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(size, np.uint64)
    bitmap[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return bitmap


def may_hold(broadcast, key: Column) -> Column:
    """Whether a key (long, not null) may be in a broadcast bitmap; only keys go to Python."""
    @F.arrow_udf("boolean")
    def test(k: pa.Array) -> pa.Array:
        return pa.array(known(broadcast.value, k.to_numpy(zero_copy_only=False).view(np.uint64)))
    return test(key)
