"""Packing of documents into token windows: best-fit decreasing.

A document is its token ids and one separator id.  Overlong documents are
first cut into full windows; what remains of each document is one piece.
Pieces are dealt into groups of bounded size by a hash, and each group is
packed by itself: longest piece first, into the open window with the least
room that still holds it, found in a segment tree indexed by remaining
capacity.  Only piece sizes and checksums are shuffled, never ids, and a group
leaves about one window part-filled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.llm.common import staged
from linesight.llm.tokens import encoder

CAPACITY = 1024
SEPARATOR = 0
GROUP_PIECES = 32_768   # expected pieces of a group

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; ``lengths`` must not increase.

    Tree node n covers the capacities of its leaves and counts the open windows
    with that much room left."""
    width = 1 << capacity.bit_length()
    tree = [0] * (2 * width)
    open_windows: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset, used = [], [], 0

    def count(room: int, by: int) -> None:
        node = room + width
        while node:
            tree[node] += by
            node >>= 1

    for need in lengths:
        node = need + width
        while node and not tree[node]:
            while node & 1:          # a right child has nothing larger beside it
                node >>= 1
            node = node + 1 if node else 0
            if node and not tree[node]:
                node >>= 1
                while node & 1:
                    node >>= 1
                node = node + 1 if node else 0
        if node:
            while node < width:
                node = 2 * node if tree[2 * node] else 2 * node + 1
            room = node - width
            w = open_windows[room].pop()
            count(room, -1)
        else:
            room, w, used = capacity, used, used + 1
        window.append(w)
        offset.append(capacity - room)
        if room > need:
            open_windows[room - need].append(w)
            count(room - need, 1)
    return window, offset


def pieces(docs: DataFrame, path: str, pattern: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pieces of every document: full windows, then what remains."""
    def run(it):
        enc = encoder(path, pattern)
        for batch in it:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(separator)).astype("<u4")
                raw = memoryview(ids.tobytes())
                for s in range(0, len(ids), capacity):
                    e = min(s + capacity, len(ids))
                    out.append((doc, s, e - s, zlib.crc32(raw[4 * s:4 * e]), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str, pattern: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text; further columns are ignored):
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the separator alone.  Rows without doc_id are packed
    like others; repeated rows are packed each; an empty table gives no rows.
    Windows of one document never share tokens.  Pieces are dealt by their
    columns and their place, so that equal ones do not meet in one group."""
    numbered = pieces(docs, path, pattern, capacity, separator).withColumn("at", F.monotonically_increasing_id())
    parts = staged(numbered, "pieces")
    groups = max(1, -(-parts.count() // group_pieces))

    def run(key, rows):
        rows = rows.sort_by([("length", "descending")] + [(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "at")])
        window, offset = best_fit_decreasing(rows.column("length").to_pylist(), capacity)
        return rows.drop_columns(["part", "at"]).append_column("sequence_id", pa.array(np.array(window, np.int64) + (key[0].as_py() << 32))).append_column("offset", pa.array(offset, pa.int64()))
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "at"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(run, PIECE + ", sequence_id long, offset long")
