"""Words of whole texts and their 64-bit hashes, vectorised over UTF-8 bytes.

An Arrow string column is one byte buffer with row offsets, so the words of
all its rows are found by two boolean masks over that buffer.  A word's hash is
a polynomial over its bytes, read from one running sum per segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT_BYTES = 1 << 19   # bytes hashed at a time; bounds the working memory
BATCH_BYTES = 1 << 20     # bytes of text taken at a time (one row at least)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: word characters by byte: everything but ASCII white space
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: word characters by byte: a-z, 0-9 and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True

_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two xor-shift-multiply rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of consecutive rows: byte spans in ``data``, hashes, and for each
    row the place of its first word (``first`` has one entry more than rows)."""
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> Words:
    data = LOWER[data]
    inside = mask[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[rows] = False
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[rows[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + SEGMENT_BYTES, side="right")))
        hi = ends[to - 1]
        up, down = _power(max(SEGMENT_BYTES, int(hi - lo)) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        hashes[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
        if hi - lo > SEGMENT_BYTES:   # powers for one very long word are not kept
            _powers.clear()
    return Words(data, offsets, starts, ends, mix(hashes), np.searchsorted(starts, offsets))


def batches(texts: pa.Array, mask: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[slice, Words]]:
    """Words of the rows, some rows at a time: about ``most`` bytes, or one longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offsets = text_buffer(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield slice(at, to), find_words(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], mask)
        at = to


_GRAM = np.random.default_rng(19700101).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (rows not considered)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j:j + n] * _GRAM[j]
    return mix(out + np.uint64(k))


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of given words, as find_words gives them in a text."""
    data, offsets = text_buffer(pa.array([" ".join(words)]))
    return find_words(data, offsets, NON_SPACE).hashes


def hash_name(name: str) -> int:
    """64-bit hash of a short string, whatever its characters."""
    raw = name.encode()
    h = np.uint64(len(raw))
    for b in raw:
        h = mix(np.array([h ^ _BYTE[b]]))[0]
    return int(h)
