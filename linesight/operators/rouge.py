"""ROUGE between predicted and reference texts.

ROUGE-1/2 are counted n-gram overlaps within the row: both n-gram arrays are
sorted together and folded once (the multiset intersection), without an
exchange.  ROUGE-L / Lsum need a longest common subsequence: an Arrow-batched
pandas UDF over the token arrays of one row, bit-parallel (no stemming).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from linesight.operators.overlap import multiset_overlap_arrays

TOKEN_PATTERN = "[a-z0-9]+"  # fixed: lower-cased ASCII alphanumeric runs


def rouge_tokens(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def _ngrams(toks, n: int) -> "F.Column":
    """Array of the n-grams of a token array (empty for fewer tokens)."""
    if n == 1:
        return toks
    length = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(toks, 1 + i, length).alias(f"g{i}") for i in range(n)])
    return F.transform(shifted, lambda g: F.concat_ws(" ", *[g[f"g{i}"] for i in range(n)]))


def rouge_n(df: DataFrame, pred: str, ref: str, id_col: str = "doc_id", n: int | tuple = 1) -> DataFrame:
    """(doc_id, rouge<n>_f) per row, for one n or several: a row-local counted
    overlap of n-grams, no exchange."""
    ns = (n,) if isinstance(n, int) else n
    t = df.select(id_col, rouge_tokens(pred).alias("pt"), rouge_tokens(ref).alias("rt"))
    t = t.select(id_col, *[_ngrams(F.col(c), k).alias(f"{c}{k}") for k in ns for c in ("pt", "rt")])
    scored = t
    for k in ns:
        _, _, p, r, _ = multiset_overlap_arrays(F.col(f"rt{k}"), F.col(f"pt{k}"))
        scored = scored.withColumn(f"_p{k}", p).withColumn(f"_r{k}", r)
    both = [(f"_p{k}", f"_r{k}", f"rouge{k}_f") for k in ns]
    return scored.select(id_col, *[F.when(F.col(p) + F.col(r) > 0, 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r))).otherwise(F.lit(0.0)).alias(o) for p, r, o in both])


def rouge_means(scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: the mean of every score column over all rows."""
    return scores.agg(*[F.avg(c).alias(c) for c in scores.columns if c != id_col])


def _lcs_rows(ref, cand) -> list[int]:
    """One integer for each prefix of ref: bit j is 0 where the longest common
    subsequence with cand grows at cand[j] (bit-parallel, one word a row)."""
    places: dict = {}
    for j, y in enumerate(cand):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(cand)) - 1
    rows = [full]
    for x in ref:
        v = rows[-1]
        u = v & places.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lcs(a, b) -> int:
    return len(b) - _lcs_rows(a, b)[-1].bit_count()


def _lcs_table_hits(ref, cand):
    """Indices of ref tokens on one LCS of (ref, cand)."""
    rows = _lcs_rows(ref, cand)

    def length(i, j):
        return j - (rows[i] & ((1 << j) - 1)).bit_count()
    hits, i, j = set(), len(ref), len(cand)
    while i > 0 and j > 0:
        if ref[i - 1] == cand[j - 1]:
            hits.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return hits


def _fscore(hit, pn, rn):
    p = hit / pn if pn else 0.0
    r = hit / rn if rn else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


@pandas_udf(DoubleType())
def _rouge_l(pred: pd.Series, ref: pd.Series) -> pd.Series:
    out = []
    for p, r in zip(pred, ref):
        p, r = list(p), list(r)
        out.append(_fscore(_lcs(r, p), len(p), len(r)))
    return pd.Series(out)


@pandas_udf(DoubleType())
def _rouge_lsum(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """Summary-level LCS: per reference sentence the union of LCS hits with
    every predicted sentence, clipped by the remaining token counts."""
    from collections import Counter
    out = []
    for p, r in zip(pred, ref):
        ps = [list(s) for s in p if len(s)]
        rs = [list(s) for s in r if len(s)]
        pc = Counter(t for s in ps for t in s)
        rc = Counter(t for s in rs for t in s)
        hits = 0
        for rsent in rs:
            union = set()
            for psent in ps:
                union |= _lcs_table_hits(rsent, psent)
            for i in sorted(union):
                tok = rsent[i]
                if pc[tok] > 0 and rc[tok] > 0:
                    hits += 1
                    pc[tok] -= 1
                    rc[tok] -= 1
        pn = sum(len(s) for s in ps)
        rn = sum(len(s) for s in rs)
        out.append(_fscore(hits, pn, rn))
    return pd.Series(out)


def rouge_l(df: DataFrame, pred: str, ref: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, rougeL_f, rougeLsum_f) per row."""
    def sents(c):
        return F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1), rouge_tokens)
    t = df.select(id_col, rouge_tokens(pred).alias("pt"), rouge_tokens(ref).alias("rt"),
                  sents(pred).alias("ps"), sents(ref).alias("rs"))
    return t.select(id_col, _rouge_l("pt", "rt").alias("rougeL_f"),
                    _rouge_lsum("ps", "rs").alias("rougeLsum_f"))
