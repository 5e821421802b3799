"""Token budgets of documents and the metadata derived from them.

Everything here is row-local (array higher-order functions over the lines
of one document): no shuffle.  A tokenizer family is a function
line -> token count; the two bound families are whitespace words and
4-character pieces (subword tokenizers are outside this library).
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesight.functions import text as T

MAX_TOKENS = 128      # fixed model window
SPECIAL_TOKENS = 2    # fixed: start and end markers


def words_family(line: Column) -> Column:
    return F.size(T.word_tokens(line))


def chars_family(line: Column) -> Column:
    return F.ceil(F.length(line) / 4.0).cast("int")


FAMILIES = {"words": words_family, "chars": chars_family}


def _line_tokens(text: Column, family) -> Column:
    """Tokens per line; every line but the last also carries its newline."""
    with_nl = F.transform(T.split_lines(text), lambda l: family(l) + 1)
    n = F.size(with_nl)
    return F.concat(F.slice(with_nl, 1, F.greatest(n - 1, F.lit(0))),
                    F.array(F.element_at(with_nl, -1) - 1))


def budget_index(text, family=words_family, budget: int = MAX_TOKENS) -> Column:
    """Last 1-based line such that the running token count stays within
    budget - special tokens; 0 when the first line already exceeds it."""
    avail = budget - SPECIAL_TOKENS
    toks = _line_tokens(F.col(text) if isinstance(text, str) else text, family)
    acc = F.aggregate(toks, F.struct(F.lit(0).alias("cum"), F.lit(0).alias("idx"),
                                     F.lit(False).alias("stop")),
                      lambda a, t: F.struct(
                          (a["cum"] + t).alias("cum"),
                          F.when(~a["stop"] & (a["cum"] + t <= avail), a["idx"] + 1)
                          .otherwise(a["idx"]).alias("idx"),
                          (a["stop"] | (a["cum"] + t > avail)).alias("stop")))
    return acc["idx"]


def total_tokens(text, family=words_family) -> Column:
    toks = _line_tokens(F.col(text) if isinstance(text, str) else text, family)
    return F.aggregate(toks, F.lit(0), lambda a, t: a + t) + SPECIAL_TOKENS


def budget_flags(docs: DataFrame, text: str = "text", line_no: str = "flaw_line_no",
                 budget: int = MAX_TOKENS, families: dict | None = None) -> DataFrame:
    """Adds ``metadata``: per family struct(under_128_tokens, vul_line_within_128,
    index_128, total_tokens) for documents with labelled lines, else null.
    ``line_no`` holds 1-based label line numbers."""
    fams = families or {"bert": words_family, "codet5": chars_family}
    structs = []
    for name, fam in fams.items():
        idx = budget_index(text, fam, budget)
        tot = total_tokens(text, fam)
        within = F.coalesce(F.array_max(F.col(line_no)) <= idx, F.lit(True))
        structs.append(F.struct((tot <= budget).alias("under_128_tokens"),
                                within.alias("vul_line_within_128"),
                                idx.alias("index_128"), tot.alias("total_tokens")).alias(name))
    has = F.coalesce(F.size(F.col(line_no)) > 0, F.lit(False))
    return docs.withColumn("metadata", F.when(has, F.struct(*structs)))


def budget_summary(flagged: DataFrame, metadata: str = "metadata") -> DataFrame:
    """The seven counters over the metadata column."""
    m = F.col(metadata)
    return flagged.agg(
        F.count_if(m.isNotNull()).alias("records_with_vul"),
        F.count_if(m["bert"]["under_128_tokens"]).alias("bert_under_128"),
        F.count_if(m["bert"]["vul_line_within_128"]).alias("bert_vul_within_128"),
        F.count_if(~m["bert"]["vul_line_within_128"]).alias("bert_vul_beyond_128"),
        F.count_if(m["codet5"]["under_128_tokens"]).alias("codet5_under_128"),
        F.count_if(m["codet5"]["vul_line_within_128"]).alias("codet5_vul_within_128"),
        F.count_if(~m["codet5"]["vul_line_within_128"]).alias("codet5_vul_beyond_128"))


def parse_budget_metadata(df: DataFrame, col: str = "metadata", out: str = "is_within_128",
                          family: str = "codet5") -> DataFrame:
    """JSON, else a Python-literal dict (single quotes, True/False/None);
    ``<family>.vul_line_within_128`` true or "true" -> true; anything else,
    including unparsable text or a missing column, -> false."""
    if col not in df.columns:
        return df.withColumn(out, F.lit(False))
    raw = F.col(col).cast("string")
    as_json = F.get_json_object(raw, f"$.{family}.vul_line_within_128")

    @F.pandas_udf("boolean")
    def literal_flag(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _literal_flag(t, family))

    # only what the JSON path does not answer goes through the literal parser
    literal = literal_flag(F.when(as_json.isNull(), raw))
    return df.withColumn(out, F.coalesce(F.lower(as_json) == "true", literal, F.lit(False)))


def _literal_flag(text: str | None, family: str) -> bool:
    """The family's flag in a Python-literal dict; False for anything else."""
    try:
        value = ast.literal_eval(text) if text is not None else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return False
    entry = value.get(family) if isinstance(value, dict) else None
    flag = entry.get("vul_line_within_128") if isinstance(entry, dict) else None
    return flag is True or (isinstance(flag, str) and flag.lower() == "true")
