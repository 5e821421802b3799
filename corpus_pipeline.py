"""Corpus pipeline: raw documents to packed training sequences.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir),
reads all that its predecessor kept, and returns the columns of ``documents``
(the last one: the packed pieces).  Stages filter by small tables of decided
rows, keyed by doc_id and a hash of the row's content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesight.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from linesight.llm.common import collision_free, row_key, shared_folder, staged, table
from linesight.llm.tokens import byte_bpe_50k


def without(docs: DataFrame, decided: DataFrame, *content: str) -> DataFrame:
    """``docs`` less the rows whose (doc_id, key) is in ``decided``; key is the
    row key of the ``content`` columns."""
    gone = staged(decided.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (row_key(*content) == F.col("gone_key")), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; the rejected ones go."""
    judged = language_id.identify(language_id.documents_evidence(docs))
    return without(docs, judged.where("not accepted"), "text", "lang", "source")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; those that lose their
    whole text go, n_chars follows the text."""
    removed = collision_free(docs.columns, "n_removed")
    out = line_dedup.drop_repeated_windows(docs)
    left = out.where((F.col(removed) == 0) | (F.trim("text") != ""))
    chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; rows that repeat both id
    and text are one document."""
    judged = staged(near_dedup.near_duplicates(docs), "judged")
    kept = without(docs, judged.where("not kept"), "text")
    repeated = staged(judged.where("kept").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    ids = repeated.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    twice = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (row_key("text") == F.col("gone_key"))
    return without(kept, repeated, "text").union(kept.join(ids, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")), "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, *byte_bpe_50k())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: learned models, sketches and packing are beyond SQL: tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
