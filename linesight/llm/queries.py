"""Queries of the training-data operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesight.llm import collocations, conversation_repair, decontaminate, exact_topk, language_id, lattice_dedup, license_scan, line_dedup, near_dedup, packing, sharding, sql, token_shards, url_filter
from linesight.llm.common import table
from linesight.llm.tokens import byte_bpe_50k

#: rules of the URL query: host, path, verdict (fixed values)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: pages with one of these words put their URL on the list
LISTED_WORDS = "idiot|moron|clown"
TRAINING_KEY = 20240517


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: rules first, then the list of canonical URLs
    under which a page with a listed word was seen."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike(rf"\b({LISTED_WORDS})\b")).select("url")
    return url_filter.judge(pages.select("page_id", "url"), listed, URL_RULES).drop("url")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, with the item and the place."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and whether it is accepted."""
    return language_id.identify(language_id.documents_evidence(table(spark, sf_dir, "documents"))).drop("key", "host", "suffix")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated three-line windows."""
    return line_dedup.drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template spans of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), *byte_bpe_50k())


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one."""
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-stride token records of every document in training order."""
    return token_shards.training_order(table(spark, sf_dir, "documents"), *byte_bpe_50k(), key=TRAINING_KEY)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component and number of links of every vector."""
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_decontaminate, op3_language_id, op4_line_dedup, op5_license_scan, op6_packing, op7_exact_topk, op8_near_dedup, op9_sharding, op10_training_order, op11_conversation_repair, op12_collocations, op13_embedding_dedup)}
ORACLES = {"op1_url_filter": sql.url_filter(URL_RULES, LISTED_WORDS), "op4_line_dedup": sql.LINE_DEDUP, "op5_license_scan": sql.license_scan(), "op7_exact_topk": sql.TOP_K, "op8_near_dedup": sql.NEAR_DEDUP, "op12_collocations": sql.collocations(), "op13_embedding_dedup": sql.EMBEDDING_DEDUP}
