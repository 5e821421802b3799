"""Sharding of groups that must stay together: longest processing time first.

Equal texts are one group.  Groups above 1/``parts`` of all bytes (at most
``parts`` of them can be) are scheduled one by one.  The others are gathered
by a hash of the text into at most ``parts`` bundles, which stay together too.
So the schedule has at most 2 * ``parts`` jobs, whatever the input: they are
sorted by size and each goes to the least-loaded shard through a heap.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesight.llm.common import staged

SHARDS = 16
PARTS = 8192
SLOT_ROWS = 20_000     # expected rows numbered by one task


def longest_first(jobs: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each (size, name): largest first, to the least-loaded shard
    (ties: smaller name first, smaller shard first)."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(jobs, key=lambda j: (-j[0], j[1])):
        load, s = loads[0]
        heapq.heapreplace(loads, (load + size, s))
        out[name] = s
    return out


def shard(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of
    ``docs`` (doc_id, text; further columns are ignored).

    Size is the UTF-8 length plus 1.  A null text has no bytes and goes with the
    empty texts.  Rows without doc_id and repeated rows are placed like others;
    an empty table gives no rows."""
    spark, text = docs.sparkSession, F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = staged(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("row")), "rows")
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * parts > total
    # hexadecimal digests have no bundle's name, which starts with "b"
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("string"))
    jobs = groups.groupBy(F.when(large, F.col("digest")).otherwise(bundle).alias("job")).agg(F.sum("bytes").alias("bytes"))
    placed = longest_first([(r.bytes, r.job) for r in jobs.collect()], shards)   # 2 * parts rows at most
    plan = spark.createDataFrame(list(placed.items()) or [("", 0)], "job string, shard int")
    named = groups.select("digest", F.when(large, F.col("digest")).otherwise(bundle).alias("job")).join(F.broadcast(plan), "job").select("digest", "shard")
    cells = max(1, -(-rows.count() // SLOT_ROWS))
    out = staged(rows.join(named, "digest").withColumn("cell", F.pmod(F.xxhash64("doc_id", "row"), F.lit(cells))).drop("digest"), "placed")
    before = out.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("c")).select("shard", "cell", (F.sum("c").over(Window.partitionBy("shard").orderBy("cell")) - F.col("c")).alias("before"))
    numbered = out.withColumn("at", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "row")) - 1).join(before, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
