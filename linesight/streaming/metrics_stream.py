"""Structured Streaming form of the per-document localization metrics.

Every document arrives whole in one row, and the row-local metrics are a
pure projection, so the stream needs no state and no micro-batch hook: the
file source feeds the projection, and the Parquet file sink commits each
batch through its metadata log, so a batch replayed after a failure is not
duplicated.  The stream's progress lives in the checkpoint location (a
shared folder on a cluster).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_document_stream(spark: SparkSession, source_glob: str, schema: str, sink_dir: str,
                        checkpoint_dir: str, plan: Callable[[DataFrame], DataFrame],
                        max_files_per_trigger: int | None = None) -> None:
    """Process every available file of ``source_glob`` (availableNow) with a
    stateless ``plan`` into a Parquet file sink (exactly-once through the
    sink's log and the checkpoint)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_glob)
    q = (plan(src).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def document_metrics_plan(x: int = 10) -> Callable[[DataFrame], DataFrame]:
    """documents(doc_id, text) -> per-document metrics, row-local (a pure
    projection, so it runs on the stream itself); flawed lines and line
    scores as in the batch bindings."""
    from pyspark.sql import functions as F

    from linesight.functions import text as T
    from linesight.operators.document_metrics import document_metrics
    from linesight.plans.bindings import FLAW_PATTERN

    def plan(docs: DataFrame) -> DataFrame:
        parts = T.split_lines("text")
        idx = F.filter(F.transform(parts, lambda l, i: F.when(l.rlike(FLAW_PATTERN), i)
                                   .otherwise(F.lit(-1))), lambda i: i >= 0)
        d = docs.where(F.col("text").isNotNull()).select("doc_id", "text", idx.alias("flaw_idx"))
        return document_metrics(d, lambda line: F.length(line), x=x)
    return plan
