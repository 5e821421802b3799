"""Streaming: the flagship metrics computed by a file stream over the
documents table; the result equals the batch query."""

from __future__ import annotations



from linesight.plans import sql_parts as S
from linesight.plans.io import scratch
from linesight.plans.localization import METRIC_SELECT
from linesight.plans.registry import register
from linesight.streaming.metrics_stream import document_metrics_plan, run_document_stream


@register("stream_localization_metrics", sql=S.METRICS + f"""
SELECT {METRIC_SELECT} FROM metrics""")
def q_stream_metrics(spark, sf_dir):
    root = scratch(spark, "stream")
    run_document_stream(spark, f"{sf_dir}/documents*.parquet", "doc_id long, text string",
                        f"{root}/out", f"{root}/checkpoint", document_metrics_plan())
    return spark.read.parquet(f"{root}/out").select(
        "doc_id", *[c for c in METRIC_SELECT.replace(" ", "").split(",") if c != "doc_id"])



