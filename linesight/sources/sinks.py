"""Writers: partitioned outputs, CSV tables, nested JSON summaries, reports.

Every writer is a distributed write (one file per task); nothing is
collected to the driver.  Nested documents are assembled with
``map_from_entries`` / ``to_json`` over grouped rows whose size is bounded
by the summary's shape (slices x groups), not by the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesight.sources.readers import CSV_OPTIONS


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet",
                      **options) -> None:
    """One directory per category value (partition pruning on read)."""
    df.write.mode("overwrite").partitionBy(*by).format(fmt).options(**options).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", index: str | None = None,
                order: list | None = None) -> None:
    """CSV (header, quoted multi-line fields) or any format; optional dense
    row index column in ``order``."""
    if index:
        from linesight.operators.matching import with_row_index
        df = with_row_index(df, order or [df.columns[0]], index)
        df = df.select(index, *[c for c in df.columns if c != index])
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS)
    w.save(path)


JSON_CHUNK_BYTES = 32 * 1024 * 1024   # records of about so many bytes make one JSON value


def _json_chunks(records: DataFrame, path: str, opening: str, closing: str, chunk_bytes: int) -> None:
    """One JSON value per file: the ``value`` strings of a task, joined while
    they come in, so no partition is gathered and nothing is shuffled."""
    def joined(batches):
        held, size = [], 0
        for pdf in batches:
            for v in pdf["value"]:
                held.append(v)
                size += len(v)
                if size >= chunk_bytes:
                    yield pd.DataFrame({"value": [opening + ",".join(held) + closing]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [opening + ",".join(held) + closing]})
    (records.mapInPandas(joined, "value string").write.mode("overwrite")
     .option("maxRecordsPerFile", 1).text(path))


def write_json_arrays(df: DataFrame, path: str, chunk_bytes: int = JSON_CHUNK_BYTES) -> None:
    """JSON arrays of records, each in its own file of bounded size (the array
    layout the study's JSON files use; a multi-line JSON reader reads one
    value per file)."""
    _json_chunks(df.select(F.to_json(F.struct(*df.columns)).alias("value")), path, "[", "]", chunk_bytes)


def write_json_keyed(df: DataFrame, path: str, key: str, chunk_bytes: int = JSON_CHUNK_BYTES) -> None:
    """JSON objects {key: record}, each in its own file of bounded size."""
    vals = [c for c in df.columns if c != key]
    name = F.to_json(F.struct(F.col(key).cast("string").alias("k")))      # {"k":"..."}: the quoted key
    entry = F.concat(F.expr("substring({0}, 6, length({0}) - 6)".format("_name")), F.lit(":"), F.col("_record"))
    keyed = df.select(name.alias("_name"), F.to_json(F.struct(*vals)).alias("_record"))
    _json_chunks(keyed.select(entry.alias("value")), path, "{", "}", chunk_bytes)


def summary_json(df: DataFrame, outer: str, inner: str, metrics: list[str]) -> DataFrame:
    """{outer: {inner: {metric: value}}} as one JSON text row."""
    per_outer = df.groupBy(outer).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(inner), F.struct(*metrics)))).alias("m"))
    return per_outer.agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct(F.col(outer), F.col("m"))))).alias("value"))


def write_summary_json(df: DataFrame, path: str, outer: str, inner: str, metrics: list[str]) -> None:
    summary_json(df, outer, inner, metrics).coalesce(1).write.mode("overwrite").text(path)


def report_blocks(df: DataFrame, source: str, actual: str, predicted: str) -> DataFrame:
    """One formatted text block per row: source, actual and predicted lines."""
    # fixed layout: headings and rules of the published result files
    return df.select(F.format_string(
        "Source Code:\n%s\n" + "-" * 50 + "\nActual Vulnerable Lines:\n%s\n" + "=" * 50
        + "\n\nPredicted Vulnerable Lines:\n%s\n" + "-" * 50,
        F.col(source), F.coalesce(F.col(actual), F.lit("")),
        F.coalesce(F.col(predicted), F.lit(""))).alias("value"))


def write_report(df: DataFrame, path: str, source: str, actual: str, predicted: str) -> None:
    report_blocks(df, source, actual, predicted).write.mode("overwrite").text(path)
