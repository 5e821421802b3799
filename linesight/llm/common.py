"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesight.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, seen by driver and executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed
    once, free of lineage (a lost executor costs no recomputation), and with
    exact file sizes for the planner's broadcast decision."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of ``staged`` tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*columns: str):
    """64-bit key of a row's content.  With an id column beside it, rows share
    a key only when they are repeats of each other."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def collision_free(taken: list[str], name: str) -> str:
    """``name``, or ``name`` with underscores added until no column has it
    (column names clash without regard to case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name
