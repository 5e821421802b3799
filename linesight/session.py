"""Session helpers.

The library never creates its own cluster settings beyond what a Spark user
would set for this workload: AQE on (runtime coalescing and skew-join
splitting), a UTC session clock and Arrow for the few pandas UDFs.  The
checkpoint directory is read from the session (``spark.checkpoint.dir``);
a scratch directory is only chosen when the session has none, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "linesight", driver_memory: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # drop checkpoint files once their relation is no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:   # local mode runs every task in the driver JVM
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, choosing a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    it is used as is.  Only a local session without it (tests) gets a fresh
    ``mktemp``-style directory; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="linesight-ckpt-",
                                    dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Compute a relation once and cut its lineage (reliable checkpoint into
    the session's checkpoint dir).  Used for base relations that a plan reads
    several times, so the source is not re-scanned and re-split per use."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name):
    """Compute a relation once and keep it compressed (Parquet, zstd) below the
    checkpoint folder; ``dropped`` removes it.  For relations that are larger
    than what is read of them at once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_paths = [path]
    return out


def dropped(*tables):
    """Remove the files of ``stored`` tables that nothing reads any more."""
    for path in (p for t in tables for p in t.stored_paths):
        where = tables[0].sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(tables[0].sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark):
    """The shuffle files of a query inside go when it has ended, not when the driver
    collects its garbage.  For steps that store their result and follow one another."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
