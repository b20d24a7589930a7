"""Session settings, and the shared folder used for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str, cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the session comes from spark-submit."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting: it then gets a temporary folder. On a cluster a missing
    setting is an error, since a machine-local folder would lose data with its executor.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    base = tempfile.mkdtemp(prefix="topicweave-")
    spark.conf.set(CHECKPOINT_KEY, base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so a retry cannot read half-written data."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are removed at its end. For work whose results are collected, written or made
    local inside; a data frame that still reads a staged table must not leave the block."""
    first = len(_STAGED)
    try:
        yield
    finally:
        mine = _STAGED[first:]
        del _STAGED[first:]
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside the block send Python at most ``rows`` rows at once; for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_STAGED: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and survives lost executors.

    The table stays until the ``staging`` block around it ends; without one, until the shared folder is cleared.
    """
    path = scratch_path(df.sparkSession, name)
    _STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
