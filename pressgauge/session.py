"""Session defaults and the shared folder used for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pressgauge.settings import SHUFFLE_ROWS


def build_session(app_name: str = "pressgauge", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PRESSGAUGE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there
    the driver and the executors are one process.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pressgauge-"))
    return context.getCheckpointDir().rstrip("/")


_SCOPES: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for one staged table."""
    return f"{_SCOPES[-1] if _SCOPES else shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside the block share one folder, which is deleted at its end, after an error as well.

    Only results that were written elsewhere, or collected, outlive the block.
    Blocks may be nested; each deletes its own folder.
    """
    folder = fresh_path(spark, "scope")
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def enough_partitions(spark: SparkSession, rows: int, rows_each: int = SHUFFLE_ROWS) -> Iterator[int]:
    """What runs inside the block deals ``rows`` rows to partitions of about ``rows_each`` at most.

    The memory of a task then follows from ``rows_each`` and not from the table.
    Never fewer than the session asks for; adaptive execution merges small
    ones. Only for work that is carried out inside the block, as ``stage`` does.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    wanted = max(int(before), -(-rows // rows_each))
    spark.conf.set(name, str(wanted))
    try:
        yield wanted
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table is read several times, or where lineage must end: the
    files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
