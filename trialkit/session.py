"""Session settings and reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _local_folder(prefix: str) -> str:
    """A temporary folder of a local run, removed when Python ends."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a local temporary one only for local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(_local_folder("trialkit-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


BROADCAST_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a table whose counted rows fit the bound; a larger one is joined by shuffling."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside drops its shuffle files as soon as its result is stored; otherwise they stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage and drop the lineage, with the files shuffled on the way."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, so that only shuffles of this plan go


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table: in the cluster's shared folder, or local for local runs."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/trialkit-{uuid.uuid4().hex}/{name}"
    if spark.sparkContext.master.startswith("local"):
        return f"{_local_folder('trialkit-')}/{name}"
    raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def settle(df: DataFrame) -> DataFrame:
    """Materialise a step of a loop as a written table, read back with the size of its files.

    A checkpoint keeps the optimizer's estimate of the size, which is a product over all joins; in a loop its digits double with every step.
    """
    path = scratch_path(df.sparkSession, "step")
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(name: str, cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
