"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A shuffled join whose partitions all fit this size needs no sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    # Small batches of packed blocks reach Python faster than a few huge ones.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build_session(app_name: str = "packetsieve", master: str | None = None, **extra) -> SparkSession:
    """A session with the settings above. Shuffle partitions stay the caller's choice."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Local mode without that setting gets a folder of its own. A cluster without
    it is refused, because a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="packetsieve-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


_paths: ContextVar[list[str] | None] = ContextVar("scratch_paths", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for one intermediate table."""
    path = f"{shared_folder(spark)}/packetsieve/{label}-{uuid.uuid4().hex}"
    if _paths.get() is not None:
        _paths.get().append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables of a job when it ends, also when it fails."""
    token = _paths.set([])
    try:
        yield
    finally:
        drop_paths(spark, _paths.get())
        _paths.reset(token)


def drop_paths(spark: SparkSession, paths) -> None:
    """Delete tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
