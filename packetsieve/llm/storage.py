"""Files of our own formats in the shared folder, written and read inside tasks."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a Hadoop-style URI (``file:/x``, ``file:///x``, ``hdfs://..``, ``s3://..``) and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def put(folder: str, name: str, data: bytes) -> str:
    """Write one file under a name that no other attempt has; returns the name.

    Readers take the names from the written table of the job, so what a lost or
    repeated attempt leaves behind is never read.
    """
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return name


def get(folder: str, name: str, start: int = 0, size: int | None = None) -> bytes:
    """A range of a file, or all of it."""
    store, path = filesystem(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read_at(f.size() - start if size is None else size, start)


def partition() -> int:
    return TaskContext.get().partitionId()


#: Tasks that open files side by side at most.
MOST_TASKS = 10_000


def dealt(listed: DataFrame, *keys: str, each: int = 1) -> DataFrame:
    """Rows that each stand for a file or a block, a task for every ``each`` of them up to ``MOST_TASKS``.

    Tasks open what they are dealt by :func:`get`; no contents are shuffled. The
    number of tasks is fixed, as adaptive execution would merge such small rows.
    """
    return listed.repartition(min(MOST_TASKS, max(1, -(-listed.count() // each))), *keys)
