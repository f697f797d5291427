"""Files of tasks in the shared folder.

A task writes under a name that holds its attempt, and lists it in its output rows. Only files that a committed
table lists are read, so files of lost or repeated attempts are never seen.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from spendlens.session import shared_folder


def new_folder(spark: SparkSession, what: str) -> str:
    folder = shared_folder(spark)
    if "://" not in folder:
        folder = folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def attempt_name(folder: str, ending: str) -> str:
    at = TaskContext.get()
    return f"{folder}/{at.partitionId():06d}-{at.taskAttemptId()}.{ending}"


def create(uri: str):
    """An output stream; the folder is made where the store has folders."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def stream(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def at_random(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def fresh(df: DataFrame, *names: str) -> str | list[str]:
    """Column names that the rows do not have yet (names are compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out if len(out) > 1 else out[0]
