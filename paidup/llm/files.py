"""Binary files that tasks write to the shared folder and read from it, by any path that pyarrow opens."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from paidup.workspace import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for this run, in the folder that all executors share."""
    root = shared_folder(spark)
    return f"{root}/paidup-{name}-{uuid.uuid4().hex}"


def created(folder: str, suffix: str):
    """A new file and its path. Each attempt of a task writes files of its own; only those that the
    finished attempt names in its rows count, so a lost executor leaves at most files nobody reads."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def opened(path: str):
    system, own = fs.FileSystem.from_uri(path)
    return system.open_input_file(own)
