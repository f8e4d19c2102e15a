"""Binary files in the shared scratch folder, by any file system that Arrow knows."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from ..session import scratch_path


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder's address in the shared scratch folder, new for every call."""
    return scratch_path(spark, label)


def create(folder: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file under a name of its own, so that repeated attempts of a task never meet."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(os.path.join(path, name))


def open_at(address: str) -> pa.NativeFile:
    """A file for reading at any offset."""
    system, path = fs.FileSystem.from_uri(address)
    return system.open_input_file(path)
