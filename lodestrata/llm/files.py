"""Binary files of tasks in the shared folder, by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs

from pyspark.sql import DataFrame, SparkSession


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, ...) and the path inside it."""
    return fs.FileSystem.from_uri(uri)


def unique(folder: str, suffix: str) -> str:
    """A name no other task attempt uses; only names that a task returns are read."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def prepare(folder: str) -> None:
    system, path = resolve(folder)
    system.create_dir(path, recursive=True)


def spread(spark: SparkSession, manifest: DataFrame, files: int) -> DataFrame:
    """One partition for each file of a manifest (names and counts only)."""
    return manifest.repartition(max(1, files))
