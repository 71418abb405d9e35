"""Append-only folders of batches: a batch counts when its marker is there, and only once.

A writer that is run again, or that died half-way, leaves no row twice and no half batch:
each batch is a folder of its own, replaced as a whole until its marker is set, and readers
take the folders with a marker.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARKER = "_COMMITTED"
PREFIX = "batch-"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that holds a path, and the path as its object."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there already (as exclusive as the file system's create)."""
    fs, at = file_system(spark, path)
    fs.mkdirs(at.getParent())
    try:
        return fs.createNewFile(at)
    except Exception as error:  # another writer was first
        if "FileAlreadyExists" in str(error):
            return False
        raise


def append_batch(df: DataFrame, path: str, save: Callable[[DataFrame, str], None], batch: str | None = None) -> bool:
    """Write the rows as one batch; a batch that is committed already adds nothing (false).

    ``save(df, folder)`` must replace the folder. Without a name the batch is a new one.
    """
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/{PREFIX}{batch or uuid.uuid4().hex}"
    fs, marker = file_system(spark, f"{folder}/{MARKER}")
    if fs.exists(marker):
        return False
    save(df, folder)
    return create_new(spark, f"{folder}/{MARKER}")


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of committed batches."""
    fs, markers = file_system(spark, f"{path.rstrip('/')}/{PREFIX}*/{MARKER}")
    return [s.getPath().getParent().toString() for s in fs.globStatus(markers) or ()]
