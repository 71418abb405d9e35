"""Session set-up, and the shared folder for checkpoints and derived tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a key that owns much of the rows also where an aggregate on it follows
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        # no call-site capture per Column call: plans with many expressions build twice as fast
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master.

    On a cluster the executors could not see a folder of the driver's machine, so an unset
    folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tidemark-{spark.sparkContext.applicationId}")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder.

    Used where a value must not change if a lost executor makes Spark compute it again
    (sketch-based cut points, seeded model samples).
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a fresh path in the shared folder and read it back: lineage cut, columns prunable."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for derived files under the shared folder."""
    return f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
