"""Dataset versions, content fingerprints and lineage."""

from __future__ import annotations

import uuid
from itertools import chain, count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.profile import version_statistics
from tidemark.session import checkpointed
from tidemark.sources.batches import create_new, file_system


def content_fingerprint(df: DataFrame) -> DataFrame:
    """``(n_rows, schema_hash, row_hash_sum, row_hash_xor)``: equal for equal contents in any row order."""
    columns = sorted(df.columns)
    shape = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns)
    row = F.xxhash64(*[F.col(c) for c in columns])
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sha2(F.lit(shape), 256).alias("schema_hash"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("row_hash_sum"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("row_hash_xor"),
    )


def find_duplicate(versions: DataFrame, name: str, content_hash: str) -> DataFrame:
    return versions.filter((F.col("dataset_name") == name) & (F.col("content_hash") == content_hash))


class VersionStore:
    """Versioned parquet folders with one metadata table, all below one root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _meta(self, table: str) -> str:
        return f"{self.root}/_{table}"

    def versions(self) -> DataFrame:
        return self.spark.read.schema(
            "dataset_name STRING, version STRING, content_hash STRING, n_rows BIGINT, uri STRING, source STRING, parent_version STRING, created_at TIMESTAMP_NTZ"
        ).parquet(self._meta("versions"))

    def lineage(self) -> DataFrame:
        return self.spark.read.schema(
            "input_version STRING, output_version STRING, transformation STRING, code STRING, created_at TIMESTAMP_NTZ"
        ).parquet(self._meta("lineage"))

    def _has(self, table: str) -> bool:
        fs, path = file_system(self.spark, self._meta(table))
        return fs.exists(path)

    def register(self, df: DataFrame, name: str, source: str, created_at: Column, version: str | None = None, parent: str | None = None) -> str:
        """Write a version unless the same content is already there; returns the version.

        The rows are written first, to a folder of their own, and what was written is
        fingerprinted and described; so the input is evaluated once. Then a number is
        claimed by creating its file, which one writer alone can do: latest + 1, or the next
        that is free, or a time stamp when the latest is not a number. A given version that is
        taken is an error. A writer that dies before its row is appended leaves a gap in the
        numbers, and its next try is a version of its own.
        """
        uri = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(uri)
        stored = self.spark.read.schema(df.schema).parquet(uri)
        f = content_fingerprint(stored).first()
        digest = f"{f['schema_hash'][:16]}-{f['n_rows']}-{f['row_hash_sum']}-{f['row_hash_xor']}"
        if self._has("versions"):
            same = find_duplicate(self.versions(), name, digest).limit(1).collect()
            if same:
                fs, copy = file_system(self.spark, uri)
                fs.delete(copy, True)
                return same[0]["version"]
        version = self._claim(name, version, created_at)
        version_statistics(stored).write.parquet(f"{self.root}/_statistics/{name}/v={version}")
        row = self.spark.range(1).select(
            F.lit(name).alias("dataset_name"), F.lit(version).alias("version"), F.lit(digest).alias("content_hash"),
            F.lit(f["n_rows"]).cast("long").alias("n_rows"), F.lit(uri).alias("uri"), F.lit(source).alias("source"),
            F.lit(parent).cast("string").alias("parent_version"), created_at.cast("timestamp_ntz").alias("created_at"),
        )
        row.write.mode("append").parquet(self._meta("versions"))
        return version

    def _claim(self, name: str, version: str | None, created_at: Column) -> str:
        def free(v: str) -> bool:
            return create_new(self.spark, f"{self._meta('claims')}/{name}/{v}")

        if version is not None:
            taken = self._has("versions") and self.versions().filter((F.col("dataset_name") == name) & (F.col("version") == version)).limit(1).collect()
            if taken or not free(version):
                raise ValueError(f"version {version} of {name} exists")
            return version
        latest = self.latest(name) if self._has("versions") else None
        if latest is None or latest["version"].isdigit():
            return next(v for v in map(str, count(int(latest["version"]) + 1 if latest else 1)) if free(v))
        stamp = self.spark.range(1).select(F.date_format(created_at, "yyyyMMddHHmmss")).first()[0]
        return next(v for v in chain([stamp], (f"{stamp}-{i}" for i in count(2))) if free(v))

    def latest(self, name: str):
        rows = self.versions().filter(F.col("dataset_name") == name).orderBy(F.desc("created_at"), F.desc(F.length("version")), F.desc("version")).limit(1).collect()
        return rows[0] if rows else None

    def get(self, name: str, version: str | None = None) -> DataFrame:
        """Latest or exact version; an error when there is none."""
        if version is None:
            row = self.latest(name)
        else:
            rows = self.versions().filter((F.col("dataset_name") == name) & (F.col("version") == version)).limit(1).collect()
            row = rows[0] if rows else None
        if row is None:
            raise ValueError(f"no version of {name}" if version is None else f"no version {version} of {name}")
        return self.spark.read.parquet(row["uri"])

    def statistics(self, name: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_statistics/{name}/v={version}")

    def track(self, input_version: str, output_version: str, transformation: str, created_at: Column, code: str | None = None) -> None:
        self.spark.range(1).select(
            F.lit(input_version).alias("input_version"), F.lit(output_version).alias("output_version"),
            F.lit(transformation).alias("transformation"), F.lit(code).cast("string").alias("code"),
            created_at.cast("timestamp_ntz").alias("created_at"),
        ).write.mode("append").parquet(self._meta("lineage"))


def list_versions(versions: DataFrame) -> DataFrame:
    return versions.orderBy("dataset_name", F.desc("created_at"), F.desc("version"))


def list_datasets(versions: DataFrame) -> DataFrame:
    """One row per dataset: how many versions and the newest one."""
    return versions.groupBy("dataset_name").agg(
        F.count("*").alias("n_versions"), F.max_by("version", F.struct("created_at", "version")).alias("latest_version"), F.max("created_at").alias("updated_at")
    )


def lineage_neighbours(edges: DataFrame, versions: DataFrame, direction: str = "upstream") -> DataFrame:
    """Edges joined to the version on their far side."""
    far, near = ("input_version", "output_version") if direction == "upstream" else ("output_version", "input_version")
    v = versions.withColumnRenamed("version_id", "_v")
    return edges.join(v, F.col(far) == F.col("_v")).select(F.col(near).alias("version_id"), F.col(far).alias("related_version"), "transformation", "dataset_name")


def traverse_lineage(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """``(root, version_id, depth)``: versions reached from each start in either direction.

    One equi-join per level (``depth`` is a small constant). A version keeps its least depth;
    each level is reduced to distinct pairs not reached before, so cycles end, and is
    checkpointed, so a level is computed once and the plan does not double with each one.
    """
    e = edges.select(F.col("input_version").alias("_a"), F.col("output_version").alias("_b"))
    both = checkpointed(e.union(e.select("_b", "_a")).distinct())
    seen = start.select(F.col("version_id").alias("root"), F.col("version_id"), F.lit(0).alias("depth"))
    frontier = seen
    for level in range(1, depth + 1):
        step = checkpointed(
            frontier.join(both, F.col("version_id") == F.col("_a"))
            .select("root", F.col("_b").alias("version_id"), F.lit(level).alias("depth"))
            .distinct()
            .join(seen.select("root", "version_id"), ["root", "version_id"], "left_anti")
        )
        seen = seen.unionByName(step)
        frontier = step
    return seen
