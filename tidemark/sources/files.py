"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.sources.batches import append_batch, committed

CORRUPT = "_corrupt"
#: Bytes of a file that one task writes, or hashes, as a whole.
PART_BYTES = 32 << 20
NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("timestampNTZFormat", NTZ_FORMAT).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or one array of objects per file with ``multi_line``."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("timestampNTZFormat", NTZ_FORMAT).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", NTZ_FORMAT).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("timestampNTZFormat", NTZ_FORMAT).json(path)


def append_json_lines(df: DataFrame, path: str, timestamp_column: str = "timestamp", now=None, batch: str | None = None) -> bool:
    """Append rows as JSON lines; a missing time is stamped. A batch that was appended before adds nothing."""
    stamp = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    if timestamp_column in df.columns:
        df = df.withColumn(timestamp_column, F.coalesce(F.col(timestamp_column).cast("timestamp_ntz"), stamp))
    else:
        df = df.withColumn(timestamp_column, stamp)
    return append_batch(df, path, write_json, batch)


def append_alerts(alerts: DataFrame, path: str, batch: str | None = None) -> bool:
    return append_batch(alerts, path, write_json, batch)


def read_alerts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The alerts of all committed batches."""
    return _lines(spark, path).select(F.from_json("value", schema, {"timestampNTZFormat": NTZ_FORMAT}).alias("r")).select("r.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files in a folder and of the committed batches below it."""
    own, folders = spark.read.text(path), committed(spark, path)
    return own.unionByName(spark.read.text(folders)) if folders else own


def read_log(spark: SparkSession, path: str, schema: str, timestamp_column: str = "timestamp") -> DataFrame:
    """Log lines as rows with ``_bad`` set where a line cannot be read or has no valid time.

    The schema must name the time as a string: a line is kept or skipped by whether that
    string is a time, as the line's own content decides.
    """
    full = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = _lines(spark, path).select(parsed.alias("r")).select("r.*")
    time = F.try_to_timestamp(F.col(timestamp_column)).cast("timestamp_ntz")
    return (
        rows.withColumn("_time", time)
        .withColumn("_bad", F.col(CORRUPT).isNotNull() | F.col("_time").isNull())
        .drop(CORRUPT, timestamp_column)
        .withColumnRenamed("_time", timestamp_column)
    )


def good_lines(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("_bad")).drop("_bad")


def records_to_table(
    spark: SparkSession, rows: Sequence[dict], schema: str, anonymized_id: str | None = None, timestamp=None
) -> DataFrame:
    """A request's rows as a table, with id and time added where given."""
    df = spark.createDataFrame(list(rows), schema)
    if anonymized_id is not None:
        df = df.withColumn("anonymized_id", F.lit(anonymized_id))
    if timestamp is not None and "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.lit(timestamp).cast("timestamp_ntz"))
    return df


def json_records(df: DataFrame, json_column: str, schema: str) -> DataFrame:
    """Nested records from a text column, one struct column opened into columns."""
    keep = [c for c in df.columns if c != json_column]
    return df.select(*keep, F.from_json(json_column, schema).alias("_r")).select(*keep, "_r.*")


def parts_for(df: DataFrame, least: int, part_bytes: int = PART_BYTES) -> int:
    """How many files a table read from files should be written to, so that none grows with the table: at least ``least``."""
    sizes = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return max(least, math.ceil((sizes.agg(F.sum("size")).first()[0] or 0) / part_bytes))


def artifact_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path with its size and sha-256, hashed inside the scan tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows chosen by the md5 of seed and key: the same rows on every run, and in any engine.

    The key's columns are joined by ``|`` as text; rows of equal keys follow in the order of the key.
    """
    chosen = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(chosen, *key).limit(n)
