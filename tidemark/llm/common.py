"""Small helpers that several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Records per Arrow batch for whole texts: bounds a Python worker's memory when texts are long.
TEXT_BATCH_ROWS = 512

#: The White_Space characters of Unicode, as both tokenizer libraries' patterns see them (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A run of white space with the word after it, or white space at the end: no token crosses these cuts.
SPACED_WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    text_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_or_empty(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value computed once and used many times inside an expression, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def finite_vectors(df: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """(id, v, others): rows whose vector, as doubles, is there, not empty, and holds neither null nor a non-finite entry."""
    v = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *others).where(F.size("v") > 0)
    return v.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(F.coalesce(x, F.lit(0.0))) < F.lit(float("inf")))))


def first_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A bounded sample that repeats: the ``rows`` rows whose key hashes lowest."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


class Memo(dict):
    """Results of a function of words that a worker remembers: at most twice ``limit``.

    When ``limit`` words are new, those before them become the old ones; what is asked for
    again moves back, so frequent words stay.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def all_of(self, keys: list, compute_all: Callable) -> list:
        """The results of many keys; those not remembered are computed in one call."""
        values = list(map(self.get, keys))
        if None in values:
            places = [i for i, v in enumerate(values) if v is None]
            new = [k for k in dict.fromkeys(keys[i] for i in places) if k not in self.old]
            made = dict(zip(new, compute_all(new), strict=True))
            for i in places:
                key = keys[i]
                values[i] = self.keep(key, made[key]) if key in made else self[key]
        return values

    def __missing__(self, key):
        value = self.old.get(key)
        return self.keep(key, self.compute(key) if value is None else value)

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
