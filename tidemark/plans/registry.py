"""Registry of checked queries: a Spark job, its output columns and (mostly) an SQL twin.

Every query declares its output as ``name:type`` words. Both sides are then cast to the same
types, and floating values are compared at a fixed number of decimals. The small offset
before rounding keeps exact ties from depending on the order in which floats were added.

Types: ``l`` bigint, ``d`` double at 6 decimals (``d2`` at 2, and so on), ``s`` string,
``b`` boolean, ``t`` timestamp without zone, ``a`` date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_SPARK_TYPES = {"l": "bigint", "s": "string", "b": "boolean", "t": "timestamp_ntz", "a": "date"}
_SQL_TYPES = {"l": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN", "t": "TIMESTAMP", "a": "DATE"}
TIE_OFFSET = 1.37e-9


class Tables:
    """The tables of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = df
        return df


_JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _split(columns: str) -> list[tuple[str, str]]:
    return [tuple(word.rsplit(":", 1)) for word in columns.split()]


def _spark_shape(df: DataFrame, columns) -> DataFrame:
    out = []
    for name, kind in columns:
        c = F.col(f"`{name}`")
        if kind[0] == "d":
            digits = int(kind[1:] or 6)
            c = F.round(c.cast("double") + TIE_OFFSET, digits) + F.lit(0.0)
        else:
            c = c.cast(_SPARK_TYPES[kind])
        out.append(c.alias(name))
    return df.select(*out)


def _sql_shape(sql: str, columns) -> str:
    out = []
    for name, kind in columns:
        if kind[0] == "d":
            digits = int(kind[1:] or 6)
            out.append(f'round(CAST("{name}" AS DOUBLE) + {TIE_OFFSET}, {digits}) + 0.0 AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"')
    return f"SELECT {', '.join(out)} FROM (\n{sql.strip()}\n) shaped"


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its declared columns and its SQL twin."""
    shape = _split(columns)

    def wrap(fn):
        if name in _JOBS:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _spark_shape(fn(Tables(spark, folder)), shape)

        _JOBS[name] = run
        if sql is not None:
            _SQL[name] = _sql_shape(sql, shape)
        return fn

    return wrap


def twin(name: str) -> str:
    """The SQL of a query registered before, for one that is put together from others."""
    return _SQL[name]


def _load() -> None:
    from tidemark.plans import (  # noqa: F401
        queries_features,
        queries_governance,
        queries_models,
        queries_prepare,
        queries_profile,
        queries_store,
        queries_streams,
    )


def jobs() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_JOBS)


def sql_twins() -> dict[str, str]:
    _load()
    return dict(_SQL)
