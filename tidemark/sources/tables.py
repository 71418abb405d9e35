"""Keyed tables kept as append-only change rows; the current state is the latest row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import attach

from tidemark.operators.ordered import latest_per_key


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both tables, the later one per key winning (insert or replace)."""
    return latest_per_key(current.unionByName(changes), keys, order)


def guarded_update(
    table: DataFrame, updates: DataFrame, keys: Sequence[str], guard: Column, assignments: dict[str, Column]
) -> DataFrame:
    """Apply ``assignments`` to rows whose key is in ``updates`` and whose state passes ``guard``.

    Update values come from columns ``new_<name>`` of ``updates``; ``was_updated`` marks the rows.
    """
    marks = updates.withColumn("_hit", F.lit(True))
    joined = table.join(marks, list(keys), "left")
    hit = F.coalesce(F.col("_hit") & guard, F.lit(False))
    out = [
        F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in table.columns
    ]
    return joined.select(*out, hit.alias("was_updated"))


def match_counts(table: DataFrame, updates: DataFrame, keys: Sequence[str], guard: Column) -> DataFrame:
    """``(requested, matched)``: how many update keys find a row in the guarded state."""
    found = updates.join(table.filter(guard), list(keys), "left_semi").agg(F.count("*").alias("matched"))
    return attach(updates.agg(F.count("*").alias("requested")), found)


def lookup(
    table: DataFrame, where: dict[str, object] | None = None, newest_by: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Equality filters (pushed to the scan), newest first, optional limit."""
    out = table
    for name, value in (where or {}).items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    if newest_by:
        out = out.orderBy(*[F.desc(c) for c in newest_by])
    return out.limit(limit) if limit is not None else out


def lookup_many(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def history(
    table: DataFrame,
    equals: dict[str, object] | None = None,
    time_column: str = "timestamp",
    start=None,
    end=None,
    tiebreak: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Optional equality and time-range filters, newest first."""
    conditions = [F.col(k) == v for k, v in (equals or {}).items() if v is not None]
    if start is not None:
        conditions.append(F.col(time_column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        conditions.append(F.col(time_column) <= F.lit(end).cast("timestamp_ntz"))
    out = table.filter(reduce(lambda a, b: a & b, conditions)) if conditions else table
    out = out.orderBy(F.desc(time_column), *[F.desc(c) for c in tiebreak])
    return out.limit(limit) if limit is not None else out
