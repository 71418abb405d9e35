"""Target, one-hot and ordinal encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordered import attach, keyed_join
from tidemark.session import checkpointed


@dataclass(frozen=True)
class TargetEncoding:
    """Smoothed category means as a table, plus the global mean for unseen categories."""

    column: str
    mapping: DataFrame
    global_mean: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        joined = keyed_join(df, self.mapping, [self.column], "left")
        joined = attach(joined, self.global_mean)
        name = f"{self.column}_encoded"
        return joined.select(*df.columns, F.coalesce("_encoded", "_global").alias(name))


def fit_target_encoding(df: DataFrame, column: str, target: str, smoothing: float = 1.0) -> TargetEncoding:
    """(n·mean + s·global) / (n + s) per category; null categories get the global mean."""
    overall = checkpointed(df.agg(F.avg(target).alias("_global")))
    stats = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(target).alias("_n"), F.avg(target).alias("_mean")
    )
    blended = (F.col("_n") * F.col("_mean") + smoothing * F.col("_global")) / (F.col("_n") + smoothing)
    mapping = checkpointed(attach(stats, overall).select(column, blended.alias("_encoded")))
    return TargetEncoding(column, mapping, overall)


@dataclass(frozen=True)
class OneHotEncoding:
    levels: dict[str, list]

    def transform(self, df: DataFrame) -> DataFrame:
        """Fixed 0/1 columns ``<col>_<level>``; unseen levels and nulls give all zeros."""
        flags = [
            F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
            for c, levels in self.levels.items()
            if c in df.columns
            for v in levels
        ]
        return df.select(*[c for c in df.columns if c not in self.levels], *flags)


def fit_one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True, max_levels: int = 1000) -> OneHotEncoding:
    """Sorted levels per column; more than ``max_levels`` is refused (one column per level)."""
    levels = {}
    for c in columns:
        rows = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(max_levels + 1).collect()
        if len(rows) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        found = sorted(r[0] for r in rows)
        levels[c] = found[1:] if drop_first else found
    return OneHotEncoding(levels)


def ordinal_encode(df: DataFrame, orderings: dict[str, Sequence]) -> DataFrame:
    """``<col>_encoded``: 0-based position in the given order, −1 when not listed."""
    out = {}
    for c, order in orderings.items():
        position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(c)).cast("int") - 1
        out[f"{c}_encoded"] = F.coalesce(position, F.lit(-1))
    return df.withColumns(out)
