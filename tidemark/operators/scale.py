"""Standard, min-max and per-group scaling with saved fit state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import keyed_join
from tidemark.session import written


def _safe_std(std):
    return F.when(std > 0, std).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class FittedScaler:
    """``column → (shift, divide, low, span)``; output is ``low + span·(x − shift)/divide``."""

    params: dict[str, tuple[float, float, float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (shift, divide, low, span) in self.params.items():
            if c in df.columns:
                scaled = (F.col(c).cast("double") - shift) / divide
                out[c] = scaled if (low, span) == (0.0, 1.0) else scaled * span + low
        return df.withColumns(out) if out else df


def scale_statistics(standard: Sequence[str], min_max: Sequence[str]) -> list[Column]:
    """The aggregates that both scalers are fitted from; they can be observed while a table is written."""
    moments = [[F.avg(c).alias(f"avg {c}"), F.stddev_samp(c).alias(f"std {c}")] for c in standard]
    ends = [[F.min(c).cast("double").alias(f"min {c}"), F.max(c).cast("double").alias(f"max {c}")] for c in min_max]
    return sum(moments + ends, [])


def standard_scaler(row: dict, columns: Sequence[str]) -> FittedScaler:
    """Mean and sample deviation; a zero or undefined deviation counts as 1."""
    return FittedScaler({c: (row[f"avg {c}"] or 0.0, row[f"std {c}"] or 1.0, 0.0, 1.0) for c in columns})


def min_max_scaler(row: dict, columns: Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0)) -> FittedScaler:
    """Range scaling; a constant column is treated as one unit wide."""
    low, high = map(float, feature_range)
    ends = {c: (row[f"min {c}"] or 0.0, row[f"max {c}"] or 0.0) for c in columns}
    return FittedScaler({c: (a, (b - a) or 1.0, low, high - low) for c, (a, b) in ends.items()})


def fit_standard(df: DataFrame, columns: Sequence[str]) -> FittedScaler:
    return standard_scaler(df.agg(*scale_statistics(columns, [])).first().asDict(), columns)


def fit_min_max(df: DataFrame, columns: Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0)) -> FittedScaler:
    return min_max_scaler(df.agg(*scale_statistics([], columns)).first().asDict(), columns, feature_range)


@dataclass(frozen=True)
class FittedGroupScaler:
    """Per-group mean and deviation as a table, one row per group."""

    columns: list[str]
    group_by: str
    params: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """z-score within the group; a group not seen at fit gives null."""
        joined = keyed_join(df, self.params, [self.group_by], "left")
        scaled = {c: (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}") for c in self.columns}
        return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def fit_group_standard(df: DataFrame, columns: Sequence[str], group_by: str = "anonymized_id"):
    """Group z-score parameters (global ones when the group column is absent).

    Aggregate and join, not a window over the group: partial sums keep a hot group split, and
    so does the join that applies the parameters. The fitted table is written:
    applying it neither reads the training rows again nor depends on how they were summed.
    """
    if group_by not in df.columns:
        return fit_standard(df, columns)
    params = written(df.filter(F.col(group_by).isNotNull()).groupBy(group_by).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[_safe_std(F.stddev_samp(c)).alias(f"_std_{c}") for c in columns],
    ), "group-scale")
    return FittedGroupScaler(list(columns), group_by, params)
