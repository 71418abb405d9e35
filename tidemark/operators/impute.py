"""Imputation with saved fit state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordered import column_quantiles, forward_fill

STRATEGIES = ("mean", "median", "mode", "forward_fill", "backward_fill", "constant")


@dataclass(frozen=True)
class FittedImputer:
    """Column → strategy, with the value to fill where the strategy is a fitted one."""

    strategies: dict[str, str]
    values: dict[str, object] = field(default_factory=dict)

    def transform(
        self, df: DataFrame, id_column: str | None = None, order: Sequence[str] = (), limit: int | None = None
    ) -> DataFrame:
        """Fill nulls. Fills in time order stay inside an id unless ``id_column`` is None."""
        fills = {
            c: F.coalesce(F.col(c), F.lit(self.values.get(c)).cast(df.schema[c].dataType))
            for c, s in self.strategies.items()
            if c in df.columns and s in ("mean", "median", "mode", "constant")
        }
        out = df
        typed = {c: "double" for c in fills if self.strategies[c] in ("mean", "median")}
        for c in typed:
            fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(self.values.get(c)).cast("double"))
        if fills:
            out = out.withColumns(fills)
        for strategy, backward in (("forward_fill", False), ("backward_fill", True)):
            cols = [c for c, s in self.strategies.items() if s == strategy and c in df.columns]
            if cols:
                if not order:
                    raise ValueError(f"{strategy} needs order columns")
                out = forward_fill(out, id_column, order[0], cols, order[1:], limit, backward)
        return out


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """Smallest of the most frequent non-null values, from a shuffled count table."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return counts.agg(F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column))).alias("mode"))


def known_strategies(strategies: dict[str, str], columns: Sequence[str]) -> dict[str, str]:
    """The strategies of the columns that are there; an unknown strategy is an error."""
    unknown = sorted(set(strategies.values()) - set(STRATEGIES))
    if unknown:
        raise ValueError(f"unknown strategies: {unknown}")
    return {c: s for c, s in strategies.items() if c in columns}


def fit_imputer(df: DataFrame, strategies: dict[str, str], constant: object = 0, known: dict[str, object] | None = None) -> FittedImputer:
    """Fit every column's fill value, also for columns that have no null yet; ``known`` values are not fitted again."""
    present = known_strategies(strategies, df.columns)
    values: dict[str, object] = {c: constant for c, s in present.items() if s == "constant"} | (known or {})
    means = [c for c, s in present.items() if s == "mean" and c not in values]
    if means:
        values.update(df.agg(*[F.avg(c).alias(c) for c in means]).first().asDict())
    medians = [c for c, s in present.items() if s == "median" and c not in values]
    if medians:
        values.update({r["column_name"]: r["q"][0] for r in column_quantiles(df, medians, [0.5]).collect()})
    for c in (c for c, s in present.items() if s == "mode" and c not in values):
        values[c] = mode_value(df, c).first()["mode"]
    return FittedImputer(present, values)
