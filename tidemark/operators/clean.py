"""Cleaning: duplicate keys, outlier flags, invalid markers, infinities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.common import count_if
from tidemark.operators.ordered import attach, column_quantiles, latest_per_key

# Strings that stand for a missing value.
INVALID_TOKENS = ["", " ", "NA", "N/A", "null", "NULL", "None", "none", "-", "?", "unknown", "Unknown", "UNKNOWN"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns by declared type; booleans (such as outlier flags) are not numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def remove_duplicates(
    df: DataFrame, id_column: str = "anonymized_id", timestamp_column: str = "timestamp", order: Sequence[str] = ()
) -> DataFrame:
    """Keep the first row of each (id, timestamp); null keys match each other.

    "First" is the smallest by ``order`` (default: all other columns), since a distributed
    table has no row order of its own. A table without either key column is returned as is.
    """
    if id_column not in df.columns or timestamp_column not in df.columns:
        return df
    rest = list(order) or [c for c in df.columns if c not in (id_column, timestamp_column)]
    if not rest:
        return df.distinct()
    return latest_per_key(df, [id_column, timestamp_column], rest, oldest=True)


def iqr_bounds(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Fitted ``(low, high)`` fences per column: exact quartiles, two numbers a column."""
    rows = column_quantiles(df, columns, [0.25, 0.75]).collect()
    return {
        r["column_name"]: (r["q"][0] - k * (r["q"][1] - r["q"][0]), r["q"][1] + k * (r["q"][1] - r["q"][0]))
        for r in rows
    }


def flag_outliers(
    df: DataFrame,
    columns: Sequence[str],
    bounds: dict[str, tuple[float, float]] | None = None,
    domain_rules: dict[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Add ``<col>_outlier``. A domain rule wins over fitted fences; rows are never removed."""
    bounds, domain_rules = bounds or {}, domain_rules or {}
    flags = {}
    for c in columns:
        low, high = domain_rules.get(c) or bounds.get(c) or (None, None)
        if c not in df.columns or (low is None and high is None):
            continue
        test = F.lit(False)
        if low is not None:
            test = test | (F.col(c) < low)
        if high is not None:
            test = test | (F.col(c) > high)
        flags[f"{c}_outlier"] = F.coalesce(test, F.lit(False))
    return df.withColumns(flags) if flags else df


def flag_outliers_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """IQR flags with the fences computed inside the plan (one row of quartiles)."""
    out = df
    fences = column_quantiles(df, columns, [0.25, 0.75])
    lows = {c: F.max(F.when(F.col("column_name") == c, F.col("q")[0])).alias(f"_q1_{c}") for c in columns}
    highs = {c: F.max(F.when(F.col("column_name") == c, F.col("q")[1])).alias(f"_q3_{c}") for c in columns}
    row = fences.agg(*lows.values(), *highs.values())
    out = attach(out, row)
    flags = {}
    for c in columns:
        q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
        spread = q3 - q1
        flags[f"{c}_outlier"] = F.coalesce(
            (F.col(c) < q1 - k * spread) | (F.col(c) > q3 + k * spread), F.lit(False)
        )
    return out.withColumns(flags).select(*df.columns, *flags)


def valid_value(field: T.StructField, invalid_values: Sequence[str] | None = None) -> Column:
    """A column with invalid markers (strings) or ±infinity and NaN (floats) as null."""
    tokens = INVALID_TOKENS if invalid_values is None else list(invalid_values)
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.when(~c.isin(tokens), c)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c


def handle_invalid_values(df: DataFrame, invalid_values: Sequence[str] | None = None) -> DataFrame:
    """Invalid markers in string columns and ±infinity in float columns become null."""
    kinds = (T.StringType, T.FloatType, T.DoubleType)
    out = {f.name: valid_value(f, invalid_values) for f in df.schema.fields if isinstance(f.dataType, kinds)}
    return df.withColumns(out) if out else df


def invalid_counts(df: DataFrame, invalid_values: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, replaced)``: what ``handle_invalid_values`` would turn to null."""
    tokens = INVALID_TOKENS if invalid_values is None else list(invalid_values)
    counts = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            counts.append((f.name, count_if(c.isin(tokens))))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            counts.append((f.name, count_if(F.isnan(c) | (F.abs(c) == float("inf")))))
    return wide_to_long(df.agg(*[e.alias(n) for n, e in counts]), [n for n, _ in counts], "column_name", "replaced")


def wide_to_long(row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])
    return row.select(F.inline(cells))
