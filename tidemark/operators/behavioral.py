"""Behavioural features per individual: activity, routine, social contact."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.common import count_if, cv_regularity, entropy_from_sums, ratio, whole_days_between, xlogx
from tidemark.operators.ordered import group_agg, trailing


def activity_features(
    df: DataFrame,
    activity_column: str = "activity_type",
    timestamp_column: str = "timestamp",
    id_column: str = "anonymized_id",
    windows: Sequence[int] = (7, 30),
) -> DataFrame:
    """Count, daily frequency, variety, commonest type and entropy per trailing window.

    Two aggregate levels, (id, type) then id, so a hot id or a hot type is summed in parts.
    """
    marked = trailing(df, id_column, timestamp_column, marks=windows)
    level1 = []
    for d in windows:
        inside = F.col(f"in_{d}d")
        level1 += [
            count_if(inside).alias(f"_n{d}"),
            F.min(F.when(inside, F.col(timestamp_column))).alias(f"_from{d}"),
            F.max(F.when(inside, F.col(timestamp_column))).alias(f"_to{d}"),
        ]
    by_type = marked.groupBy(id_column, activity_column).agg(*level1)
    known = F.col(activity_column).isNotNull()
    level2 = []
    for d in windows:
        n = F.col(f"_n{d}")
        typed = F.when(known, n).otherwise(F.lit(0))
        level2 += [
            F.sum(n).alias(f"activity_count_{d}d"),
            F.min(f"_from{d}").alias(f"_f{d}"),
            F.max(f"_to{d}").alias(f"_t{d}"),
            count_if(known & (n > 0)).alias(f"unique_activities_{d}d"),
            F.min_by(activity_column, F.when(known & (n > 0), F.struct(-n, F.col(activity_column)))).alias(
                f"most_common_activity_{d}d"
            ),
            F.sum(typed).alias(f"_typed{d}"),
            F.sum(xlogx(typed)).alias(f"_nlogn{d}"),
        ]
    wide = by_type.groupBy(id_column).agg(*level2)
    out = [F.col(id_column)]
    for d in windows:
        span = F.greatest(whole_days_between(F.col(f"_f{d}"), F.col(f"_t{d}")) + 1, F.lit(1))
        out += [
            F.col(f"activity_count_{d}d"),
            ratio(F.col(f"activity_count_{d}d"), span, 0.0).alias(f"activity_frequency_{d}d"),
            F.col(f"unique_activities_{d}d"),
            F.col(f"most_common_activity_{d}d"),
            entropy_from_sums(F.col(f"_typed{d}"), F.col(f"_nlogn{d}")).alias(f"activity_diversity_{d}d"),
        ]
    return wide.select(*out)


def category_entropy(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Shannon entropy (natural log) of a category per key; nulls are left out."""
    counts = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.count("*").alias("n_categories"),
        entropy_from_sums(F.sum("_n"), F.sum(xlogx(F.col("_n")))).alias("entropy"),
    )


def routine_consistency(
    df: DataFrame,
    timestamp_column: str = "timestamp",
    activity_column: str = "activity_type",
    id_column: str = "anonymized_id",
) -> DataFrame:
    """1 − entropy / maximum entropy over hour, weekday and type, and the mean of the three."""
    cells = df.filter(F.col(id_column).isNotNull()).groupBy(
        F.col(id_column),
        F.hour(timestamp_column).alias("_h"),
        F.weekday(timestamp_column).alias("_w"),
        F.col(activity_column).alias("_a"),
    ).agg(F.count("*").alias("_n"))
    long = cells.select(
        id_column,
        "_n",
        F.explode(
            F.array(
                F.struct(F.lit("hour").alias("dim"), F.col("_h").cast("string").alias("level")),
                F.struct(F.lit("day").alias("dim"), F.col("_w").cast("string").alias("level")),
                F.struct(F.lit("type").alias("dim"), F.col("_a").cast("string").alias("level")),
            )
        ).alias("x"),
    ).filter("x.level IS NOT NULL")
    per_level = long.groupBy(id_column, F.col("x.dim").alias("dim"), F.col("x.level").alias("level")).agg(F.sum("_n").alias("_n"))
    per_dim = per_level.groupBy(id_column, "dim").agg(
        entropy_from_sums(F.sum("_n"), F.sum(xlogx(F.col("_n")))).alias("h"), F.count("*").alias("k")
    )
    maximum = (
        F.when(F.col("dim") == "hour", F.lit(log(24)))
        .when(F.col("dim") == "day", F.lit(log(7)))
        .when(F.col("k") > 1, F.ln(F.col("k").cast("double")))
        .otherwise(F.lit(1.0))
    )
    scored = per_dim.withColumn("c", 1 - F.col("h") / maximum)

    def part(dim):
        return F.coalesce(F.max(F.when(F.col("dim") == dim, F.col("c"))), F.lit(0.0))

    wide = scored.groupBy(id_column).agg(
        part("hour").alias("hour_consistency"),
        part("day").alias("day_consistency"),
        part("type").alias("activity_type_consistency"),
    )
    mean = (F.col("hour_consistency") + F.col("day_consistency") + F.col("activity_type_consistency")) / 3
    return wide.withColumn("overall_routine_consistency", mean)


def daily_regularity(df: DataFrame, id_column: str, timestamp_column: str) -> DataFrame:
    """Active days and 1/(1 + CV) of their row counts; zero with one active day or fewer."""
    daily = df.groupBy(id_column, F.to_date(timestamp_column).alias("_date")).agg(F.count("*").alias("_n"))
    return daily.filter("_date IS NOT NULL").groupBy(id_column).agg(
        F.count("*").alias("active_days"),
        F.when(F.count("*") > 1, cv_regularity(F.stddev_samp("_n"), F.avg("_n"))).otherwise(F.lit(0.0)).alias("regularity"),
    )


def social_metrics(
    df: DataFrame,
    interaction_column: str = "interaction_type",
    duration_column: str = "duration_minutes",
    timestamp_column: str = "timestamp",
    id_column: str = "anonymized_id",
    window_days: int = 30,
) -> DataFrame:
    """Contact counts, durations and day-to-day regularity in the trailing window."""
    recent = trailing(df, id_column, timestamp_column, window_days)
    zero = F.lit(0.0)
    flat = group_agg(
        recent,
        [id_column],
        [
            F.count("*").alias("interaction_count"),
            (F.count("*") / F.lit(float(window_days))).alias("interaction_frequency_per_day"),
            F.count_distinct(interaction_column).alias("unique_interaction_types"),
            F.coalesce(F.sum(duration_column).cast("double"), zero).alias("total_interaction_duration"),
            F.coalesce(F.avg(duration_column), zero).alias("mean_interaction_duration"),
            F.coalesce(F.max(duration_column).cast("double"), zero).alias("max_interaction_duration"),
        ],
        {"median_interaction_duration": F.col(duration_column)},
    )
    regular = daily_regularity(recent, id_column, timestamp_column)
    return flat.join(regular, id_column, "left").select(
        id_column,
        "interaction_count",
        "interaction_frequency_per_day",
        "unique_interaction_types",
        "total_interaction_duration",
        "mean_interaction_duration",
        F.coalesce("median_interaction_duration", zero).alias("median_interaction_duration"),
        "max_interaction_duration",
        F.coalesce("regularity", zero).alias("interaction_regularity"),
    )
