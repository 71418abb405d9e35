"""Sleep, heart-rate variability and activity-intensity features per individual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import clip, count_if, cv_regularity, hours_between
from tidemark.operators.ordered import group_agg, successive_differences

# Assumed maximum heart rate and the lower zone edges as shares of it.
MAX_HEART_RATE = 190
ZONE_EDGES = (0.5, 0.6, 0.7, 0.8, 0.9)
BEST_SLEEP_HOURS = 8.0


def sleep_features(
    df: DataFrame,
    id_column: str = "anonymized_id",
    sleep_start_column: str = "sleep_start",
    sleep_end_column: str = "sleep_end",
    interruptions_column: str | None = "interruptions",
    efficiency_column: str = "sleep_efficiency",
) -> DataFrame:
    """Durations of valid nights (0 < hours ≤ 24), interruptions and efficiency.

    Without an efficiency column it is estimated from **all** durations, also invalid ones,
    as closeness to eight hours.
    """
    data, aggs, medians, defaults = sleep_parts(df, id_column, sleep_start_column, sleep_end_column, interruptions_column, efficiency_column)
    out = group_agg(data, [id_column], aggs, medians)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in defaults})


def sleep_parts(
    df: DataFrame,
    id_column: str = "anonymized_id",
    sleep_start_column: str = "sleep_start",
    sleep_end_column: str = "sleep_end",
    interruptions_column: str | None = "interruptions",
    efficiency_column: str = "sleep_efficiency",
) -> tuple[DataFrame, list[Column], dict[str, Column], list[str]]:
    """Rows, aggregates, medians, and the medians that are 0 where there is none, of the sleep features."""
    data = df.filter(F.col(id_column).isNotNull()).withColumn(
        "_h", hours_between(F.col(sleep_start_column), F.col(sleep_end_column))
    )
    valid = F.when((F.col("_h") > 0) & (F.col("_h") <= 24), F.col("_h"))
    zero = F.lit(0.0)
    aggs = [
        F.coalesce(F.avg(valid), zero).alias("mean_sleep_duration"),
        F.when(F.count(valid) > 0, F.stddev_samp(valid)).otherwise(zero).alias("std_sleep_duration"),
        F.coalesce(F.min(valid), zero).alias("min_sleep_duration"),
        F.coalesce(F.max(valid), zero).alias("max_sleep_duration"),
        F.when(F.count(valid) > 0, cv_regularity(F.stddev_samp(valid), F.avg(valid))).otherwise(zero).alias("sleep_regularity"),
    ]
    medians = {"median_sleep_duration": valid}
    defaults = ["median_sleep_duration"]
    if interruptions_column and interruptions_column in df.columns:
        i = F.col(interruptions_column)
        aggs += [
            F.coalesce(F.avg(i), zero).alias("mean_interruptions"),
            F.coalesce(F.max(i).cast("double"), zero).alias("max_interruptions"),
        ]
        medians["median_interruptions"] = i
        defaults.append("median_interruptions")
    if efficiency_column in df.columns:
        efficiency: Column = F.col(efficiency_column)
        aggs.append(F.coalesce(F.avg(efficiency), zero).alias("mean_sleep_efficiency"))
        defaults.append("median_sleep_efficiency")
    else:
        efficiency = clip(1 - F.abs(F.col("_h") - BEST_SLEEP_HOURS) / BEST_SLEEP_HOURS, 0.0, 1.0)
        aggs.append(F.avg(efficiency).alias("mean_sleep_efficiency"))
    medians["median_sleep_efficiency"] = efficiency
    return data, aggs, medians, defaults


def hrv_metrics(
    df: DataFrame,
    id_column: str = "anonymized_id",
    rr_intervals_column: str | None = "rr_intervals",
    heart_rate_column: str | None = "heart_rate",
    timestamp_column: str = "timestamp",
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Variability from RR intervals when present, else plain heart-rate statistics."""
    zero = F.lit(0.0)
    people = df.filter(F.col(id_column).isNotNull())
    if rr_intervals_column and rr_intervals_column in df.columns:
        rr = F.col(rr_intervals_column).cast("double")
        base = people.groupBy(id_column).agg(
            F.count(rr).alias("_n"),
            F.stddev_samp(rr).alias("_sdnn"),
            F.avg(rr).alias("_mean"),
            F.stddev_pop(rr).alias("_std"),
        )
        steps = successive_differences(people, id_column, timestamp_column, rr_intervals_column, tiebreak)
        j = base.join(steps, id_column, "left")
        enough = F.col("_n") > 1
        rmssd = F.sqrt(F.col("sum_sq_diff") / F.col("n_diff"))

        def out(c, name):
            return F.coalesce(F.when(enough, c), zero).alias(name)

        return j.select(
            id_column,
            out(rmssd, "rmssd"),
            out(F.col("_sdnn"), "sdnn"),
            out(F.col("n_over_50") / F.col("n_diff") * 100, "pnn50"),
            out(F.col("_mean"), "mean_rr"),
            out(F.col("_std"), "std_rr"),
            out(F.when(F.col("_sdnn") > 0, rmssd / F.col("_sdnn")), "lf_hf_ratio_proxy"),
        )
    hr = F.col(heart_rate_column).cast("double")
    base = people.groupBy(id_column).agg(
        F.count(hr).alias("_n"),
        F.coalesce(F.avg(hr), zero).alias("mean_heart_rate"),
        F.when(F.count(hr) > 0, F.stddev_samp(hr)).otherwise(zero).alias("std_heart_rate"),
        F.coalesce(F.min(hr), zero).alias("min_heart_rate"),
        F.coalesce(F.max(hr), zero).alias("max_heart_rate"),
        F.coalesce(F.max(hr) - F.min(hr), zero).alias("heart_rate_range"),
    )
    steps = successive_differences(people, id_column, timestamp_column, heart_rate_column, tiebreak)
    mean = F.col("sum_diff") / F.col("n_diff")
    variance = F.greatest(F.lit(0.0), F.col("sum_sq_diff") / F.col("n_diff") - mean * mean)
    spread = F.when(F.col("_n") > 1, F.sqrt(variance)).when(F.col("_n") == 0, zero)
    return base.join(steps, id_column, "left").select(
        id_column,
        "mean_heart_rate",
        "std_heart_rate",
        "min_heart_rate",
        "max_heart_rate",
        "heart_rate_range",
        spread.alias("hr_variability"),
    )


def activity_intensity(
    df: DataFrame,
    id_column: str = "anonymized_id",
    heart_rate_column: str = "heart_rate",
    steps_column: str = "steps",
    calories_column: str = "calories",
) -> DataFrame:
    """Share of readings per heart-rate zone, intensity, step and calorie statistics."""
    data, aggs, medians = activity_parts(df, id_column, heart_rate_column, steps_column, calories_column)
    return group_agg(data, [id_column], aggs, medians)


def activity_parts(
    df: DataFrame,
    id_column: str = "anonymized_id",
    heart_rate_column: str = "heart_rate",
    steps_column: str = "steps",
    calories_column: str = "calories",
) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """Rows, aggregates and medians of the activity intensity."""
    aggs, medians = [], {}
    if heart_rate_column in df.columns:
        hr = F.col(heart_rate_column)
        edges = [e * MAX_HEART_RATE for e in ZONE_EDGES] + [None]
        n = F.count(hr)

        def zone(i):
            low, high = edges[i], edges[i + 1]
            return count_if((hr >= low) & (hr < high) if high is not None else hr >= low)

        zones = [zone(i) for i in range(5)]
        for i, z in enumerate(zones, 1):
            aggs.append(F.when(n > 0, z / n * 100).alias(f"zone{i}_pct"))
        weighted = sum((z * i for i, z in enumerate(zones, 1)), F.lit(0))
        aggs.append(F.when(n > 0, weighted / n).alias("activity_intensity_score"))
        aggs.append(F.when(n > 0, (zones[2] + zones[3] + zones[4]) / n * 100).alias("active_time_pct"))
    if steps_column in df.columns:
        s = F.col(steps_column)
        aggs += [
            F.sum(s).cast("double").alias("total_steps"),
            F.avg(s).alias("mean_daily_steps"),
            F.max(s).cast("double").alias("max_daily_steps"),
            F.when(F.count(s) > 0, cv_regularity(F.stddev_samp(s), F.avg(s))).alias("step_consistency"),
        ]
        medians["median_daily_steps"] = s
    if calories_column in df.columns:
        c = F.col(calories_column)
        aggs += [F.sum(c).cast("double").alias("total_calories"), F.avg(c).alias("mean_daily_calories")]
        medians["median_daily_calories"] = c
    return df.filter(F.col(id_column).isNotNull()), aggs, medians
