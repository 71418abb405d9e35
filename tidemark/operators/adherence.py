"""Treatment adherence, missed sessions and engagement per individual."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import count_if, ratio
from tidemark.operators.behavioral import daily_regularity
from tidemark.operators.ordered import longest_run, trailing

# What counts as full marks for each engagement component, and band edges.
FULL_INTERACTIONS_PER_DAY = 5.0
FULL_SESSION_MINUTES = 30.0
FULL_COMPLETION_RATE = 0.8
HIGH_MISS_RATE = 30.0
STREAK_FLAG = 3

MAX_TYPES = 1000


def adherence_rate(
    df: DataFrame,
    id_column: str = "anonymized_id",
    scheduled_column: str = "scheduled_sessions",
    completed_column: str = "completed_sessions",
    intervention_type_column: str | None = "intervention_type",
    timestamp_column: str = "timestamp",
    intervention_types: Sequence[str] | None = None,
    recent_days: int = 30,
) -> DataFrame:
    """Overall, per-type and recent adherence. No scheduled session counts as rate 0, "low".

    Pass ``intervention_types`` to fix the pivot columns and save the pass that lists them.
    """
    s, c = F.col(scheduled_column), F.col(completed_column)
    has_time = timestamp_column in df.columns
    people = df.filter(F.col(id_column).isNotNull())
    if has_time:
        people = trailing(people, id_column, timestamp_column, marks=[recent_days])
    scheduled, completed = F.coalesce(F.sum(s), F.lit(0)), F.coalesce(F.sum(c), F.lit(0))
    some = scheduled > 0

    def kept(e):
        return F.when(some, e).otherwise(F.lit(0)).cast("double")

    rate = F.when(some, completed / F.when(some, scheduled) * 100).otherwise(F.lit(0.0))
    aggs = [
        rate.alias("overall_adherence_rate"),
        kept(scheduled).alias("total_scheduled"),
        kept(completed).alias("total_completed"),
        kept(scheduled - completed).alias("total_missed"),
        F.when(rate >= 80, "high").when(rate >= 50, "moderate").otherwise("low").alias("adherence_category"),
    ]
    if intervention_type_column and intervention_type_column in df.columns:
        kinds = intervention_types
        if kinds is None:
            found = people.select(intervention_type_column).filter(F.col(intervention_type_column).isNotNull())
            kinds = sorted(r[0] for r in found.distinct().limit(MAX_TYPES + 1).collect())
            if len(kinds) > MAX_TYPES:
                raise ValueError(f"more than {MAX_TYPES} intervention types: one column each is too many")
        for k in kinds:
            here = F.col(intervention_type_column) == k
            total = F.sum(F.when(here, s))
            aggs.append(F.when(total > 0, F.coalesce(F.sum(F.when(here, c)), F.lit(0)) / F.when(total > 0, total) * 100).alias(f"adherence_{k}"))
    if has_time:
        inside = F.col(f"in_{recent_days}d")
        total = F.sum(F.when(inside, s))
        done = F.coalesce(F.sum(F.when(inside, c)), F.lit(0))
        aggs.append(F.when(total > 0, done / F.when(total > 0, total) * 100).alias(f"recent_adherence_rate_{recent_days}d"))
    return people.groupBy(id_column).agg(*aggs)


def missed_sessions(
    df: DataFrame,
    id_column: str = "anonymized_id",
    session_date_column: str = "session_date",
    status_column: str = "status",
    missed_status: str = "missed",
    window_days: int = 30,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Missed counts and rate, longest streak and last-week misses in the trailing window."""
    marked = trailing(df, id_column, session_date_column, marks=[window_days, 7])
    recent = marked.filter(F.col(f"in_{window_days}d"))
    missed = F.col(status_column) == missed_status
    rate = count_if(missed) / F.count("*") * 100
    flat = recent.groupBy(id_column).agg(
        count_if(missed).alias("missed_sessions_count"),
        F.count("*").alias("total_sessions"),
        rate.alias("missed_sessions_rate"),
        (rate > HIGH_MISS_RATE).alias("high_miss_rate_flag"),
        count_if(missed & F.col("in_7d")).alias("recent_missed_7d"),
        (count_if(missed & F.col("in_7d")) > 0).alias("recent_miss_flag"),
    )
    streak = longest_run(recent, id_column, session_date_column, missed, "max_consecutive_missed", tiebreak)
    return flat.join(streak, id_column).select(
        id_column,
        "missed_sessions_count",
        "total_sessions",
        "missed_sessions_rate",
        "high_miss_rate_flag",
        "max_consecutive_missed",
        (F.col("max_consecutive_missed") >= STREAK_FLAG).alias("consecutive_miss_flag"),
        "recent_missed_7d",
        "recent_miss_flag",
    )


def engagement_score(
    df: DataFrame,
    id_column: str = "anonymized_id",
    interaction_column: str = "interaction_count",
    duration_column: str = "session_duration_minutes",
    completion_column: str = "completed_activities",
    timestamp_column: str = "timestamp",
    window_days: int = 30,
) -> DataFrame:
    """Mean of the components that are present: contact, duration, completion, consistency."""
    recent = trailing(df, id_column, timestamp_column, window_days)
    aggs = engagement_aggregates(df.columns, interaction_column, duration_column, completion_column, window_days)
    flat = recent.groupBy(id_column).agg(*aggs)
    daily = daily_regularity(recent, id_column, timestamp_column)
    out = engagement_columns(F.col, df.columns, F.col("active_days"), F.col("regularity"), interaction_column, duration_column, completion_column, window_days)
    return flat.join(daily, id_column, "left").select(id_column, *[e.alias(c) for c, e in out.items()])


def engagement_aggregates(
    columns: Sequence[str], interaction_column: str = "interaction_count", duration_column: str = "session_duration_minutes",
    completion_column: str = "completed_activities", window_days: int = 30,
) -> list[Column]:
    """The plain aggregates of the engagement score over recent rows, of the columns that are there."""
    aggs = [F.count("*").alias("_rows")]
    if interaction_column in columns:
        aggs.append((F.coalesce(F.sum(interaction_column), F.lit(0)) / F.lit(float(window_days))).alias("interaction_frequency"))
    if duration_column in columns:
        aggs += [
            F.avg(duration_column).alias("mean_session_duration"),
            F.sum(duration_column).cast("double").alias("total_session_duration"),
        ]
    if completion_column in columns:
        aggs += [
            F.sum(completion_column).cast("double").alias("total_completions"),
            ratio(F.sum(completion_column), F.count("*")).alias("completion_rate"),
        ]
    return aggs


def engagement_columns(
    c: Callable[[str], Column], columns: Sequence[str], active_days: Column, regularity: Column, interaction_column: str = "interaction_count",
    duration_column: str = "session_duration_minutes", completion_column: str = "completed_activities", window_days: int = 30,
) -> dict[str, Column]:
    """The engagement features from their aggregates, which ``c`` gives by name, and the active days."""
    out, parts = {}, []
    if interaction_column in columns:
        score = F.least(c("interaction_frequency") / FULL_INTERACTIONS_PER_DAY, F.lit(1.0))
        parts.append(score)
        out |= {"interaction_frequency": c("interaction_frequency"), "interaction_score": score}
    if duration_column in columns:
        mean = c("mean_session_duration")
        score = F.when(mean.isNotNull(), F.least(mean / FULL_SESSION_MINUTES, F.lit(1.0)))
        parts.append(score)
        out |= {"mean_session_duration": mean, "total_session_duration": c("total_session_duration"), "duration_score": score}
    if completion_column in columns:
        rate = c("completion_rate")
        score = F.when(rate.isNotNull(), F.least(rate / FULL_COMPLETION_RATE, F.lit(1.0)))
        parts.append(score)
        out |= {"total_completions": c("total_completions"), "completion_rate": rate, "completion_score": score}
    several = active_days > 1
    consistency = F.when(several, regularity)
    parts.append(consistency)
    present = F.array_compact(F.array(*parts))
    overall = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)).otherwise(F.lit(0.0))
    level = (
        F.when(F.size(present) == 0, "none").when(overall >= 0.7, "high").when(overall >= 0.4, "moderate").otherwise("low")
    )
    return out | {
        "engagement_consistency": consistency,
        "active_days": F.when(several, active_days),
        "active_days_pct": F.when(several, active_days / F.lit(float(window_days)) * 100),
        "overall_engagement_score": overall,
        "engagement_level": level,
    }
