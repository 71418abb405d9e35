"""All features of an individual merged to one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import count_if, cv_regularity, entropy_from_sums, ratio, whole_days_between
from tidemark.functions.text import sentiment_features
from tidemark.operators import adherence as ad, clean, physiological as ph
from tidemark.operators.families import Modality, gather
from tidemark.operators.ordered import trailing


def merge_features(parts: list[DataFrame], id_column: str = "anonymized_id") -> DataFrame:
    """One row per id with the columns of all parts (a full-outer merge of one-row-per-id tables).

    Done as a union and one aggregate: a chain of outer joins would shuffle the growing
    result once per part. A name two parts share gets the suffix of its part number.
    """
    seen: set[str] = {id_column}
    renamed = []
    for i, p in enumerate(parts):
        clash = {c: f"{c}_{i}" for c in p.columns if c in seen and c != id_column}
        renamed.append(p.withColumnsRenamed(clash))
        seen.update(renamed[-1].columns)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    columns = [c for p in renamed for c in p.columns if c != id_column]
    return stacked.groupBy(id_column).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])


def extract_features(
    behavioral: DataFrame | None = None,
    text: DataFrame | None = None,
    sleep: DataFrame | None = None,
    hrv: DataFrame | None = None,
    activity: DataFrame | None = None,
    adherence: DataFrame | None = None,
    sessions: DataFrame | None = None,
    engagement: DataFrame | None = None,
    id_column: str = "anonymized_id",
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Features of the given modalities in a fixed column order; a faulty input is an error.

    The plain aggregates of a modality are one pass, and what must be counted first is counted
    for all modalities at once (``operators/families.py``). The features are those of the lone
    functions.
    """
    parts = []
    if behavioral is not None:
        parts.append(behavioral_modality(behavioral, id_column))
    if text is not None:
        parts.append(sentiment_features(text, id_column=id_column))
    if sleep is not None:
        parts.append(_plain(id_column, *ph.sleep_parts(sleep, id_column)))
    if hrv is not None:
        parts.append(ph.hrv_metrics(hrv, id_column=id_column, tiebreak=tiebreak))
    if activity is not None:
        parts.append(_plain(id_column, *ph.activity_parts(activity, id_column)))
    if adherence is not None:
        parts.append(ad.adherence_rate(adherence, id_column=id_column))
    if sessions is not None:
        parts.append(ad.missed_sessions(sessions, id_column=id_column, tiebreak=tiebreak))
    if engagement is not None:
        parts.append(engagement_modality(engagement, id_column))
    if not parts:
        raise ValueError("no modality given")
    return clean.handle_invalid_values(gather(parts, id_column), invalid_values=[])


def _plain(id_column: str, rows: DataFrame, aggs: list[Column], medians: dict[str, Column], defaults: Sequence[str] = ()) -> Modality:
    """A modality whose features are the aggregates and medians themselves; medians in ``defaults`` are 0 where there is none."""
    names = [c for c in rows.groupBy(id_column).agg(*aggs).columns if c != id_column]
    out = lambda c: {n: c(n) for n in names} | {n: F.coalesce(c(n), F.lit(0.0)) if n in defaults else c(n) for n in medians}
    return Modality(rows, aggs, out, medians)


def behavioral_modality(df: DataFrame, id_column: str = "anonymized_id", windows: Sequence[int] = (7, 30), social_days: int = 30) -> Modality:
    """Activity per trailing window, routine, and (with durations) social contact, as one modality."""
    social = "interaction_type" if "interaction_type" in df.columns else "activity_type"
    has_social = "duration_minutes" in df.columns
    at, kind = F.col("timestamp"), dict(df.dtypes)["activity_type"]
    rows = trailing(df, id_column, "timestamp", marks=sorted({*windows, social_days}))
    aggs = [F.count("*").alias("_rows")]
    levels = {"hour": F.hour(at), "day": F.weekday(at), "type": F.col("activity_type")}
    for d in windows:
        inside = F.col(f"in_{d}d")
        aggs += [count_if(inside).alias(f"_n{d}"), F.min(F.when(inside, at)).alias(f"_from{d}"), F.max(F.when(inside, at)).alias(f"_to{d}")]
        levels[f"type_{d}d"] = F.when(inside, F.col("activity_type"))
    medians = {}
    if has_social:
        recent = F.col(f"in_{social_days}d")
        lasted = F.when(recent, F.col("duration_minutes"))
        aggs += [count_if(recent).alias("_recent"), F.sum(lasted).cast("double").alias("_sum"), F.avg(lasted).alias("_avg"), F.max(lasted).cast("double").alias("_max")]
        levels |= {"contact": F.when(recent, F.col(social)), "date": F.when(recent, F.to_date(at))}
        medians["_median"] = lasted

    def out(c) -> dict[str, Column]:
        made, zero = {}, F.lit(0.0)
        for d in windows:
            n, seen = c(f"_n{d}"), c(f"type_{d}d")
            span = F.greatest(whole_days_between(c(f"_from{d}"), c(f"_to{d}")) + 1, F.lit(1))
            made |= {
                f"activity_count_{d}d": n,
                f"activity_frequency_{d}d": ratio(n, span, 0.0),
                f"unique_activities_{d}d": F.coalesce(seen["k"], F.lit(0)),
                f"most_common_activity_{d}d": seen["mode"].cast(kind),
                f"activity_diversity_{d}d": entropy_from_sums(seen["n"], seen["nlogn"]),
            }
        parts = {}
        some = c("hour").isNotNull() | c("day").isNotNull() | c("type").isNotNull()
        for dim, name in (("hour", "hour"), ("day", "day"), ("type", "activity_type")):
            k = c(dim)["k"]
            most = F.lit(log(24)) if dim == "hour" else F.lit(log(7)) if dim == "day" else F.when(k > 1, F.ln(k.cast("double"))).otherwise(F.lit(1.0))
            parts[f"{name}_consistency"] = F.when(some, F.coalesce(1 - entropy_from_sums(c(dim)["n"], c(dim)["nlogn"]) / most, zero))
        made |= parts | {"overall_routine_consistency": sum(list(parts.values())[1:], list(parts.values())[0]) / 3}
        if has_social:
            n, days = c("_recent"), c("date")
            contact = {
                "interaction_count": n,
                "interaction_frequency_per_day": n / F.lit(float(social_days)),
                "unique_interaction_types": F.coalesce(c("contact")["k"], F.lit(0)),
                "total_interaction_duration": F.coalesce(c("_sum"), zero),
                "mean_interaction_duration": F.coalesce(c("_avg"), zero),
                "median_interaction_duration": F.coalesce(c("_median"), zero),
                "max_interaction_duration": F.coalesce(c("_max"), zero),
                "interaction_regularity": F.coalesce(_regularity(days), zero),
            }
            made |= {name: F.when(n > 0, e) for name, e in contact.items()}
        return made

    return Modality(rows, aggs, out, medians, levels)


def _regularity(days: Column) -> Column:
    """1/(1 + CV) of the rows per day; zero with one active day or fewer."""
    return F.when(days["k"] > 1, cv_regularity(days["sd"], days["mean"])).when(days["k"].isNotNull(), F.lit(0.0))


def engagement_modality(df: DataFrame, id_column: str = "anonymized_id", window_days: int = 30) -> Modality:
    rows = trailing(df, id_column, "timestamp", window_days)
    aggs = ad.engagement_aggregates(df.columns, window_days=window_days)
    out = lambda c: ad.engagement_columns(c, df.columns, c("date")["k"], _regularity(c("date")), window_days=window_days)
    return Modality(rows, aggs, out, levels={"date": F.to_date("timestamp")})
