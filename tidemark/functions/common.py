"""Column helpers used by every operator family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Band edges and names.
RISK_BANDS = ((25.0, "low"), (50.0, "moderate"), (75.0, "high"))
TOP_BAND = "critical"
ALERT_SCORE = 75.0
REVIEW_CONFIDENCE = 0.6
LEVEL_RANGES = {
    "low": (0.0, 25.0),
    "moderate": (26.0, 50.0),
    "high": (51.0, 75.0),
    "critical": (76.0, 100.0),
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """``a / b`` with a chosen value (default null) where ``b`` is zero or null."""
    out = F.when(b != 0, a.cast("double") / b)
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def clip(c: Column, low: float, high: float) -> Column:
    """Cap to a range; a null stays null (``greatest``/``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def cv_regularity(std: Column, mean: Column) -> Column:
    """1/(1 + std/mean); zero where the mean is not positive, null for a null std."""
    return F.when(mean > 0, 1.0 / (1.0 + std / mean)).otherwise(F.lit(0.0))


def xlogx(n: Column) -> Column:
    return F.when(n > 0, n * F.ln(n.cast("double"))).otherwise(F.lit(0.0))


def entropy_from_sums(total: Column, sum_nlogn: Column) -> Column:
    """Shannon entropy (natural log) of counts given their sum and the sum of n·ln n."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.ln(total.cast("double")) - sum_nlogn / total))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3600e6)


def whole_days_between(start: Column, end: Column) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86400e6))


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Hour, weekday with Monday as 0, and calendar date."""
    return {"hour": F.hour(ts), "weekday": F.weekday(ts), "date": F.to_date(ts)}


def bin_right_closed(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the ``(a, b]`` bin that holds ``c``; null outside all bins."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        above = F.lit(True) if low == float("-inf") else c > F.lit(low)
        out = F.when(c.isNotNull() & above & (c <= F.lit(high)), F.lit(label)).otherwise(out)
    return out


def severity(pct: Column, steps: list[tuple[float, str]], floor: str) -> Column:
    """First label whose limit ``pct`` reaches, limits in falling order."""
    out = F.lit(floor)
    for limit, label in reversed(steps):
        out = F.when(pct >= limit, F.lit(label)).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    """Band of a 0–100 score; scores outside are capped first."""
    s = clip(score, 0.0, 100.0)
    out = F.lit(TOP_BAND)
    for limit, name in reversed(RISK_BANDS):
        out = F.when(s <= limit, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def alert_flag(score: Column) -> Column:
    return F.coalesce(score > ALERT_SCORE, F.lit(False))


def review_flag(score: Column, confidence: Column | None = None) -> Column:
    """High score, or (when a confidence is given) low confidence."""
    flag = score > ALERT_SCORE
    if confidence is not None:
        flag = flag | (confidence < REVIEW_CONFIDENCE)
    return F.coalesce(flag, F.lit(False))


def review_priority(score: Column) -> Column:
    return F.when(score >= 90, F.lit(3)).when(score >= 80, F.lit(2)).otherwise(F.lit(1))


def level_range(level: Column) -> Column:
    """``struct(min_score, max_score)`` of a band name."""
    out = F.lit(None).cast("struct<min_score:double,max_score:double>")
    for name, (low, high) in LEVEL_RANGES.items():
        pair = F.struct(F.lit(low).alias("min_score"), F.lit(high).alias("max_score"))
        out = F.when(F.lower(level) == name, pair).otherwise(out)
    return out


def stable_hash(columns: list[str]) -> Column:
    """sha-256 of the columns as JSON with sorted names; nulls are kept as fields."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
