"""Distribution shift between two tables: KS, KL, chi-square, and the reports built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.clean import numeric_columns, string_columns
from tidemark.operators.ordered import attach, long_values, running_totals
from tidemark.operators.profile import value_counts

# Thresholds of the two monitors and the advice bands.
FEATURE_DRIFT_LIMIT = 0.3
PREDICTION_DRIFT_LIMIT = 0.2
LOW_DRIFT, HIGH_DRIFT = 0.1, 0.3
EPSILON = 1e-10


def ks_statistics(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, n_ref, n_cur, statistic)``: largest gap of the two empirical CDFs.

    All columns at once: cells become long rows, equal values are counted before the shuffle
    that orders them, and the CDFs are running sums over distinct values.
    """
    both = long_values(reference, columns).withColumn("_side", F.lit(0)).unionByName(
        long_values(current, columns).withColumn("_side", F.lit(1))
    ).filter("value IS NOT NULL AND NOT isnan(value)")
    counts = both.groupBy("column_name", "value").agg(
        F.sum((F.col("_side") == 0).cast("long")).alias("n_ref"), F.sum((F.col("_side") == 1).cast("long")).alias("n_cur")
    )
    run = running_totals(counts, ["column_name"], "value", ["n_ref", "n_cur"])
    ref, cur = F.col("total_n_ref"), F.col("total_n_cur")
    some = (ref > 0) & (cur > 0)
    gap = F.when(some, F.abs(F.col("cum_n_ref") / F.when(some, ref) - F.col("cum_n_cur") / F.when(some, cur))).otherwise(F.lit(0.0))
    return run.groupBy("column_name").agg(F.max(ref).alias("n_ref"), F.max(cur).alias("n_cur"), F.max(gap).alias("statistic"))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value (Kolmogorov series)."""
    lam = d * F.sqrt(n.cast("double") * m / (n + m))
    k = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        k, F.lit(0.0), lambda acc, i: acc + F.when(i % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * i * i * lam * lam)
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def kl_divergences(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``(column_name, kl)``: KL of current against reference over equal bins of the joint range."""
    both = long_values(reference, columns).withColumn("_side", F.lit(0)).unionByName(
        long_values(current, columns).withColumn("_side", F.lit(1))
    ).filter("value IS NOT NULL AND NOT isnan(value)")
    ranges = both.groupBy("column_name").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.sum((F.col("_side") == 0).cast("long")).alias("_ref"), F.sum((F.col("_side") == 1).cast("long")).alias("_cur"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    # the last bin is closed on the right
    index = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(F.lit(0))
    hist = (
        both.join(F.broadcast(ranges), "column_name")  # one row per column
        .groupBy("column_name", index.alias("_bin"))
        .agg(
            F.sum((F.col("_side") == 0).cast("long")).alias("a"), F.sum((F.col("_side") == 1).cast("long")).alias("b"),
            F.first("_ref").alias("_ref"), F.first("_cur").alias("_cur"), F.first(width).alias("_w"),
        )
    )
    # densities as pairs; bins with no row at all still carry the added epsilon
    flat = F.col("_w") == 0
    p = F.when(flat, F.lit(0.0)).otherwise(F.col("b") / (F.col("_cur") * F.col("_w"))) + EPSILON
    q = F.when(flat, F.lit(0.0)).otherwise(F.col("a") / (F.col("_ref") * F.col("_w"))) + EPSILON
    usable = (F.col("_ref") > 0) & (F.col("_cur") > 0) & ~flat
    sums = hist.filter(usable).groupBy("column_name").agg(
        F.sum(p).alias("_sp"), F.sum(q).alias("_sq"), F.count("*").alias("_k"), F.sum(p * F.ln(p / q)).alias("_spl")
    )
    empty = F.lit(bins) - F.col("_k")
    sp, sq = F.col("_sp") + empty * EPSILON, F.col("_sq") + empty * EPSILON
    kl = F.col("_spl") / sp - F.ln(sp / sq)
    return ranges.select("column_name").join(sums, "column_name", "left").select(
        "column_name", F.coalesce(kl, F.lit(0.0)).alias("kl")
    )


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; one call per report row."""

    def tail(x, k):
        if x is None or k is None or math.isnan(x) or k < 1:
            return None
        half, k = x / 2.0, int(k)
        total = math.erfc(math.sqrt(half)) if k % 2 else 0.0
        start = 0.5 if k % 2 else 0.0
        for i in range(k // 2):
            a = start + i
            if half > 0:
                total += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
            elif a == 0:
                total += 1.0
        return min(1.0, total)

    return pd.Series([tail(x, k) for x, k in zip(statistic, dof)])


def chi_square_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, k, statistic, score)`` of category mixes, expected counts scaled to equal totals.

    A category that is new in ``current`` has no expected count; the score is then 1.
    """
    a = value_counts(reference, columns).select("column_name", "value", F.col("n").alias("_e"))
    b = value_counts(current, columns).select("column_name", "value", F.col("n").alias("_o"))
    j = a.join(b, ["column_name", "value"], "full_outer").fillna(0, ["_e", "_o"])
    totals = j.groupBy("column_name").agg(F.sum("_e").alias("e"), F.sum("_o").alias("o"))
    # one entry per column asked for, attached as one row: a column may own most values
    both = totals.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("e", "o")))).alias("_totals"))
    own = F.element_at("_totals", F.col("column_name"))
    scaled = attach(j, both).withColumn("_t", own).filter("_t.e > 0 AND _t.o > 0").withColumn("_x", F.col("_e") * F.col("_t.o") / F.col("_t.e"))
    per = scaled.groupBy("column_name").agg(
        F.count("*").alias("k"),
        F.max((F.col("_e") == 0).cast("int")).alias("_new"),
        F.sum(F.when(F.col("_x") > 0, (F.col("_o") - F.col("_x")) ** 2 / F.when(F.col("_x") > 0, F.col("_x")))).alias("_s"),
    )
    unseen = F.col("_new") == 1
    return per.select(
        "column_name",
        "k",
        F.when(~unseen, F.col("_s")).alias("statistic"),
        F.when(unseen, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_s") / (F.col("k") * 10.0))).alias("score"),
    )


def version_drift(reference: DataFrame, current: DataFrame, p_limit: float = 0.05) -> DataFrame:
    """Per common column: test, statistic, score, p-value and whether it drifted."""
    numeric = [c for c in numeric_columns(reference) if c in numeric_columns(current)]
    text = [c for c in string_columns(reference) if c in string_columns(current)]
    parts = []
    if numeric:
        ks = ks_statistics(reference, current, numeric).filter("n_ref > 0 AND n_cur > 0")
        parts.append(
            ks.select(
                "column_name", F.lit("kolmogorov_smirnov").alias("test"), "statistic", F.col("statistic").alias("score"),
                ks_p_value(F.col("statistic"), F.col("n_ref"), F.col("n_cur")).alias("p_value"),
            )
        )
    if text:
        chi = chi_square_drift(reference, current, text)
        p = F.when(F.col("statistic").isNull(), F.lit(0.0)).otherwise(chi_square_p_value("statistic", (F.col("k") - 1).cast("double")))
        parts.append(chi.select("column_name", F.lit("chi_square").alias("test"), "statistic", "score", p.alias("p_value")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("drift_detected", F.coalesce(F.col("p_value") < p_limit, F.lit(False)))


def version_drift_summary(report: DataFrame) -> DataFrame:
    """Mean score, whether any column drifted, and the advice band, as one row."""
    row = report.agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("drift_score"),
        F.coalesce(F.max(F.col("drift_detected").cast("int")), F.lit(0)).cast("boolean").alias("drift_detected"),
        F.sum(F.col("drift_detected").cast("long")).alias("significant_features"),
        F.array_sort(F.collect_list(F.when(F.col("score") > HIGH_DRIFT, F.col("column_name")))).alias("high_drift_features"),
    )
    advice = F.when(F.col("drift_score") < LOW_DRIFT, "low").when(F.col("drift_score") < HIGH_DRIFT, "moderate").otherwise("high")
    return row.withColumn("advice", advice)


def monitor_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], method: str = "ks", limit: float = FEATURE_DRIFT_LIMIT) -> DataFrame:
    """Per-column scores with the overall (largest) score and the alert decision on each row."""
    if method == "ks":
        scores = ks_statistics(reference, current, columns).select("column_name", F.col("statistic").alias("score"))
    elif method == "kl":
        scores = kl_divergences(reference, current, columns).select("column_name", F.col("kl").alias("score"))
    else:
        raise ValueError(f"unknown method: {method}")
    overall = scores.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("drift_score"))
    return attach(scores, overall).withColumn("drift_detected", F.col("drift_score") > limit)
