"""Model performance over time: summaries, degradation alerts, retraining advice, model cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import group_agg, latest_per_key, top_k_per_key

# Limits of the alert and advice rules.
DEGRADATION_LIMIT = 0.10
HIGH_DEGRADATION_PCT = 20.0
STABLE_PCT = 5.0
RETRAIN_DROP_PCT = -10.0
MANY_ALERTS = 10


def window_summary(metrics: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Per model and metric: mean, population deviation, range and latest value in the window."""
    recent = metrics.filter((F.col("ts") >= now - F.expr(f"INTERVAL '{int(days)}' DAY")) & (F.col("ts") <= now))
    return recent.groupBy("model_id", "metric").agg(
        F.count("*").alias("data_points"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max_by("value", F.struct("ts", "value")).alias("latest"),
    )


def against_baseline(summary: DataFrame, baselines: DataFrame) -> DataFrame:
    """Latest value against the baseline of the same model and metric, with a status.

    Metrics without a baseline drop out. A baseline that is not positive gives no change.
    """
    b = baselines.select("model_id", "metric", F.col("value").alias("baseline"))
    j = summary.join(b, ["model_id", "metric"])
    change = F.when(F.col("baseline") > 0, (F.col("latest") - F.col("baseline")) / F.when(F.col("baseline") > 0, F.col("baseline")) * 100)
    out = j.withColumn("change_pct", F.coalesce(change, F.lit(0.0)))
    status = F.when(F.abs("change_pct") < STABLE_PCT, "stable").when(F.col("change_pct") > 0, "improved").otherwise("degraded")
    return out.withColumn("status", status)


def degradation_alerts(current: DataFrame, baselines: DataFrame, limit: float = DEGRADATION_LIMIT) -> DataFrame:
    """An alert per reading that fell more than ``limit`` below its baseline."""
    b = baselines.select("model_id", "metric", F.col("value").alias("baseline_value"))
    j = current.join(b, ["model_id", "metric"]).filter(F.col("baseline_value") > 0)
    change = (F.col("value") - F.col("baseline_value")) / F.col("baseline_value")
    hit = j.withColumn("_change", change).filter(F.col("_change") < -limit)
    pct = F.abs("_change") * 100
    return hit.select(
        "model_id",
        "metric",
        "ts",
        F.lit("performance_degradation").alias("alert_type"),
        F.when(pct > HIGH_DEGRADATION_PCT, "high").otherwise("medium").alias("severity"),
        "baseline_value",
        F.col("value").alias("current_value"),
        pct.alias("degradation_pct"),
        # fixed value: the message
        F.format_string(
            "Performance degradation detected for model %s: %s decreased by %.1f%% (baseline: %.4f, current: %.4f)",
            F.col("model_id").cast("string"), F.col("metric"), pct, F.col("baseline_value").cast("double"), F.col("value").cast("double"),
        ).alias("message"),
    )


def drift_alerts(report: DataFrame, kind: str, model_id: str, now: Column, limit: float) -> DataFrame:
    """One alert row for a drift report that crossed its limit (none otherwise)."""
    hit = report.filter("drift_detected").agg(F.max("drift_score").alias("drift_score")).filter("drift_score IS NOT NULL")
    return hit.select(
        F.lit(model_id).alias("model_id"), now.alias("ts"), F.lit(f"{kind}_drift").alias("alert_type"),
        F.lit("medium").alias("severity"), "drift_score", F.lit(limit).alias("threshold"),
    )


def prediction_stats(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    aggs = [
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"),
    ]
    return group_agg(df, keys, aggs, {"median": F.col(score)})


def alerts_per_day(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("alerts"))


def retraining_advice(comparison: DataFrame, alerts: DataFrame, models: DataFrame, now: Column) -> DataFrame:
    """Advice rows per model: drops over 10 %, drift alerts, many alerts, else periodic upkeep."""
    recent = alerts.filter(F.col("ts") >= now - F.expr("INTERVAL '7' DAY"))
    counts = recent.groupBy("model_id").agg(
        F.count("*").alias("_all"), F.count(F.when(F.contains("alert_type", F.lit("drift")), 1)).alias("_drift")
    )

    def rows(df, kind, priority, reason):
        return df.select("model_id", F.lit(kind).alias("type"), F.lit(priority).alias("priority"), reason.alias("reason"))

    dropped = comparison.filter(F.col("change_pct") < RETRAIN_DROP_PCT)
    # fixed values: kinds, priorities and reasons
    parts = [
        rows(dropped, "performance_degradation", "high", F.format_string("%s degraded by %.1f%%", F.col("metric"), F.abs("change_pct"))),
        rows(counts.filter("_drift > 0"), "data_drift", "medium", F.format_string("%d drift alerts in past week", F.col("_drift"))),
        rows(counts.filter(F.col("_all") > MANY_ALERTS), "high_alert_frequency", "medium", F.format_string("%d alerts in past week", F.col("_all"))),
    ]
    found = reduce(lambda a, b: a.unionByName(b), parts)
    quiet = models.select("model_id").distinct().join(found.select("model_id"), "model_id", "left_anti")
    return found.unionByName(rows(quiet, "periodic_maintenance", "low", F.lit("No critical issues detected")))


def weekly_report(metrics: DataFrame, baselines: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """Per model and metric: window summary, baseline comparison and the week's alert count."""
    summary = window_summary(metrics, now)
    compared = against_baseline(summary, baselines).select("model_id", "metric", "baseline", "change_pct", "status")
    recent = alerts.filter(F.col("ts") >= now - F.expr("INTERVAL '7' DAY")).groupBy("model_id").agg(F.count("*").alias("alert_count"))
    return (
        summary.join(compared, ["model_id", "metric"], "left")
        .join(recent, "model_id", "left")
        .fillna(0, ["alert_count"])
    )


def baseline_average(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """Current value against the mean of the baseline models, per metric."""
    mean = baselines.groupBy("metric").agg(F.avg("value").alias("baseline_average"))
    return current.join(mean, "metric").withColumn("improvement", F.col("value") - F.col("baseline_average"))


def limitation_rules(metrics: DataFrame) -> DataFrame:
    """Advice rows from a wide metrics table with accuracy, precision and recall per model."""
    acc, pre, rec = F.col("accuracy"), F.col("precision"), F.col("recall")
    rules = [
        ("low_accuracy", acc < 0.8),
        ("low_recall", rec < 0.7),
        ("strong_performance", acc >= 0.85),
        ("favours_precision", pre > rec + 0.1),
        ("favours_recall", rec > pre + 0.1),
        ("linear_model", F.col("model_type") == "logistic_regression"),
        ("tree_model", F.col("model_type") == "lightgbm"),
    ]
    hits = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    return metrics.select("model_id", F.explode(hits).alias("rule"))


def bias_text(parity: DataFrame, limit: float = 0.1) -> DataFrame:
    """A sentence per fairness measure of a parity table."""

    def line(c, name, verb_ok, verb_bad):
        fits = F.abs(F.col(c)) < limit
        return F.when(fits, F.format_string(f"{name} {verb_ok} (difference: %.3f)", F.col(c))).otherwise(
            F.format_string(f"{name} {verb_bad} (difference: %.3f)", F.col(c))
        )

    text = F.concat_ws(
        " ",
        line("demographic_parity_difference", "Demographic parity", "is well-maintained", "shows disparity"),
        line("equalized_odds_difference", "Equalized odds", "are well-maintained", "show disparity"),
    )
    return parity.withColumn("bias_analysis", text)


def model_summary(models: DataFrame, metrics: DataFrame, parity: DataFrame | None = None, importances: DataFrame | None = None, top: int = 10) -> DataFrame:
    """One row per model: details, latest metric values as a map, fairness text, top features."""
    latest = latest_per_key(metrics, ["model_id", "metric"], ["ts", "value"])
    values = latest.groupBy("model_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    out = models.join(values, "model_id", "left")
    if parity is not None:
        out = out.join(bias_text(parity).select("model_id", "bias_analysis"), "model_id", "left")
    if importances is not None:
        best = top_k_per_key(importances, ["model_id"], [F.desc("importance"), F.asc("feature")], top)
        names = best.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("_t"))
        out = out.join(names.select("model_id", F.transform("_t", lambda x: x["feature"]).alias("top_features")), "model_id", "left")
    return out
