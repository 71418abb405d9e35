"""Scoring rows with fitted models and combining several models' probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import alert_flag, clip, risk_level

METHODS = ("weighted_average", "simple_average", "max", "median")


def linear_probability(weights: dict[str, float], intercept: float) -> Column:
    """Logistic probability of a linear model, inside code generation."""
    logit = sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(float(intercept)))
    return 1.0 / (1.0 + F.exp(-logit))


def score_with_model(df: DataFrame, model, name: str = "probability_1") -> DataFrame:
    """Rows with the positive-class probability and the label at 0.5 of a fitted classifier."""
    scored = model.transform(df)
    p = vector_to_array("probability")[1]
    drop = [c for c in ("rawPrediction", "probability", "prediction", "features", "raw_features") if c in scored.columns]
    return scored.withColumn(name, p).withColumn(f"{name}_label", (p >= 0.5).cast("int")).drop(*drop)


def combine(predictions: Sequence[Column], method: str = "weighted_average", weights: Sequence[float] | None = None) -> Column:
    """One score per row from several models' probabilities."""
    n = len(predictions)
    if n == 0:
        raise ValueError("no predictions")
    if method == "weighted_average":
        w = list(weights) if weights is not None else [1.0 / n] * n
        if len(w) != n or abs(sum(w) - 1.0) > 1e-8:
            raise ValueError("weights must match the predictions and sum to 1")
        return sum((p * F.lit(float(x)) for p, x in zip(predictions, w)), F.lit(0.0))
    if method == "simple_average":
        return sum(predictions, F.lit(0.0)) / n
    if method == "max":
        return F.array_max(F.array(*predictions))
    if method == "median":
        s = F.array_sort(F.array(*predictions))
        return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
    raise ValueError(f"unknown method: {method}")


def weights_from_scores(validation: dict[str, float]) -> list[float]:
    """Model weights in proportion to their validation scores."""
    total = sum(validation.values())
    return [v / total if total else 1.0 / len(validation) for v in validation.values()]


def confidence(predictions: Sequence[Column], method: str = "agreement") -> Column:
    """Agreement between models in [0, 1], computed on probabilities."""
    n = len(predictions)
    mean = sum(predictions, F.lit(0.0)) / n
    variance = sum(((p - mean) * (p - mean) for p in predictions), F.lit(0.0)) / n
    if method == "agreement":
        return clip(1.0 - F.sqrt(variance) / 0.5, 0.0, 1.0)
    if method == "variance":
        return clip(1.0 - variance / 0.25, 0.0, 1.0)
    if method == "entropy":
        h = -(mean * F.log2(mean + 1e-10) + (1 - mean) * F.log2(1 - mean + 1e-10))
        return clip(1.0 - h, 0.0, 1.0)
    raise ValueError(f"unknown method: {method}")


def ensemble_scores(
    df: DataFrame, predictions: Sequence[str], weights: Sequence[float] | None = None, method: str = "weighted_average",
    confidence_method: str = "agreement",
) -> DataFrame:
    """Add ``risk_score`` (0–100), ``confidence``, ``risk_level`` and ``alert`` in one projection."""
    cols = [F.col(p) for p in predictions]
    return (
        df.withColumns({"risk_score": combine(cols, method, weights) * 100, "confidence": confidence(cols, confidence_method)})
        .withColumns({"risk_level": risk_level(F.col("risk_score")), "alert": alert_flag(F.col("risk_score"))})
    )


def calibration_bounds(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"))


def calibrated_score(score: Column, low: Column, high: Column) -> Column:
    """0 for the most normal (highest) raw score, 100 for the most anomalous; clipped."""
    span = high - low
    return clip(F.when(span > 0, 100 * (high - score) / F.when(span > 0, span)).otherwise(F.lit(0.0)), 0.0, 100.0)
