"""Discrimination, calibration, decision curves and fairness of scores in [0, 1].

Everything that needs scores in order works on one table of distinct scores with positive
and negative counts and their running sums (``score_table``), per key. Ties share a point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import count_if, ratio
from tidemark.operators.ordered import _null_safe_join, running_totals

DISPARITY_LIMIT = 0.1
FOUR_FIFTHS = 0.8
DISPARITY_METRICS = ("auroc", "pr_auc", "tpr", "fpr", "ppv")


def score_table(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with ``pos``/``neg`` counts, running sums from the top, and totals."""
    keys = list(keys)
    data = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = data.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg")
    )
    run = running_totals(counts, keys, "score", ["pos", "neg"], descending=True)
    return run.withColumnsRenamed({"total_pos": "n_pos", "total_neg": "n_neg"})


def _both() -> Column:
    return (F.col("n_pos") > 0) & (F.col("n_neg") > 0)


def discrimination(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC with the Youden point, average precision with the best-F1 point, per key.

    The Youden point of a curve that never beats chance has no threshold (null). Ties go to
    the highest threshold for Youden and to the lowest for F1.
    """
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    wide = "decimal(38,0)"
    youden = tp.cast("decimal(19,0)") * F.col("n_neg").cast("decimal(19,0)") - fp.cast("decimal(19,0)") * F.col("n_pos").cast("decimal(19,0)")
    precision, recall = tp / (tp + fp), F.when(p > 0, tp / F.when(p > 0, p)).otherwise(F.lit(0.0))
    f1 = 2 * precision * recall / (precision + recall + 1e-10)
    both = _both()
    area = F.sum(F.when(both, F.col("neg") * (tp - F.col("pos") / 2.0) / F.when(both, p * n)))
    rows = table.withColumns(
        {
            "_j": youden.cast(wide),
            "_tpr": F.when(both, tp / F.when(both, p)),
            "_fpr": F.when(both, fp / F.when(both, n)),
            "_precision": precision,
            "_recall": recall,
            "_f1": f1,
        }
    )
    best_j = F.max_by(F.struct("score", "_tpr", "_fpr", "_j"), F.struct("_j", "score"))
    best_f = F.max_by(F.struct("score", "_precision", "_recall", "_f1"), F.struct(F.round("_f1", 12), -F.col("score")))
    out = rows.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        area.alias("auroc"),
        F.when(F.max("n_pos") > 0, F.sum(F.when(p > 0, F.col("pos") / F.when(p > 0, p) * precision))).alias("pr_auc"),
        best_j.alias("_bj"),
        best_f.alias("_bf"),
    )
    beats = F.col("_bj._j") > 0
    return out.select(
        *keys,
        "n_pos",
        "n_neg",
        "auroc",
        F.when(beats, F.col("_bj.score")).alias("optimal_threshold"),
        F.when(beats, F.col("_bj._tpr")).otherwise(F.lit(0.0)).alias("optimal_tpr"),
        F.when(beats, F.col("_bj._fpr")).otherwise(F.lit(0.0)).alias("optimal_fpr"),
        F.when(beats, F.col("_bj._tpr") - F.col("_bj._fpr")).otherwise(F.lit(0.0)).alias("optimal_j_score"),
        "pr_auc",
        F.col("_bf.score").alias("optimal_threshold_f1"),
        F.col("_bf._precision").alias("optimal_precision"),
        F.col("_bf._recall").alias("optimal_recall"),
        F.col("_bf._f1").alias("optimal_f1"),
    )


def auroc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    cols = ["auroc", "optimal_threshold", "optimal_tpr", "optimal_fpr", "optimal_j_score"]
    return discrimination(score_table(df, label, score, keys), keys).select(*keys, *cols)


def pr_auc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    cols = ["pr_auc", "optimal_threshold_f1", "optimal_precision", "optimal_recall", "optimal_f1"]
    return discrimination(score_table(df, label, score, keys), keys).select(*keys, *cols)


def bin_edges(n_bins: int) -> list[float]:
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _bins_above(score: Column, edges: Sequence[float], strict: bool) -> Column:
    tests = [(score > e if strict else score >= e).cast("int") for e in edges]
    return sum(tests[1:], tests[0])


def calibration_curve(df: DataFrame, label: str = "label", score: str = "score", n_bins: int = 10, keys: Sequence[str] = (), lower_closed: bool = False) -> DataFrame:
    """Mean outcome and mean score per non-empty uniform bin.

    An interior edge belongs to the lower bin, or to the upper one with ``lower_closed``
    (the last bin then also takes a score of exactly 1).
    """
    edges = bin_edges(n_bins)[1:-1]
    bin_index = _bins_above(F.col(score), edges, strict=not lower_closed)
    return df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, bin_index.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("prob_true"), F.avg(score).alias("prob_pred")
    )


def calibration_errors(df: DataFrame, label: str = "label", score: str = "score", n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Brier score, ECE over ``[low, high)`` bins (a score of 1 falls out) and MCE over the curve's bins."""
    keys = list(keys)
    edges = bin_edges(n_bins)
    data = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(label).cast("double").alias("_y"), F.col(score).alias("_p")
    )
    cells = data.groupBy(
        *keys,
        _bins_above(F.col("_p"), edges[1:-1], strict=True).alias("_upper"),
        (_bins_above(F.col("_p"), edges, strict=False) - 1).alias("_lower"),
    ).agg(
        F.count("*").alias("_n"), F.sum("_y").alias("_sy"), F.sum("_p").alias("_sp"), F.sum((F.col("_p") - F.col("_y")) ** 2).alias("_se")
    )
    totals = cells.groupBy(*keys).agg(F.sum("_n").alias("_total"), (F.sum("_se") / F.sum("_n")).alias("brier_score"))
    low = cells.filter(F.col("_lower").between(0, n_bins - 1)).groupBy(*keys, "_lower").agg(F.abs(F.sum("_sp") - F.sum("_sy")).alias("_gap"))
    ece = low.groupBy(*keys).agg(F.sum("_gap").alias("_gaps"))
    up = cells.groupBy(*keys, "_upper").agg((F.abs(F.sum("_sy") - F.sum("_sp")) / F.sum("_n")).alias("_gap"))
    mce = up.groupBy(*keys).agg(F.max("_gap").alias("maximum_calibration_error"))
    j = _null_safe_join(_null_safe_join(totals, ece, keys, "left"), mce, keys, "left")
    return j.select(
        *keys, "brier_score", (F.coalesce("_gaps", F.lit(0.0)) / F.col("_total")).alias("expected_calibration_error"), "maximum_calibration_error"
    )


def decision_curve(df: DataFrame, label: str = "label", score: str = "score", thresholds: Sequence[float] | None = None) -> DataFrame:
    """Net benefit of the model and of treating everyone, per threshold.

    Each score is reduced to how many thresholds it reaches, so the shuffle carries at most
    one row per threshold and no row is compared with every threshold.
    """
    if thresholds is None:
        step = (0.99 - 0.01) / 98
        thresholds = [0.01 + i * step for i in range(98)] + [0.99]
    thresholds = sorted(float(x) for x in thresholds)
    values = F.array(*[F.lit(x) for x in thresholds])
    data = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    reached = F.size(F.filter(values, lambda x: x <= F.col(score)))
    cells = data.groupBy(reached.alias("_k")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_pos"), F.sum((F.col(label) != 1).cast("long")).alias("_neg")
    )
    # a score that reaches k thresholds counts at each of the first k of them: at most
    # (thresholds + 1) rows are spread here
    hits = cells.select(F.posexplode(F.slice(values, F.lit(1), F.col("_k"))).alias("_i", "threshold"), "_pos", "_neg")
    per = hits.groupBy("_i").agg(F.sum("_pos").alias("_tp"), F.sum("_neg").alias("_fp"))
    totals = cells.agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    grid = totals.select("*", F.posexplode(values).alias("_i", "threshold"))
    odds = F.col("threshold") / (1 - F.col("threshold"))
    size = F.col("_p") + F.col("_n")
    return grid.join(per, "_i", "left").select(
        (F.col("_i") + 1).alias("step"),
        "threshold",
        (F.coalesce("_tp", F.lit(0)) / size - F.coalesce("_fp", F.lit(0)) / size * odds).alias("net_benefit"),
        (F.col("_p") / size - F.col("_n") / size * odds).alias("treat_all"),
    )


def best_decision(curve: DataFrame) -> DataFrame:
    """Threshold with the largest net benefit (lowest threshold on ties)."""
    return curve.agg(
        F.max("net_benefit").alias("max_benefit"), F.min_by("threshold", F.struct(-F.round("net_benefit", 12), "threshold")).alias("max_benefit_threshold")
    )


def by_sensitive(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per (row, sensitive feature) as ``feature`` and ``group``."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("group")) for f in features])
    return df.select("*", F.inline(cells))


def group_rates(df: DataFrame, features: Sequence[str], label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Confusion rates, prevalence, accuracy, AUROC and PR-AUC per group of each sensitive feature."""
    long = by_sensitive(df.select(label, score, *features), features).filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    keys = ["feature", "group"]
    counts = long.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        count_if(y & hit).alias("tp"),
        count_if(~y & hit).alias("fp"),
        count_if(~y & ~hit).alias("tn"),
        count_if(y & ~hit).alias("fn"),
    )
    curve = discrimination(score_table(long, label, score, keys), keys).select(*keys, "auroc", "pr_auc")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return _null_safe_join(counts, curve, keys, "left").select(
        *keys,
        "n_samples",
        ((tp + fn) / F.col("n_samples")).alias("prevalence"),
        "auroc",
        "pr_auc",
        ratio(tp, tp + fn, 0.0).alias("tpr"),
        ratio(fp, fp + tn, 0.0).alias("fpr"),
        ratio(tn, tn + fp, 0.0).alias("tnr"),
        ratio(fn, fn + tp, 0.0).alias("fnr"),
        ratio(tp, tp + fp, 0.0).alias("ppv"),
        ratio(tn, tn + fn, 0.0).alias("npv"),
        ((tp + tn) / F.col("n_samples")).alias("accuracy"),
        ((tp + fp) / F.col("n_samples")).alias("positive_rate"),
    )


def disparities(rates: DataFrame, limit: float = DISPARITY_LIMIT) -> DataFrame:
    """``(feature, metric, disparity, flagged)``: largest minus smallest value over groups."""
    cells = F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in DISPARITY_METRICS])
    long = rates.select("feature", F.inline(cells)).filter("value IS NOT NULL")
    return long.groupBy("feature", "metric").agg((F.max("value") - F.min("value")).alias("disparity"), F.count("*").alias("_n")).filter(
        "_n >= 2"
    ).select("feature", "metric", "disparity", (F.col("disparity") > limit).alias("flagged"))


def parity_differences(rates: DataFrame) -> DataFrame:
    """Demographic parity, equalized odds and accuracy parity per sensitive feature."""

    def spread(c):
        return F.max(c) - F.min(c)

    return rates.groupBy("feature").agg(
        spread("positive_rate").alias("demographic_parity_difference"),
        spread("tpr").alias("equalized_odds_tpr_difference"),
        spread("fpr").alias("equalized_odds_fpr_difference"),
        F.greatest(spread("tpr"), spread("fpr")).alias("equalized_odds_difference"),
        spread("accuracy").alias("accuracy_parity_difference"),
        F.count("*").alias("_n"),
    ).filter("_n >= 2").drop("_n")


def disparate_impact(df: DataFrame, group: str, privileged: str, prediction: Column) -> DataFrame:
    """Positive rate of every other group over the privileged one, and the four-fifths test."""
    p = prediction.cast("double")
    row = df.agg(
        F.avg(F.when(F.col(group) == privileged, p)).alias("privileged_rate"),
        F.avg(F.when(F.col(group) != privileged, p)).alias("unprivileged_rate"),
    )
    impact = ratio(F.col("unprivileged_rate"), F.col("privileged_rate"), 0.0)
    return row.withColumn("disparate_impact", impact).withColumn("passes", F.col("disparate_impact") >= FOUR_FIFTHS)


def equalized_odds_two_groups(rates: DataFrame, feature: str, group_a: str, group_b: str) -> DataFrame:
    """|ΔTPR|, |ΔFPR| and their larger one between two named groups."""
    here = rates.filter(F.col("feature") == feature)

    def gap(c):
        a = F.max(F.when(F.col("group") == group_a, F.col(c)))
        b = F.max(F.when(F.col("group") == group_b, F.col(c)))
        return F.abs(a - b)

    row = here.agg(gap("tpr").alias("tpr_difference"), gap("fpr").alias("fpr_difference"))
    return row.withColumn("equalized_odds_difference", F.greatest("tpr_difference", "fpr_difference"))


def evaluation_report(df: DataFrame, features: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Long ``(section, item, metric, value)`` with every measure above."""

    def long(d, section, item, names):
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return d.select(F.lit(section).alias("section"), item.alias("item"), F.inline(cells))

    nothing = F.lit(None).cast("string")
    d = discrimination(score_table(df, label, score))
    parts = [
        long(d, "discrimination", nothing, ["auroc", "optimal_threshold", "optimal_j_score", "pr_auc", "optimal_threshold_f1", "optimal_f1"]),
        long(calibration_errors(df, label, score), "calibration", nothing, ["brier_score", "expected_calibration_error", "maximum_calibration_error"]),
        long(best_decision(decision_curve(df, label, score)), "decision", nothing, ["max_benefit", "max_benefit_threshold"]),
    ]
    if features:
        rates = group_rates(df, features, label, score)
        name = F.concat_ws("=", "feature", "group")
        parts.append(long(rates, "group", name, ["n_samples", "prevalence", "auroc", "pr_auc", "tpr", "fpr", "ppv", "npv"]))
        parts.append(disparities(rates).select(F.lit("disparity").alias("section"), F.col("feature").alias("item"), "metric", F.col("disparity").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
