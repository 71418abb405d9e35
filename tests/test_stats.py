"""Profiling, drift, evaluation, fairness and model helpers on small fixtures."""

import math
import random

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, evaluate, explain, profile, score, split, train


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_numeric_summary_edges(spark):
    r = profile.numeric_summary(numbers(spark, [1.0, None]), ["x"]).first()
    assert r["count"] == 1 and r["std"] is None and r["skewness"] is None and r["kurtosis"] is None
    flat = profile.numeric_summary(numbers(spark, [2.0] * 5), ["x"]).first()
    assert flat["std"] == 0.0 and flat["skewness"] == 0.0 and flat["kurtosis"] == 0.0
    assert profile.numeric_summary(numbers(spark, [None]), ["x"]).count() == 0


def test_ks_extremes(spark):
    a, b = numbers(spark, [1.0, 2.0, 3.0]), numbers(spark, [11.0, 12.0])
    assert drift.ks_statistics(a, a, ["x"]).first()["statistic"] == 0.0
    assert drift.ks_statistics(a, b, ["x"]).first()["statistic"] == 1.0
    assert drift.ks_statistics(a, numbers(spark, [None]), ["x"]).first()["statistic"] == 0.0


def test_shifted_normals_drift_and_equal_ones_do_not(spark):
    rng = random.Random(1)
    base = numbers(spark, [rng.gauss(0, 1) for _ in range(300)])
    same = numbers(spark, [rng.gauss(0, 1) for _ in range(300)])
    moved = numbers(spark, [rng.gauss(5, 1) for _ in range(300)])
    assert not drift.monitor_drift(base, same, ["x"]).first()["drift_detected"]
    assert drift.monitor_drift(base, moved, ["x"]).first()["drift_detected"]
    assert drift.version_drift_summary(drift.version_drift(base, moved)).first()["advice"] == "high"


def test_kl_of_a_constant_is_zero(spark):
    one = numbers(spark, [3.0, 3.0])
    assert drift.kl_divergences(one, one, ["x"]).first()["kl"] == 0.0


def test_chi_square(spark):
    a = spark.createDataFrame([("x",)] * 50 + [("y",)] * 50, "k string")
    b = spark.createDataFrame([("x",)] * 30 + [("y",)] * 70, "k string")
    r = drift.chi_square_drift(a, b, ["k"]).first()
    assert r["statistic"] == pytest.approx(16.0) and r["score"] == pytest.approx(0.8)
    assert drift.chi_square_drift(a, b.union(spark.createDataFrame([("new",)], "k string")), ["k"]).first()["score"] == 1.0
    p = spark.createDataFrame([(16.0, 1.0), (5.991464547, 2.0), (7.814727903, 3.0)], "s double, k double").select(drift.chi_square_p_value("s", "k").alias("p"))
    assert [r["p"] for r in p.collect()] == pytest.approx([6.334e-05, 0.05, 0.05], rel=1e-3)


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_auroc_ties_and_single_class(spark):
    assert evaluate.auroc(scored(spark, [(1, 0.5), (0, 0.5)])).first()["auroc"] == 0.5
    assert evaluate.auroc(scored(spark, [(1, 0.9), (0, 0.1)])).first()["auroc"] == 1.0
    assert evaluate.auroc(scored(spark, [(1, 0.9), (1, 0.1)])).first()["auroc"] is None


def test_calibration_edges(spark):
    d = scored(spark, [(1, 0.1), (0, 0.2), (1, 1.0)])
    lower = {r["bin"]: r["n"] for r in evaluate.calibration_curve(d).collect()}
    upper = {r["bin"]: r["n"] for r in evaluate.calibration_curve(d, lower_closed=True).collect()}
    assert lower == {0: 1, 1: 1, 9: 1} and upper == {1: 1, 2: 1, 9: 1}
    e = evaluate.calibration_errors(d).first()
    assert e["expected_calibration_error"] == pytest.approx((0.9 + 0.2) / 3) and e["maximum_calibration_error"] == pytest.approx(0.9)


def test_decision_curve_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(200)]
    for r in evaluate.decision_curve(scored(spark, rows)).collect():
        t = r["threshold"]
        tp, fp = sum(y for y, s in rows if s >= t), sum(1 - y for y, s in rows if s >= t)
        assert r["net_benefit"] == pytest.approx(tp / 200 - fp / 200 * t / (1 - t))


def test_spearman_with_ties_by_brute_force(spark):
    rows = [(1.0, 3.0), (1.0, 2.0), (2.0, 2.0), (5.0, 9.0), (None, 1.0)]
    got = profile.correlations(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], "spearman").first()["r"]
    ra, rb = [1.5, 1.5, 3, 4], [3, 1.5, 1.5, 4]
    ma, mb = sum(ra) / 4, sum(rb) / 4
    want = sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / math.sqrt(sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))
    assert got == pytest.approx(want)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert profile.correlations(df, ["a", "b"]).first()["r"] is None


def test_fairness_of_biased_labels(spark):
    rng = random.Random(3)
    rows = [(("a", "b")[i % 2], rng.randrange(2)) for i in range(1000)]
    rows = [(g, y, min(1.0, max(0.0, 0.5 * y + 0.25 + (0.3 if g == "a" else -0.1)))) for g, y in rows]
    rates = evaluate.group_rates(spark.createDataFrame(rows, "group string, label int, score double").withColumnRenamed("group", "g"), ["g"])
    flagged = {r["metric"] for r in evaluate.disparities(rates).filter("flagged").collect()}
    assert "fpr" in flagged
    assert evaluate.parity_differences(rates).first()["demographic_parity_difference"] > 0.3


def imbalanced(spark, n=400):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random() * 10, 1 if i % 10 == 0 else 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, label int")


def test_smote_stays_inside_the_minority_hull(spark):
    df = imbalanced(spark)
    out = split.smote(df, ["a", "b"], "label", "id")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 360, 1: 360}
    box = df.filter("label = 1").agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    made = out.filter("is_synthetic").collect()
    assert len(made) == 320 and all(box[0] <= r["a"] <= box[1] and box[2] <= r["b"] <= box[3] for r in made)
    balanced = df.filter("id < 20")
    assert split.smote(balanced.withColumn("label", (F.col("id") % 2).cast("int")), ["a", "b"], "label", "id").count() == 20


def test_folds_are_repeatable_and_k_is_lowered(spark):
    df = imbalanced(spark, 40)
    folds = split.stratified_folds(df, "label", ["id"], 5)
    assert folds.agg(F.max("fold")).first()[0] == 3
    again = split.stratified_folds(df.repartition(3), "label", ["id"], 5)
    assert {(r["id"], r["fold"]) for r in folds.collect()} == {(r["id"], r["fold"]) for r in again.collect()}


def test_ensemble_edges(spark):
    df = spark.createDataFrame([(0.2, 0.2), (0.0, 1.0)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    assert [r[0] for r in df.select(score.confidence(cols)).collect()] == [1.0, 0.0]
    with pytest.raises(ValueError):
        score.combine(cols, weights=[0.5, 0.6])
    out = score.ensemble_scores(df, ["a", "b"], [0.1, 0.9]).collect()
    assert out[1]["risk_score"] == pytest.approx(90.0) and out[1]["risk_level"] == "critical" and out[1]["alert"]


def test_counterfactual_by_brute_force(spark):
    model = explain.LinearModel({"p": 2.0, "q": -1.0, "r": 0.5}, 0.2)
    rng = random.Random(6)
    rows = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, p double, q double, r double")
    got = {r["id"]: r for r in explain.describe_counterfactual(explain.counterfactuals(df, model, ["id"], "low", 2, {"q": (-1.0, 1.0)})).collect()}
    sigma = lambda z: 100 / (1 + math.exp(-z))
    for i, p, q, r in rows:
        x, w = {"p": p, "q": q, "r": r}, model.weights
        logit = 0.2 + sum(w[c] * x[c] for c in w)
        n = 0
        if sigma(logit) > 25:
            for c in sorted(w, key=lambda c: -abs(w[c] * x[c]))[:2]:
                way = -1 if w[c] * x[c] > 0 else 1
                new = x[c] + way * max(abs(x[c] * 0.1), 0.5)
                if c == "q":
                    new = min(max(new, -1.0), 1.0)
                logit += w[c] * (new - x[c])
                n += 1
                if sigma(logit) <= 25:
                    break
        assert len(got[i]["changes"]) == n and got[i]["counterfactual_score"] == pytest.approx(sigma(logit))
        assert got[i]["description"].startswith("Already" if n == 0 else "To ")


def test_explanation_methods_are_small_enough_to_be_compiled(spark):
    """The JVM only interprets methods above 8,000 bytes; no expression but the two over ``changes`` is interpreted."""
    rng = random.Random(9)
    rows = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, p double, q double, r double")
    out = explain.explanation_bundle(df, explain.LinearModel({"p": 2.0, "q": -1.0, "r": 0.5}, 0.2, {"p": 0.1}, {"q": 2.0}), ["id"])
    assert len(out.collect()) == 20
    plan = out._jdf.queryExecution().executedPlan()
    parts = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    assert parts.size() and max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) <= 8000
    assert "array_sort(" not in plan.toString()


def test_fixed_writes_what_format_string_writes(spark):
    rng = random.Random(10)
    values = [None, 0.0, -0.0, 0.005, -0.005, 0.0049, 0.125, 1.005, 2.675, 99.995, -0.05, 0.05, 1e11, 999999999999.95, 1e12, 1e300, 5e-324, math.nan, math.inf, -math.inf]
    values += [round(rng.uniform(-30, 30), rng.randint(1, 5)) for _ in range(2000)] + [rng.gauss(0, 10.0 ** rng.randint(-4, 12)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3):
        pairs = df.select(explain.fixed(F.col("x"), digits).alias("got"), F.format_string(f"%.{digits}f", "x").alias("want"))
        assert [r for r in pairs.collect() if r["got"] != r["want"]] == []


def test_change_texts(spark):
    model = explain.LinearModel({"p": 2.0, "q": -1.0}, 0.0, {"p": 1.0}, {"p": 2.0}, {"q": "the q"})
    df = spark.createDataFrame([(1, 3.0, 0.0), (2, -9.0, 0.0), (3, 9.0, 0.0), (4, None, 0.0)], "id int, p double, q double")
    got = {r["id"]: r for r in explain.explanation_bundle(df, model, ["id"]).collect()}
    assert got[1]["summary"].split("\n") == [
        "Key Contributing Factors:", "  1. p (importance: 2.000)", "  2. q (importance: 0.000)", "Actionable Changes:",
        "To move toward low risk level (from 88.1 to 62.2), the following changes would help:",
        "1. Decrease p from 3.00 to 2.00", "2. Increase the q from 0.00 to 0.50", "",
        "These 2 change(s) would move the risk score to 62.2 (high risk level), closer to the target of low.",
    ]
    assert got[2]["description"] == got[4]["description"] == "Already at low risk level. No changes needed."
    assert [r["feature"] for r in got[4]["top_features"]] == ["q", "p"] and got[4]["summary"].split("\n")[2] == "  2. p (importance: nul)"  # the formatter cuts a null to the digits


def test_isolation_forest_ranks_the_outlier_first(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(999, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    forest = train.fit_isolation_forest(df, ["x", "y"], ["id"], n_trees=30)
    scored_rows = forest.predict(df).orderBy("score").collect()
    assert scored_rows[0]["id"] == 999 and scored_rows[0]["is_anomaly"]
    assert sum(r["is_anomaly"] for r in scored_rows) == pytest.approx(30, abs=2)


def test_search_helpers(spark):
    assert len(train.grid_trials({"a": [1, 2], "b": [3, 4, 5]})) == 6
    draws = train.random_trials({"lr": {"type": "float", "low": 1e-4, "high": 1.0, "log": True}, "n": {"type": "int", "low": 2, "high": 4}, "k": {"type": "categorical", "choices": ["x"]}}, 50)
    assert all(1e-4 <= d["lr"] <= 1 and 2 <= d["n"] <= 4 and d["k"] == "x" for d in draws) and draws == train.random_trials(
        {"lr": {"type": "float", "low": 1e-4, "high": 1.0, "log": True}, "n": {"type": "int", "low": 2, "high": 4}, "k": {"type": "categorical", "choices": ["x"]}}, 50
    )
    trials = train.run_trials(spark, [{"v": v} for v in (1.0, 3.0, 2.0, 2.0, 9.0)], lambda p: p["v"], patience=2)
    assert trials.count() == 4
    stats = train.trial_statistics(trials).first()
    assert stats["best_trial"] == 1 and stats["lower"] < stats["mean"] < stats["upper"]
    assert train.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-4)


def test_chronological_split_takes_any_key_and_puts_missing_times_last(spark):
    rows = [(f"p{i:03d}", None if i % 10 == 0 else T(i // 4), i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, label int").repartition(5)
    train, test = split.chronological_split(df, "timestamp", 0.2, ["id"])
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or T(0), r[0]))
    assert sorted(r["id"] for r in train.collect()) == sorted(r[0] for r in order[:80])
    assert sorted(r["id"] for r in test.collect()) == sorted(r[0] for r in order[80:])


def test_missing_labels_are_no_class(spark):
    rows = [(i, None if i < 3 else 0 if i < 90 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, label int")
    assert split.class_counts(df, "label") == {0: 87, 1: 10}
    kept = split.undersample(df, "label", ["id"]).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in kept} == {None: 3, 0: 10, 1: 10}


def T(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
