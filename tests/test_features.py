"""Feature operators on hand-made rows."""

import datetime as dt
import math
import random

import pytest

from tidemark.operators import adherence as ad, behavioral as be, physiological as ph
from tidemark.plans.features import extract_features, merge_features

T0 = dt.datetime(2024, 1, 1)


def day(n, hours=0):
    return T0 + dt.timedelta(days=n, hours=hours)


def rows(df, key="anonymized_id"):
    return {r[key]: r for r in df.collect()}


def test_activity_windows_count_from_each_ids_own_latest(spark):
    df = spark.createDataFrame(
        [("a", "walk", day(0)), ("a", "run", day(20)), ("a", "walk", day(26)), ("a", "run", day(27)), ("b", "swim", day(1)), (None, "x", day(1))],
        "anonymized_id string, activity_type string, timestamp timestamp_ntz",
    )
    r = rows(be.activity_features(df))
    assert set(r) == {"a", "b"}
    assert (r["a"]["activity_count_7d"], r["a"]["activity_count_30d"]) == (3, 4)
    assert r["a"]["most_common_activity_30d"] == "run" and r["a"]["most_common_activity_7d"] == "run"
    assert r["a"]["activity_frequency_7d"] == pytest.approx(3 / 8)
    assert r["a"]["activity_diversity_30d"] == pytest.approx(math.log(2))
    assert r["b"]["activity_diversity_7d"] == 0.0 and r["b"]["activity_frequency_7d"] == 1.0


def test_routine_of_one_kind_is_fully_consistent(spark):
    df = spark.createDataFrame([("a", "walk", day(7 * i)) for i in range(4)], "anonymized_id string, activity_type string, timestamp timestamp_ntz")
    r = be.routine_consistency(df).first()
    assert (r["hour_consistency"], r["day_consistency"], r["activity_type_consistency"], r["overall_routine_consistency"]) == (1.0, 1.0, 1.0, 1.0)


def test_social_regularity_needs_two_days(spark):
    df = spark.createDataFrame(
        [("a", "call", 10, day(0)), ("a", "call", None, day(1)), ("b", "call", None, day(0))],
        "anonymized_id string, interaction_type string, duration_minutes int, timestamp timestamp_ntz",
    )
    r = rows(be.social_metrics(df))
    assert r["a"]["interaction_regularity"] == 1.0 and r["a"]["median_interaction_duration"] == 10.0
    assert r["b"]["interaction_regularity"] == 0.0 and r["b"]["total_interaction_duration"] == 0.0


def test_sleep_skips_invalid_nights_but_efficiency_keeps_them(spark):
    df = spark.createDataFrame(
        [("a", day(0), day(0, 8), 1), ("a", day(1), day(0), 2), ("b", day(0), day(3), None)],
        "anonymized_id string, sleep_start timestamp_ntz, sleep_end timestamp_ntz, interruptions int",
    )
    r = rows(ph.sleep_features(df))
    assert r["a"]["mean_sleep_duration"] == 8.0 and r["a"]["std_sleep_duration"] is None and r["a"]["mean_sleep_efficiency"] == 0.5
    assert r["b"]["mean_sleep_duration"] == 0.0 and r["b"]["std_sleep_duration"] == 0.0 and r["b"]["mean_interruptions"] == 0.0


def test_hrv_and_zones(spark):
    df = spark.createDataFrame([("a", 800.0, day(0)), ("a", 900.0, day(1)), ("a", 840.0, day(2)), ("b", 700.0, day(0))], "anonymized_id string, rr_intervals double, timestamp timestamp_ntz")
    r = rows(ph.hrv_metrics(df))
    assert r["a"]["rmssd"] == pytest.approx(math.sqrt((100**2 + 60**2) / 2)) and r["a"]["pnn50"] == 100.0
    assert (r["b"]["rmssd"], r["b"]["mean_rr"]) == (0.0, 0.0)
    hr = spark.createDataFrame([("a", 95.0, 100), ("a", 171.0, 0), ("a", 50.0, None)], "anonymized_id string, heart_rate double, steps int")
    z = ph.activity_intensity(hr).first()
    assert z["zone1_pct"] == pytest.approx(100 / 3) and z["zone5_pct"] == pytest.approx(100 / 3) and z["activity_intensity_score"] == 2.0
    assert z["total_steps"] == 100.0 and z["median_daily_steps"] == 50.0


def test_adherence_zero_scheduled_is_low(spark):
    df = spark.createDataFrame([("a", 10, 8, "cbt"), ("b", 0, 0, "cbt"), ("b", 0, 0, "dbt")], "anonymized_id string, scheduled_sessions int, completed_sessions int, intervention_type string")
    r = rows(ad.adherence_rate(df))
    assert r["a"]["overall_adherence_rate"] == 80.0 and r["a"]["adherence_category"] == "high" and r["a"]["adherence_cbt"] == 80.0
    assert r["b"]["overall_adherence_rate"] == 0.0 and r["b"]["adherence_category"] == "low" and r["b"]["adherence_dbt"] is None


def test_streak_of_missed_sessions(spark):
    states = ["completed", "missed", "completed", "missed", "missed"]
    df = spark.createDataFrame([("a", day(i), s) for i, s in enumerate(states)], "anonymized_id string, session_date timestamp_ntz, status string")
    r = ad.missed_sessions(df).first()
    assert (r["max_consecutive_missed"], r["missed_sessions_count"], r["consecutive_miss_flag"], r["high_miss_rate_flag"], r["recent_missed_7d"]) == (2, 3, False, True, 3)


def test_engagement_uses_only_present_components(spark):
    df = spark.createDataFrame([("a", 300, 60.0, day(0))], "anonymized_id string, interaction_count int, session_duration_minutes double, timestamp timestamp_ntz")
    r = ad.engagement_score(df).first()
    assert r["overall_engagement_score"] == 1.0 and r["engagement_level"] == "high" and r["engagement_consistency"] is None
    bare = ad.engagement_score(df.select("anonymized_id", "timestamp")).first()
    assert bare["overall_engagement_score"] == 0.0 and bare["engagement_level"] == "none"


def test_merge_keeps_everyone_and_suffixes_clashes(spark):
    a = spark.createDataFrame([("x", 1)], "anonymized_id string, n int")
    b = spark.createDataFrame([("y", 2)], "anonymized_id string, n int")
    out = rows(merge_features([a, b]))
    assert (out["x"]["n"], out["x"]["n_1"], out["y"]["n"], out["y"]["n_1"]) == (1, None, None, 2)
    with pytest.raises(ValueError):
        extract_features()


def test_features_in_few_passes_are_those_of_the_lone_functions(spark):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)
    acts = [(pick("a", "b", "c", "d", None), pick("walk", "run", "swim", None), day(rng.randrange(50), rng.randrange(24)) if rng.random() < 0.9 else None, pick(None, 5.0, 7.5, 20.0)) for _ in range(300)]
    acts += [("e", None, day(1), None), ("f", "walk", None, 3.0)]
    nights = [(pick("a", "b", "x"), day(i), day(i, rng.randrange(-2, 30)), pick(None, 1, 2, 3)) for i in range(40)]
    beats = [(pick("a", "y", None), float(rng.randrange(60, 190)), pick(None, 100, 250), day(i)) for i in range(60)] + [("z", None, None, day(1))]
    uses = [(pick("a", "b", "w"), pick(None, 1, 9), pick(None, 10.0, 50.0), day(rng.randrange(45))) for _ in range(60)] + [("v", 1, 1.0, None)]
    held = [(pick("a", "u"), day(i), pick("missed", "completed", None)) for i in range(30)]
    b = spark.createDataFrame(acts, "anonymized_id string, activity_type string, timestamp timestamp_ntz, duration_minutes double")
    s = spark.createDataFrame(nights, "anonymized_id string, sleep_start timestamp_ntz, sleep_end timestamp_ntz, interruptions int")
    h = spark.createDataFrame(beats, "anonymized_id string, heart_rate double, steps int, timestamp timestamp_ntz")
    e = spark.createDataFrame(uses, "anonymized_id string, interaction_count int, session_duration_minutes double, timestamp timestamp_ntz")
    m = spark.createDataFrame(held, "anonymized_id string, session_date timestamp_ntz, status string")
    lone = [
        be.activity_features(b), be.routine_consistency(b), be.social_metrics(b, interaction_column="activity_type"), ph.sleep_features(s),
        ph.hrv_metrics(h), ph.activity_intensity(h), ad.missed_sessions(m), ad.engagement_score(e),
    ]
    want, got = merge_features(lone), extract_features(behavioral=b, sleep=s, hrv=h, activity=h, sessions=m, engagement=e)
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    want, got = rows(want), rows(got)
    assert set(got) == set(want) == set("abcdefuwxyz")
    for key, row in want.items():
        for name, value in row.asDict().items():
            assert got[key][name] == (pytest.approx(value) if isinstance(value, float) else value), (key, name)


def test_features_of_empty_tables(spark):
    b = spark.createDataFrame([], "anonymized_id string, activity_type string, timestamp timestamp_ntz, duration_minutes double")
    assert extract_features(behavioral=b).count() == 0
