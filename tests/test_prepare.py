"""Cleaning, imputing, encoding, scaling, validation, privacy, consent: small exact answers."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import common as fn
from tidemark.functions.text import analyze_sentiment, emotion_columns
from tidemark.operators import clean, consent, encode, impute, privacy, scale, validate
from tidemark.plans import etl

T0 = dt.datetime(2024, 1, 1)


def values(df, c):
    return [r[c] for r in df.collect()]


def test_keep_first_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame(
        [("a", T0, 2), ("a", T0, 1), ("b", T0, 5), (None, None, 9), (None, None, 8)], "anonymized_id string, timestamp timestamp_ntz, value int"
    )
    assert sorted(values(clean.remove_duplicates(df, order=["value"]), "value")) == [1, 5, 8]
    assert clean.remove_duplicates(df.drop("timestamp")).count() == 5


def test_outliers_flag_and_never_remove(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]] + [(None,)], "x double")
    out = clean.flag_outliers_iqr(df, ["x"])
    assert out.count() == 7 and out.filter("x_outlier").collect()[0]["x"] == 100.0
    by_rule = clean.flag_outliers(df, ["x"], bounds={"x": (-1e9, 1e9)}, domain_rules={"x": (2, None)})
    assert values(by_rule.filter("x_outlier"), "x") == [1.0]


def test_invalid_markers(spark):
    df = spark.createDataFrame([(t, float("inf")) for t in ["ok", *clean.INVALID_TOKENS]], "s string, x double")
    out = clean.handle_invalid_values(df)
    assert out.filter("s IS NOT NULL").count() == 1 and out.filter("x IS NOT NULL").count() == 0
    assert {r["column_name"]: r["replaced"] for r in clean.invalid_counts(df).collect()} == {"s": len(clean.INVALID_TOKENS), "x": 14}


def test_imputer_stores_a_value_also_without_nulls(spark):
    fitted = impute.fit_imputer(spark.createDataFrame([(1.0, "b"), (3.0, "a")], "x double, k string"), {"x": "mean", "k": "mode"})
    assert fitted.values == {"x": 2.0, "k": "a"}
    later = fitted.transform(spark.createDataFrame([(None, None)], "x double, k string")).first()
    assert (later["x"], later["k"]) == (2.0, "a")
    with pytest.raises(ValueError):
        impute.fit_imputer(later and spark.range(1).select(F.lit(1.0).alias("x")), {"x": "guess"})


def test_encoders(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "k string, y double")
    enc = encode.fit_target_encoding(df, "k", "y")
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    got = {r["k"]: r["k_encoded"] for r in enc.transform(new).collect()}
    mean = 2 / 3
    assert got["a"] == pytest.approx((1 + mean) / 3) and got["b"] == pytest.approx((1 + mean) / 2) and got["z"] == got[None] == pytest.approx(mean)
    hot = encode.fit_one_hot(df, ["k"]).transform(new)
    assert hot.columns == ["k_b"] and values(hot, "k_b") == [0, 1, 0, 0]
    assert values(encode.ordinal_encode(new, {"k": ["b", "a"]}), "k_encoded") == [1, 0, -1, -1]


def test_scaler_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, "g"), (3.0, 5.0, "h")], "x double, c double, k string")
    z = scale.fit_standard(df, ["x", "c"]).transform(df).collect()
    assert [r["c"] for r in z] == [0.0, 0.0] and sum(r["x"] for r in z) == pytest.approx(0)
    m = scale.fit_min_max(df, ["x", "c"], (-1, 1)).transform(df).collect()
    assert [r["x"] for r in m] == [-1.0, 1.0] and [r["c"] for r in m] == [-1.0, -1.0]
    g = scale.fit_group_standard(df, ["x"], "k")
    assert values(g.transform(df), "x") == [0.0, 0.0]
    assert values(g.transform(spark.createDataFrame([(9.0, "new")], "x double, k string")), "x") == [None]


def test_etl_round_trip_and_batch_independence(spark, tmp_path):
    rows = [(f"p{i % 3}", T0 + dt.timedelta(hours=i), None if i % 5 == 0 else float(i % 17), "abc"[i % 3], float(i % 2)) for i in range(90)]
    df = spark.createDataFrame(rows, "anonymized_id string, timestamp timestamp_ntz, hr double, level string, target double")
    config = etl.EtlConfig(
        outlier_columns=["hr"], impute={"hr": "median"}, target_column="target", target_encode_columns=["level"], one_hot_columns=[],
        ordinal={"level": ["a", "b", "c"]}, group_scale_columns=["hr"],
    )
    fitted = etl.fit_etl(df, config)
    whole = sorted(map(str, fitted.transform(df).collect()))
    assert whole == sorted(map(str, fitted.transform(df.repartition(5)).collect()))
    parts = fitted.transform(df.limit(0)).unionByName(fitted.transform(df.filter("hr < 8"))).unionByName(fitted.transform(df.filter("NOT coalesce(hr < 8, false)")))
    assert whole == sorted(map(str, parts.collect()))
    fitted.save(str(tmp_path / "etl"))
    assert whole == sorted(map(str, etl.load_etl(spark, str(tmp_path / "etl")).transform(df).collect()))
    assert fitted.stats(df.union(df.limit(10))).first()["duplicates_removed"] == 10


def test_sequences_pad_left_and_keep_the_last_rows(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(days=i), float(i), i) for i in range(5)], "id string, ts timestamp_ntz, x double, y int")
    short = etl.sequences(df, "id", "ts", ["x"], "y", 3).first()
    long = etl.sequences(df, "id", "ts", ["x"], "y", 7).first()
    assert [s[0] for s in short["sequence"]] == [2.0, 3.0, 4.0] and short["label"] == 4
    assert [s[0] for s in long["sequence"]] == [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0]


GOOD = {"survey_id": "s-1", "timestamp": "t", "responses": {"mood_score": 5}}


def check(spark, record, source="survey"):
    text = record if isinstance(record, str) else json.dumps(record)
    return validate.check_records(spark.createDataFrame([(text,)], "r string"), "r", source).first()


@pytest.mark.parametrize(
    "change, fragment",
    [
        ({"survey_id": None}, "'survey_id'"),
        ({"survey_id": "a b"}, "does not match"),
        ({"responses": {"mood_score": 11}}, "greater than the maximum of 10"),
        ({"responses": {"mood_score": 0}}, "less than the minimum of 1"),
        ({"responses": {"mood_score": 5.5}}, "is not of type 'integer'"),
        ({"responses": {"mood_score": "5"}}, "is not of type 'integer'"),
        ({"responses": {"substance_use": "x"}}, "is not one of"),
        ({"responses": {"life_events": ["loss", "x"]}}, "life_events.1"),
        ({"responses": {"free_text_response": "x" * 5001}}, "too long"),
        ({"responses": {"other": 1}}, "additional properties not allowed: other"),
        ({"responses": 3}, "is not of type 'object'"),
        ({"extra": 1}, "additional properties not allowed: extra"),
    ],
)
def test_each_survey_rule(spark, change, fragment):
    row = check(spark, {**GOOD, **change})
    assert not row["is_valid"] and any(fragment in e for e in row["errors"]), row["errors"]


def test_valid_records_and_missing_fields(spark):
    assert check(spark, GOOD)["is_valid"] and check(spark, {**GOOD, "responses": {"mood_score": 5.0}})["is_valid"]
    missing = check(spark, {"timestamp": "t"})["errors"]
    assert sorted(missing) == ["Field 'root': 'responses' is a required property", "Field 'root': 'survey_id' is a required property"]
    assert check(spark, "{oops")["errors"] == ["Field 'root': is not valid JSON"]
    with pytest.raises(ValueError):
        check(spark, GOOD, "fax")


def test_nested_record_rules_and_warnings(spark):
    emr = {
        "record_id": "r1", "timestamp": "t", "record_type": "diagnosis", "diagnoses": [{"code": "F32.1", "description": "d"}, {"code": "f"}],
        "hospitalizations": [{"admission_date": "d", "involuntary": True}], "risk_factors": {"suicide_attempts": 1},
    }
    row = check(spark, emr, "emr")
    assert row["errors"] == ["Field 'diagnoses.1.code': does not match '^[A-Z0-9.]+$'", "Field 'diagnoses.1': 'description' is a required property"] or set(
        row["errors"]
    ) == {"Field 'diagnoses.1.code': does not match '^[A-Z0-9.]+$'", "Field 'diagnoses.1': 'description' is a required property"}
    assert row["warnings"] == ["Critical: History of suicide attempts", "Critical: History of involuntary hospitalization"]
    wear = {"device_id": "d", "start_timestamp": "a", "end_timestamp": "b", "metrics": {}, "data_quality": {"completeness_percent": 50, "wear_time_minutes": 100}}
    assert check(spark, wear, "wearable")["warnings"] == ["Low data completeness: 50%", "Low wear time: 100 minutes"]
    assert check(spark, {**GOOD, "responses": {}})["warnings"] == ["Survey has no responses"]


def test_hashes_and_redaction(spark):
    df = spark.createDataFrame([("user1", "mail a@b.example, call 555-123-4567"), ("", "ip 10.0.0.1"), (None, None)], "id string, note string")
    out = privacy.redact(df.withColumn("h", privacy.hash_identifier("id", "salt")), "note").collect()
    assert out[0]["h"] == hashlib.sha256(b"user1salt").hexdigest() and out[1]["h"] == out[2]["h"] == ""
    by_hash = {r["h"][:3]: r for r in out}
    assert out[0]["note"] == "mail [REDACTED], call [REDACTED]" and out[0]["redaction_count"] == 2
    assert by_hash and out[1]["note"] == "ip [REDACTED]" and out[2]["note"] is None and out[2]["redaction_count"] == 0


def test_nested_anonymize_ignores_missing_paths(spark):
    df = spark.sql("SELECT named_struct('p', named_struct('id', 'x'), 'n', 'a@b.example') AS r")
    row = privacy.anonymize_nested(df, ["r.p.id", "r.q.id", "z.id"], ["r.n"], "s").first()["r"]
    assert row["p"]["id"] == hashlib.sha256(b"xs").hexdigest() and row["n"] == "[REDACTED]"


def test_consent_rule_order(spark):
    consents = spark.createDataFrame(
        [("ok", ["a", "b"], None, None), ("rev", ["a"], T0, T0), ("exp", ["a"], T0, None), ("few", ["a"], None, None)],
        "anonymized_id string, data_types array<string>, expires_at timestamp_ntz, revoked_at timestamp_ntz",
    )
    asks = spark.createDataFrame([(i, ["a", "b"]) for i in ("ok", "rev", "exp", "few", "none")], "anonymized_id string, data_types array<string>")
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    got = {r["anonymized_id"]: r["consent_status"] for r in consent.consent_status(asks, consents, now).collect()}
    assert got == {"ok": "valid", "rev": "revoked", "exp": "expired", "few": "not_found", "none": "not_found"}
    passed, rejected = consent.consent_gate(asks, consents, now)
    assert passed.count() == 1 and rejected.count() == 4


def test_sentiment(spark):
    df = spark.createDataFrame([("I am happy but anxious!!",), ("I can't go on, so SAD",), ("",), (None,)], "text_response string")
    a, b, c, d = emotion_columns(analyze_sentiment(df)).collect()
    assert a["sentiment_valence"] == 0.0 and a["sentiment_arousal"] == 1.0 and not a["crisis_flag"]
    assert b["crisis_keywords"] == "can't go on" and b["sentiment_valence"] == -1.0 and b["sentiment_dominance"] == 0.0
    for r in (c, d):
        assert (r["sentiment_valence"], r["sentiment_arousal"], r["crisis_flag"], r["crisis_keywords"]) == (0.0, 0.0, False, None)


def test_bins_levels_and_weekdays(spark):
    edges = [float("-inf"), 10, 20]
    df = spark.createDataFrame([(-5.0,), (10.0,), (10.5,), (20.0,), (20.1,), (None,)], "x double")
    assert values(df.select(fn.bin_right_closed(F.col("x"), edges, ["a", "b"]).alias("b")), "b") == ["a", "a", "b", "b", None, None]
    s = spark.createDataFrame([(-1.0,), (25.0,), (25.01,), (75.0,), (101.0,), (None,)], "s double")
    assert values(s.select(fn.risk_level(F.col("s")).alias("l")), "l") == ["low", "low", "moderate", "high", "critical", None]
    monday = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 05:00:00' AS t")
    assert monday.select(*[c.alias(n) for n, c in fn.calendar_parts(F.col("t")).items()]).first()["weekday"] == 0


def test_artifacts_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from tidemark.plans import registry
    from tidemark.sources import files

    rows = spark.range(4000).selectExpr("id AS doc_id", "sha2(CAST(id AS STRING), 512) AS text")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    assert files.parts_for(documents, 4) == 4  # a small table
    assert files.parts_for(documents, 4, 20_000) == -(-size // 20_000) > 10
    assert files.parts_for(documents.limit(0), 4) == 4
    own = files.parts_for
    monkeypatch.setattr(files, "parts_for", lambda df, least: own(df, least, 20_000))
    found = registry.jobs()["s11_artifact_inventory"](spark, str(tmp_path)).first()
    assert (found["n_files"], found["bad_hashes"], found["empty_files"]) == (-(-size // 20_000), 0, 0)
