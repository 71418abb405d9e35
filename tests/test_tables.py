"""Governance, stores, lineage, runs and sources."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance as gov, monitor, recommend, runs, store, versions
from tidemark.sources import catalog, files, tables

T0 = dt.datetime(2024, 1, 1)


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def test_case_states_against_a_left_fold(spark):
    rng = random.Random(9)
    log = []
    for case in range(60):
        for i in range(rng.randrange(1, 9)):
            log.append((case, T0 + dt.timedelta(hours=11 * i + rng.randrange(5)), i, rng.choice(["assign", "start", "submit"]), rng.choice("ab")))
    df = spark.createDataFrame(log, "case_id int, ts timestamp_ntz, seq int, action string, actor string").repartition(5)
    got = {r["case_id"]: (r["status"], r["assigned_to"]) for r in gov.case_states(df, ["ts", "seq"]).collect()}
    want = {}
    for case in range(60):
        holder = status = None
        for _, _, _, action, actor in sorted((x for x in log if x[0] == case), key=lambda x: (x[1], x[2])):
            if action == "assign":
                holder, status = actor, "ASSIGNED"
            elif action == "start" and holder in (None, actor):
                holder, status = actor, "IN_REVIEW"
            elif action == "submit" and holder == actor:
                status = "COMPLETED"
        if status:
            want[case] = (status, holder)
    assert got == want


def test_queue_rules(spark):
    rows = [(1, 95.0, "PENDING", T0), (2, 85.0, "PENDING", T0 + dt.timedelta(hours=3)), (3, 99.0, "COMPLETED", T0)]
    cases = spark.createDataFrame(rows, "case_id int, risk_score double, status string, created_at timestamp_ntz")
    now = at("2024-01-01 05:00:00")
    got = {r["case_id"]: r["status"] for r in gov.escalate(cases, now).collect()}
    assert got == {1: "ESCALATED", 2: "PENDING", 3: "COMPLETED"}
    exactly = at("2024-01-01 04:00:00")
    assert {r["case_id"]: r["status"] for r in gov.escalate(cases, exactly).collect()}[1] == "PENDING"


def test_unknown_override_reviews_are_reported(spark):
    o = gov.initiate_override(spark.createDataFrame([(1,)], "override_id int"), at("2024-01-01"))
    r = spark.createDataFrame([(1, "s", "c"), (7, "s", "c")], "override_id int, supervisor_id string, comments string")
    updated, unknown = gov.review_overrides(o, r, at("2024-01-02"))
    assert updated.first()["reviewed_by_supervisor"] == "s" and [x["override_id"] for x in unknown.collect()] == [7]


def test_recommendations_in_the_row_are_those_of_all_scored_pairs(spark, tmp_path):
    people = spark.createDataFrame(
        [(i, lv, ["anxiety"], i % 2 == 0) for i, lv in enumerate(["low", "moderate", "high", "critical"] * 5)],
        "anonymized_id int, risk_level string, contributing_factors array<string>, prefers_online boolean",
    )
    catalog.load_catalog(spark, str(tmp_path / "cat"))
    full = spark.read.parquet(str(tmp_path / "cat"))
    got = {(r["anonymized_id"], r["rank"], r["resource_id"]) for r in recommend.recommend(people, full).collect()}
    pairs = {}
    for r in recommend.score_resources(recommend.with_profile_defaults(people), full).collect():
        pairs.setdefault(r["anonymized_id"], []).append((-r["relevance_score"], r["position"], r["resource_id"]))
    assert got == {(i, rank, x[2]) for i, found in pairs.items() for rank, x in enumerate(sorted(found)[:5], 1)}
    assert [r["resource_id"] for r in catalog.search(full, risk_level="critical", resource_type="crisis_line").collect()] == ["crisis_line_988", "crisis_text_line"]


def test_degradation_needs_more_than_ten_percent(spark):
    base = spark.createDataFrame([("m", "auc", 1.0), ("m", "zero", 0.0)], "model_id string, metric string, value double")
    now = spark.createDataFrame([("m", "auc", T0, 0.9), ("m", "auc", T0, 0.85), ("m", "auc", T0, 0.7), ("m", "zero", T0, -1.0)], "model_id string, metric string, ts timestamp_ntz, value double")
    got = sorted((r["current_value"], r["severity"]) for r in monitor.degradation_alerts(now, base).collect())
    assert [g for g in got if g[0] < 0.89] == [(0.7, "high"), (0.85, "medium")]


def test_feature_registry_rules(spark):
    r = store.FeatureRegistry()
    r.register(store.FeatureDefinition("a", "numeric", "x + 1", {"x": "float"}))
    r.register(store.FeatureDefinition("b", "numeric", "a * 2", {}, ("a",)))
    with pytest.raises(ValueError):
        r.register(store.FeatureDefinition("a", "numeric", "x"))
    with pytest.raises(ValueError):
        r.register(store.FeatureDefinition("c", "odd", "x"))
    with pytest.raises(ValueError):
        r.register(store.FeatureDefinition("d", "numeric", "x", {}, ("zzz",)))
    assert r.order(["b", "a"]) == ["a", "b"]
    r.definitions["a"] = store.FeatureDefinition("a", "numeric", "b", {}, ("b",))
    with pytest.raises(ValueError):
        r.order(["a"])
    r.definitions["a"] = store.FeatureDefinition("a", "numeric", "x + 1", {"x": "float"})
    df = spark.createDataFrame([("e", 1.0)], "entity_id string, x double")
    assert store.compute_features(r, ["b"], df).first()["b"] == 4.0
    with pytest.raises(ValueError):
        store.compute_features(r, ["b"], spark.createDataFrame([("e", "1")], "entity_id string, x string"))


def test_versions_deduplicate_by_content_in_any_order(spark, tmp_path):
    vs = versions.VersionStore(spark, str(tmp_path / "v"))
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "k int, s string")
    assert vs.register(a, "d", "t", at("2024-01-01")) == "1"
    assert vs.register(a.orderBy(F.desc("k")).repartition(3), "d", "t", at("2024-01-02")) == "1"
    assert vs.register(a.filter("k > 0"), "d", "t", at("2024-01-03")) == "2"
    assert vs.get("d").count() == 49 and vs.get("d", "1").count() == 50
    assert vs.statistics("d", "1").filter("key = 'unique'").first()["value"] == 50.0
    vs.track("1", "2", "filter", at("2024-01-03"))
    assert vs.lineage().count() == 1
    with pytest.raises(ValueError):
        vs.get("d", "9")


def test_lineage_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2, "t"), (2, 3, "t"), (3, 1, "t"), (3, 4, "t"), (4, 5, "t"), (5, 6, "t")], "input_version int, output_version int, transformation string")
    got = {r["version_id"]: r["depth"] for r in versions.traverse_lineage(edges, spark.createDataFrame([(1,)], "version_id int")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_run_log(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "runs"))
    log.start_run("exp", "r1", T0)
    with pytest.raises(RuntimeError):
        log.start_run("exp", "r2", T0)
    log.log_metrics({"auc": 0.5}, T0, step=1)
    log.log_metrics({"auc": 0.7}, T0, step=2)
    log.log_params({"c": 1}, T0)
    log.end_run(T0 + dt.timedelta(hours=1))
    assert log.runs().first()["status"] == "FINISHED"
    wide = runs.compare_runs(log.runs(), log.table("metrics"), ["auc"]).first()
    assert wide["metric_auc"] == 0.7
    with pytest.raises(ValueError):
        log.create_experiment("exp", T0)


def test_metric_without_steps_shows_the_first_value(spark):
    m = spark.createDataFrame([("r", "a", 1.0, None, T0), ("r", "a", 2.0, None, T0 + dt.timedelta(1))], "run_id string, metric string, value double, step int, ts timestamp_ntz")
    r = spark.createDataFrame([("r",)], "run_id string")
    assert runs.compare_runs(r, m, ["a"]).first()["metric_a"] == 1.0


def test_log_scan_skips_and_counts_bad_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    good = spark.createDataFrame([("a", None), ("b", T0)], "event_type string, timestamp timestamp_ntz")
    files.append_json_lines(good, path, now="2024-02-01 00:00:00")
    spark.createDataFrame([("{broken",), ('{"event_type":"c"}',), ('{"event_type":"d","timestamp":"nope"}',)], "value string").write.mode("append").text(path)
    log = files.read_log(spark, path, "event_type STRING, timestamp STRING")
    assert log.filter("_bad").count() == 3
    assert {r["event_type"]: r["timestamp"] for r in files.good_lines(log).collect()} == {"a": dt.datetime(2024, 2, 1), "b": T0}


def test_upsert_and_lookup(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ts int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, ts int")
    assert {r["k"]: r["v"] for r in tables.upsert(old, new, ["k"], ["ts"]).collect()} == {1: "a", 2: "c", 3: "d"}
    keys = spark.createDataFrame([(1,), (9,)], "k int")
    assert tables.match_counts(old, keys, ["k"], F.col("v") == "a").first().asDict() == {"requested": 2, "matched": 1}
    assert [r["k"] for r in tables.lookup(old, {"v": "b", "ts": None}).collect()] == [2]


def test_a_repeated_append_adds_no_row_and_half_batches_are_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", T0), ("b", T0)], "event_type string, timestamp timestamp_ntz")
    assert files.append_json_lines(rows, path, batch="one") and not files.append_json_lines(rows, path, batch="one")
    files.write_json(rows, f"{path}/batch-two")  # a writer that died before its marker
    read = lambda: sorted(r["event_type"] for r in files.read_log(spark, path, "event_type STRING, timestamp STRING").collect())
    assert read() == ["a", "b"]
    assert files.append_json_lines(rows.limit(1), path, batch="two") and read() == ["a", "a", "b"]
    log = runs.RunLog(spark, str(tmp_path / "runs"))
    metric = [{"run_id": "r", "metric": "m", "value": 1.0, "step": 1, "ts": T0}]
    assert log.append("metrics", metric, "x") and not log.append("metrics", metric, "x") and log.append("metrics", metric)
    assert log.table("metrics").count() == 2 and log.table("params").count() == 0


def test_two_writers_get_two_numbers(spark, tmp_path, monkeypatch):
    vs, other = (versions.VersionStore(spark, str(tmp_path / "v")) for _ in range(2))
    a = spark.range(5)
    assert vs.register(a, "d", "t", at("2024-01-01")) == "1"
    stale = vs.latest("d")
    monkeypatch.setattr(versions.VersionStore, "latest", lambda self, name: stale)  # both see version 1 as the latest
    assert vs.register(spark.range(6), "d", "t", at("2024-01-02")) == "2"
    assert other.register(spark.range(7), "d", "t", at("2024-01-02")) == "3"
    assert [other.get("d", v).count() for v in "123"] == [5, 6, 7]
    with pytest.raises(ValueError):
        other.register(spark.range(8), "d", "t", at("2024-01-03"), version="2")


def test_a_version_evaluates_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(100, numPartitions=2).mapInPandas(counted, "id long")
    vs = versions.VersionStore(spark, str(tmp_path / "v"))
    vs.register(df, "d", "t", at("2024-01-01"))
    assert seen.value == 100 and vs.get("d").count() == 100 and vs.statistics("d", "1").count() > 0
