"""Order-dependent helpers: both forms agree with plain Python, whatever the partitioning or skew."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered

START = dt.datetime(2024, 1, 1)


def skewed(spark, n=600, parts=7):
    """Rows of which a third belong to one id, spread over several days, with gaps and equal values."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        who = "hot" if i % 3 == 0 else f"id{rng.randrange(20)}"
        value = None if rng.random() < 0.3 else float(rng.randrange(40))
        rows.append((who, START + dt.timedelta(minutes=37 * i), i, value, rng.random() < 0.6))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, seq int, value double, flag boolean").repartition(parts)
    return rows, df


def by_id(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_quantiles(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["q"] for r in ordered.exact_quantiles(df, ["id"], "value", [0.0, 0.25, 0.5, 1.0]).collect()}
    for who, items in by_id(rows).items():
        v = sorted(r[3] for r in items if r[3] is not None)
        if not v:
            continue
        want = []
        for p in (0.0, 0.25, 0.5, 1.0):
            h = (len(v) - 1) * p
            lo, hi = int(h), min(int(h) + (h > int(h)), len(v) - 1)
            want.append(v[lo] + (v[hi] - v[lo]) * (h - lo))
        assert got[who] == pytest.approx(want)


def test_running_totals_both_directions(spark):
    df = spark.createDataFrame([("a", float(v), v % 3 + 1) for v in range(200)], "k string, v double, n long")
    up = {r["v"]: r["cum_n"] for r in ordered.running_totals(df, ["k"], "v", ["n"]).collect()}
    down = {r["v"]: r["cum_n"] for r in ordered.running_totals(df, ["k"], "v", ["n"], descending=True).collect()}
    assert up[10.0] == sum(v % 3 + 1 for v in range(11)) and down[190.0] == sum(v % 3 + 1 for v in range(190, 200))


@pytest.mark.parametrize("limit", [None, 1, 3])
@pytest.mark.parametrize("backward", [False, True])
def test_fill(spark, limit, backward):
    rows, df = skewed(spark)
    got = {(r["id"], r["seq"]): r["value"] for r in ordered.forward_fill(df, "id", "ts", ["value"], ["seq"], limit, backward).collect()}
    for who, items in by_id(rows).items():
        last, age = None, 0
        for r in items[::-1] if backward else items:
            if r[3] is not None:
                last, age = r[3], 0
            else:
                age += 1
            want = r[3] if r[3] is not None else (last if limit is None or age <= limit else None)
            assert got[who, r[2]] == want


def test_fill_over_all_rows_crosses_ids(spark):
    df = spark.createDataFrame([("a", START, 1.0), ("b", START + dt.timedelta(days=3), None)], "id string, ts timestamp_ntz, value double")
    assert {r["id"]: r["value"] for r in ordered.forward_fill(df, None, "ts", ["value"]).collect()} == {"a": 1.0, "b": 1.0}
    assert {r["id"]: r["value"] for r in ordered.forward_fill(df, "id", "ts", ["value"]).collect()} == {"a": 1.0, "b": None}


def test_successive_differences(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r for r in ordered.successive_differences(df, "id", "ts", "value", ("seq",)).collect()}
    for who, items in by_id(rows).items():
        v = [r[3] for r in items if r[3] is not None]
        d = [b - a for a, b in zip(v, v[1:])]
        assert (got[who]["n_diff"], got[who]["sum_sq_diff"]) == (len(d), pytest.approx(sum(x * x for x in d)))


def test_longest_run(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["run"] for r in ordered.longest_run(df, "id", "ts", F.col("flag"), "run", ["seq"]).collect()}
    for who, items in by_id(rows).items():
        best = now = 0
        for r in items:
            now = now + 1 if r[4] else 0
            best = max(best, now)
        assert got[who] == best


def test_trailing_and_latest(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["n"] for r in ordered.trailing(df, "id", "ts", 2).groupBy("id").agg(F.count("*").alias("n")).collect()}
    last = {r["id"]: r["seq"] for r in ordered.latest_per_key(df, ["id"], ["ts", "seq"]).collect()}
    for who, items in by_id(rows).items():
        end = items[-1][1]
        assert got[who] == sum(r[1] >= end - dt.timedelta(days=2) for r in items) and last[who] == items[-1][2]


def test_hash_rank_and_order_index(spark):
    _, df = skewed(spark)
    ranks = ordered.hash_rank(df, ["flag"], ["seq"], 3, "r")
    for flag in (True, False):
        n = df.filter(F.col("flag") == flag).count()
        assert sorted(r["r"] for r in ranks.filter(F.col("flag") == flag).collect()) == list(range(1, n + 1))
    filled = df.fillna(0.0, ["value"])
    placed = sorted((r["at"], r["value"]) for r in ordered.order_index(filled, "value", ["seq"], "at").collect())
    assert [p[0] for p in placed] == list(range(600)) and [p[1] for p in placed] == sorted(p[1] for p in placed)


def test_hash_rank_is_a_repeatable_order_per_key(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(500)], "k string, i int")
    ranked = ordered.hash_rank(df.repartition(7), ["k"], ["i"], 5, "r").collect()
    again = {r["i"]: r["r"] for r in ordered.hash_rank(df.repartition(2), ["k"], ["i"], 5, "r").collect()}
    assert {r["i"]: r["r"] for r in ranked} == again
    for key in ("a", "b"):
        own = sorted(r["r"] for r in ranked if r["k"] == key)
        assert own == list(range(1, len(own) + 1))


def test_a_hot_id_is_split_within_a_day(spark):
    """One id with a third of all rows, all on one day, lies in several ranges; so do its values."""
    rows = [("hot" if i % 3 == 0 else f"id{i % 50}", START + dt.timedelta(seconds=i), i, float(i) if i % 4 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz, seq int, value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordered.in_ranges(df, ["id", "ts", "seq"]).groupBy("id").agg(F.count_distinct("_range").alias("n"), F.count("*").alias("rows"))
        filled = ordered.forward_fill(df, "id", "ts", ["value"], ["seq"]).filter("id = 'hot'")
        diffs = ordered.successive_differences(df, "id", "ts", "value", ("seq",)).filter("id = 'hot'").first()
        cut = ordered.exact_quantiles(df, ["id"], "value", [0.3]).filter("id = 'hot'").first()["q"][0]
        assert parts.filter("id = 'hot'").first()["n"] > 1
        assert filled.filter("value IS NULL").count() == 1 and filled.count() == 1000  # nothing comes before the first
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    v = [float(i) for i in range(0, 3000, 3) if i % 4]
    assert diffs["n_diff"] == len(v) - 1 and diffs["sum_diff"] == v[-1] - v[0]
    assert cut == pytest.approx(statistics.quantiles(v, n=10, method="inclusive")[2])


def test_quantile_plan_searches_no_chunks(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    plan = ordered.exact_quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Range (" not in plan  # the source itself is read when the counts are written


def test_group_agg_median(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r for r in ordered.group_agg(df, ["id"], [F.count("value").alias("n")], {"mid": F.col("value")}).collect()}
    for who, items in by_id(rows).items():
        v = [r[3] for r in items if r[3] is not None]
        assert got[who]["n"] == len(v) and got[who]["mid"] == (pytest.approx(statistics.median(v)) if v else None)


def test_scratch_folder_comes_from_the_session(tmp_path):
    from types import SimpleNamespace

    from tidemark import session as s

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: str(tmp_path) if key == "spark.checkpoint.dir" else default))
    assert s.scratch_folder(named, "x").startswith(str(tmp_path))
