"""Checked queries: streams replayed from the given files, compared with their batch answer.

A window is emitted once the watermark (newest event − 10 minutes) has passed its end, so
the SQL twins keep the windows that end before it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.common import alert_flag, review_flag
from tidemark.plans.queries_prepare import CONSENT_SQL, consents, now
from tidemark.plans.registry import query
from tidemark.session import scratch_folder
from tidemark.streaming import jobs

MARK = "wm AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)"


def stream(t, table="events"):
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


def finish(t, df, name):
    path = scratch_folder(t.spark, name)
    jobs.run_to_files(df, f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


@query(
    "r1_rate_per_window",
    "window_start:t event_type:s n:l per_second:d",
    f"""WITH {MARK} SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2024-01-01') AS window_start, event_type, count(*) AS n, count(*) / 300.0 AS per_second FROM events, wm
    WHERE time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2024-01-01') + INTERVAL 5 MINUTE <= wm GROUP BY 1, 2""",
)
def _(t):
    return finish(t, jobs.rate_per_window(jobs.event_time(stream(t)), "event_type"), "r1")


@query(
    "r2_sliding_day_totals",
    "window_end:t event_type:s n:l",
    f"""WITH {MARK}, e AS (SELECT event_type, date_trunc('hour', ts) + to_hours(CAST(k AS INTEGER)) AS window_end FROM events, range(1, 25) r(k))
    SELECT window_end, event_type, count(*) AS n FROM e, wm WHERE window_end <= wm GROUP BY 1, 2""",
)
def _(t):
    return finish(t, jobs.sliding_totals(jobs.event_time(stream(t)), "event_type"), "r2")


@query(
    "r3_latency_quantiles",
    "window_start:t p50:d p95:d n:l",
    f"""WITH {MARK} SELECT date_trunc('day', ts) AS window_start, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events, wm
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= wm GROUP BY 1""",
)
def _(t):
    return finish(t, jobs.latency_quantiles(jobs.event_time(stream(t)), "value", length="1 day"), "r3")


@query(
    "r4_share_per_window",
    "window_start:t n:l hits:l share:d",
    f"""WITH {MARK} SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (value > 75) AS hits, count(*) FILTER (value > 75) / count(*) AS share
    FROM events, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1""",
)
def _(t):
    return finish(t, jobs.share_per_window(jobs.event_time(stream(t)), F.col("value") > 75), "r4")


@query(
    "r4_drop_against_yesterday",
    "hour:t n:l n_yesterday:l",
    """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1)
    SELECT a.hour, a.n, b.n AS n_yesterday FROM h a JOIN h b ON a.hour = b.hour + INTERVAL 24 HOUR WHERE a.n < 0.5 * b.n""",
)
def _(t):
    return jobs.drop_against_yesterday(t.events)


@query(
    "r5_threshold_held",
    "key:s started_at:t fired_at:t",
    f"""WITH {MARK}, r AS (SELECT CAST(user_id % 4 AS VARCHAR) AS key, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 2 HOUR AS at_time, avg(value) AS v FROM events GROUP BY 1, 2),
    e AS (SELECT r.* FROM r, wm WHERE at_time <= wm), i AS (SELECT *, sum((v <= 55)::INT) OVER (PARTITION BY key ORDER BY at_time) AS g FROM e),
    s AS (SELECT key, g, min(at_time) FILTER (v > 55) AS started_at FROM i GROUP BY 1, 2 HAVING min(at_time) FILTER (v > 55) IS NOT NULL),
    m AS (SELECT max(at_time) AS m FROM e), c AS (SELECT s.key, started_at, (SELECT min(at_time) FROM e WHERE e.key = s.key AND e.at_time > started_at AND e.v <= 55) AS cleared FROM s)
    SELECT key, started_at, started_at + INTERVAL 4 HOUR AS fired_at FROM c, m WHERE started_at + INTERVAL 4 HOUR <= coalesce(cleared, m)""",
)
def _(t):
    means = jobs.window_means(jobs.event_time(stream(t)).withColumn("bucket", F.col("user_id") % 4), "bucket", "value")
    path = scratch_folder(t.spark, "r5-means")
    jobs.run_to_files(means, f"{path}/out", f"{path}/checkpoint")
    readings = t.spark.readStream.schema(means.schema).parquet(f"{path}/out")
    return finish(t, jobs.held_above(readings, 55.0, 4 * 3600), "r5")


@query(
    "r6_latest_feature_upsert",
    "user_id:l event_type:s value:d",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
)
def _(t):
    path = scratch_folder(t.spark, "r6")
    schema = "user_id BIGINT, event_type STRING, ts TIMESTAMP_NTZ, event_id BIGINT, value DOUBLE"
    table = jobs.LatestTable(t.spark, f"{path}/online", schema, ["user_id", "event_type"], ["ts", "event_id"])
    table.sink(stream(t).select("user_id", "event_type", "ts", "event_id", "value"), f"{path}/checkpoint").awaitTermination()
    return table.compact(f"{path}/compacted").read()


@query(
    "r7_overdue_cases",
    "case_id:l created_at:t escalated_at:t",
    f"""WITH wm AS (SELECT least(max(ts) FILTER (event_type = 'signup'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 10 MINUTE AS wm FROM events),
    o AS (SELECT event_id AS case_id, ts FROM events WHERE event_type = 'signup'),
    d AS (SELECT event_id - 3 AS case_id, ts FROM events WHERE event_type = 'purchase')
    SELECT o.case_id, o.ts AS created_at, o.ts + INTERVAL 1 HOUR AS escalated_at FROM o, wm WHERE o.ts + INTERVAL 1 HOUR < wm
      AND NOT EXISTS (SELECT 1 FROM d WHERE d.case_id = o.case_id AND d.ts BETWEEN o.ts AND o.ts + INTERVAL 1 HOUR)""",
)
def _(t):
    events = stream(t)
    created = events.filter("event_type = 'signup'").select(F.col("event_id").alias("case_id"), F.col("ts").alias("created_at"))
    done = stream(t).filter("event_type = 'purchase'").select((F.col("event_id") - 3).alias("case_id"), F.col("ts").alias("completed_at"))
    # the join's watermark is the slower of its two sides
    return finish(t, jobs.overdue_cases(jobs.event_time(created, "created_at"), jobs.event_time(done, "completed_at"), 1), "r7")


@query("r8_event_dedup", "user_id:l n:l", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(t):
    twice = stream(t).select("user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = jobs.first_events(jobs.event_time(twice), ["user_id", "ts"])
    return finish(t, once.select("user_id", "ts"), "r8").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "r9_consent_gate_on_stream",
    "o_orderkey:l consent_status:s",
    f"WITH {CONSENT_SQL} SELECT o_orderkey, consent_status FROM st",
)
def _(t):
    both = F.array(F.lit("survey"), F.lit("wearable"))
    asks = stream(t, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("anonymized_id"), F.when(F.col("o_orderstatus") == "F", both).otherwise(F.array(F.lit("survey"))).alias("data_types")
    )
    return finish(t, jobs.gated(asks, consents(t), now()).select("o_orderkey", "consent_status"), "r9")


@query(
    "r10_z4_streaming_score_and_route",
    "sink:s n:l mean_score:d",
    """WITH s AS (SELECT least(o_totalprice / 5000, 100) AS s, o_orderkey % 10 < 2 AS unsure FROM orders)
    SELECT 'alerts' AS sink, count(*) AS n, avg(s) AS mean_score FROM s WHERE s > 75 UNION ALL SELECT 'reviews', count(*), avg(s) FROM s WHERE s > 75 OR unsure""",
)
def _(t):
    path = scratch_folder(t.spark, "r10")

    def scorer(batch):
        risk = F.least(F.col("o_totalprice") / 5000, F.lit(100.0))
        sure = F.when(F.col("o_orderkey") % 10 < 2, F.lit(0.1)).otherwise(F.lit(0.9))
        return batch.select("o_orderkey", risk.alias("risk_score"), alert_flag(risk).alias("alert"), review_flag(risk, sure).alias("requires_human_review"))

    jobs.score_and_route(stream(t, "orders"), scorer, f"{path}/alerts", f"{path}/reviews", f"{path}/checkpoint").awaitTermination()
    parts = [t.spark.read.parquet(f"{path}/{s}").agg(F.lit(s).alias("sink"), F.count("*").alias("n"), F.avg("risk_score").alias("mean_score")) for s in ("alerts", "reviews")]
    return parts[0].unionByName(parts[1])


@query(
    "r12_late_rows_dropped",
    "window_start:t event_type:s n:l",
    f"""WITH {MARK} SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events, wm
    WHERE ts >= TIMESTAMP '2024-01-15' AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1, 2""",
)
def _(t):
    # the newer half arrives first, so the older half is behind the watermark when it comes
    path = scratch_folder(t.spark, "r12")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (t.events.filter(F.col("ts") >= cut), t.events.filter(F.col("ts") < cut)):
        part.write.mode("append").parquet(f"{path}/in")
        rows = jobs.event_time(t.spark.readStream.schema(t.events.schema).parquet(f"{path}/in"))
        jobs.run_to_files(jobs.rate_per_window(rows, "event_type", minutes=60), f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out")


@query("r11_audit_append", "event_type:s n:l", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = scratch_folder(t.spark, "r11")
    entries = stream(t).select("event_type", F.col("user_id").alias("anonymized_id"), F.col("ts").alias("timestamp"))
    jobs.run_to_files(entries, f"{path}/log", f"{path}/checkpoint", "json")
    log = t.spark.read.schema("event_type STRING, anonymized_id BIGINT").json(f"{path}/log")
    return log.groupBy("event_type").agg(F.count("*").alias("n"))
