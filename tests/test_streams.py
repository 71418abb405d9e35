"""Streams: restart from a checkpoint, late rows, repeated batches, equality with batch."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id string, kind string, ts timestamp_ntz, value double"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def minute(n):
    return T0 + dt.timedelta(minutes=n)


def test_restart_late_rows_and_batch_equality(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    early = [("a", "x", minute(i), 1.0) for i in range(30)]
    put(spark, src, early)

    def run():
        stream = jobs.event_time(spark.readStream.schema(SCHEMA).parquet(src))
        return jobs.run_to_files(jobs.rate_per_window(stream, "kind"), out, ck)

    run()
    later = [("a", "x", minute(60), 1.0)]
    put(spark, src, later)
    run()
    put(spark, src, [("late", "x", minute(1), 1.0), ("a", "x", minute(120), 1.0)])
    query = run()
    assert jobs.rows_dropped_late(query) == 1
    got = {(r["window_start"], r["n"]) for r in spark.read.parquet(out).collect()}
    rows = spark.createDataFrame(early + later, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["window_start"], r["n"]) for r in jobs.rate_per_window(rows, "kind").collect()}
    assert got == want


def test_latest_table_survives_repeated_batches(spark, tmp_path):
    t = jobs.LatestTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], ["ts"])
    first = spark.createDataFrame([("a", "x", minute(1), 1.0), ("b", "x", minute(1), 2.0)], SCHEMA)
    second = spark.createDataFrame([("a", "x", minute(2), 3.0), ("a", "x", minute(0), 9.0)], SCHEMA)
    t.write_batch(first, 0)
    t.write_batch(second, 1)
    t.write_batch(second, 1)
    assert {r["id"]: r["value"] for r in t.read().collect()} == {"a": 3.0, "b": 2.0}
    assert {r["id"]: r["value"] for r in t.compact(str(tmp_path / "c")).read().collect()} == {"a": 3.0, "b": 2.0}


def test_hold_is_reset_by_a_clear_reading_and_fires_once(spark, tmp_path):
    src = str(tmp_path / "readings")
    rows = [("k", minute(10 * i), v) for i, v in enumerate([9.0, 9.0, 1.0, 9.0, 9.0, 9.0, 9.0, 1.0, 9.0])]
    spark.createDataFrame(rows, "key string, at timestamp, value double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key string, at timestamp, value double").parquet(src)
    jobs.run_to_files(jobs.held_above(stream, 5.0, 20 * 60), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [(r["started_at"], r["fired_at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(minute(0), minute(20)), (minute(30), minute(50))]
