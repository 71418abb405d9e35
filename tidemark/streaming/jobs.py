"""Structured Streaming jobs over event streams.

Every job takes a streaming (or, for checking, a batch) DataFrame and returns one; sinks are
separate. Event times are cast from zone-less to UTC timestamps once, by ``event_time``.
Rows later than the watermark are dropped and counted by Spark's progress reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.consent import consent_status
from tidemark.operators.ordered import latest_per_key

LATE_LIMIT = "10 minutes"


def event_time(df: DataFrame, column: str = "ts", late: str = LATE_LIMIT) -> DataFrame:
    """Cast the event time and set the watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def _window(df: DataFrame, ts: str, length: str, slide: str | None = None) -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)


def rate_per_window(df: DataFrame, key: str, ts: str = "ts", minutes: int = 5) -> DataFrame:
    """Events per second by key in tumbling windows."""
    counts = df.groupBy(_window(df, ts, f"{minutes} minutes").alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") / F.lit(60.0 * minutes)).alias("per_second"))


def sliding_totals(df: DataFrame, key: str, ts: str = "ts", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counts by key over a sliding window, whose length is a multiple of its slide.

    Two chained stateful aggregations: rows are counted in windows of one slide, and only these
    counts, one per key and slide, are dealt to the windows that they belong to.
    """
    if pd.Timedelta(length) % pd.Timedelta(slide):
        raise ValueError(f"{length} is not a multiple of {slide}")
    steps = df.groupBy(_window(df, ts, slide).alias("step"), key).agg(F.count("*").alias("n"))
    counts = steps.groupBy(F.window(F.window_time("step"), length, slide).alias("w"), key).agg(F.sum("n").alias("n"))
    return counts.select(F.col("w.end").alias("window_end"), key, "n")


def latency_quantiles(df: DataFrame, value: str, ts: str = "ts", length: str = "5 minutes", accuracy: int = 10000) -> DataFrame:
    """Approximate median and 95th percentile per tumbling window (a mergeable sketch)."""
    q = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95)), F.lit(accuracy))
    rows = df.groupBy(_window(df, ts, length).alias("w")).agg(q.alias("q"), F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "n")


def share_per_window(df: DataFrame, condition: Column, ts: str = "ts", length: str = "1 hour") -> DataFrame:
    """Share of rows that meet a condition per tumbling window."""
    rows = df.groupBy(_window(df, ts, length).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(condition, 1)).alias("hits"))
    return rows.select(F.col("w.start").alias("window_start"), "n", "hits", (F.col("hits") / F.col("n")).alias("share"))


def drop_against_yesterday(df: DataFrame, ts: str = "ts", factor: float = 0.5) -> DataFrame:
    """Hours with fewer than ``factor`` times the same hour's rows of the day before (batch)."""
    hourly = df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))
    before = hourly.select((F.col("hour") + F.expr("INTERVAL '24' HOUR")).alias("hour"), F.col("n").alias("n_yesterday"))
    return hourly.join(before, "hour").filter(F.col("n") < F.col("n_yesterday") * factor)


def window_means(df: DataFrame, key: str, value: str, ts: str = "ts", length: str = "2 hours") -> DataFrame:
    """``(key, at, value)``: mean per key and window, ``at`` being the window's end."""
    rows = df.groupBy(_window(df, ts, length).alias("w"), key).agg(F.avg(value).alias("value"))
    return rows.select(F.col(key).cast("string").alias("key"), F.col("w.end").alias("at"), "value")


def held_above(readings: DataFrame, limit: float, hold_seconds: int) -> DataFrame:
    """Alerts ``(key, started_at, fired_at)`` for a value above ``limit`` for the whole hold time.

    ``readings`` ``(key, at, value)`` is a stream over the files of a windowed job such as
    ``window_means``: one small row per key and window, in time order, whatever the raw
    volume of a key. A breach starts at the first reading above the limit and fires once at
    start + hold unless a reading at or below the limit comes before that time; an
    event-time timer fires it when nothing more arrives.
    """
    hold_ms = hold_seconds * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, fired = state.get if state.exists else (-1, False)
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("at_ms")
            for at, value in zip(rows["at_ms"], rows["value"]):
                if started >= 0 and not fired and at >= started + hold_ms:
                    fired = True
                    out.append((key[0], started, started + hold_ms))
                if value > limit:
                    if started < 0:
                        started, fired = int(at), False
                else:
                    started, fired = -1, False
        if started >= 0 and not fired and state.getCurrentWatermarkMs() >= started + hold_ms:
            fired = True
            out.append((key[0], started, started + hold_ms))
        if started < 0:
            if state.exists:
                state.remove()
        else:
            state.update((started, fired))
            if not fired:
                # timers fire once the watermark is past them, hence one millisecond earlier
                state.setTimeoutTimestamp(max(started + hold_ms - 1, state.getCurrentWatermarkMs()))
        yield pd.DataFrame(out, columns=["key", "started_ms", "fired_ms"])

    rows = readings.withWatermark("at", "0 seconds").select("key", "at", F.unix_millis("at").alias("at_ms"), "value")
    alerts = rows.groupBy("key").applyInPandasWithState(
        step, "key string, started_ms long, fired_ms long", "started long, fired boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return alerts.select("key", F.timestamp_millis("started_ms").alias("started_at"), F.timestamp_millis("fired_ms").alias("fired_at"))


def overdue_cases(created: DataFrame, completed: DataFrame, hours: int = 4) -> DataFrame:
    """Cases not completed within ``hours`` of creation, emitted once the watermark shows it.

    A left outer stream-stream join with a time bound: state is dropped after the bound. Both
    sides carry watermarks on ``created_at`` and ``completed_at``.
    """
    c = completed.select(F.col("case_id").alias("_case"), "completed_at")
    bound = F.expr(f"INTERVAL '{int(hours)}' HOUR")
    on = (F.col("case_id") == F.col("_case")) & (F.col("completed_at") >= F.col("created_at")) & (F.col("completed_at") <= F.col("created_at") + bound)
    joined = created.join(c, on, "left_outer")
    return joined.filter("completed_at IS NULL").select("case_id", "created_at", (F.col("created_at") + bound).alias("escalated_at"))


def first_events(df: DataFrame, keys: list[str]) -> DataFrame:
    """Events without repeats of the same key inside the watermark's delay."""
    return df.dropDuplicatesWithinWatermark(keys)


def gated(requests: DataFrame, consents: DataFrame, now: Column) -> DataFrame:
    """Streamed requests with their consent status; the consent table is read per micro-batch."""
    return consent_status(requests, consents, now)


# -- sinks -----------------------------------------------------------------------------------


def append_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    """Exactly-once file sink; with ``available_now`` it stops after the data present at start."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def run_to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", timeout: int | None = None):
    """Run a stream over what is there now and return its finished query."""
    q = append_files(df, path, checkpoint, fmt)
    q.awaitTermination(timeout) if timeout else q.awaitTermination()
    return q


class LatestTable:
    """Latest value per key as deltas, one folder per micro-batch, plus a compacted base.

    A repeated micro-batch overwrites its own folder, so retries change nothing. Reading takes
    the newest row per key over base and deltas; ``compact`` folds them into a new base.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], order: list[str]):
        self.spark, self.root, self.schema, self.keys, self.order = spark, root.rstrip("/"), schema, keys, order

    def write_batch(self, batch: DataFrame, epoch: int) -> None:
        latest_per_key(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.root}/part=delta-{epoch:012d}")

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.root)
        return latest_per_key(rows, self.keys, self.order)

    def compact(self, new_root: str) -> LatestTable:
        """Write the current state as the base of a new table and return it."""
        self.read().write.mode("overwrite").parquet(f"{new_root.rstrip('/')}/part=base")
        return LatestTable(self.spark, new_root, self.schema, self.keys, self.order)

    def sink(self, df: DataFrame, checkpoint: str):
        return df.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_and_route(df: DataFrame, scorer, alerts_path: str, reviews_path: str, checkpoint: str):
    """Score each micro-batch and write alert and review rows to their own sinks.

    ``scorer`` adds ``risk_score``, ``alert`` and ``requires_human_review``. Each batch writes
    to its own folder, so a retried batch replaces itself.
    """

    def route(batch: DataFrame, epoch: int) -> None:
        scored = scorer(batch).persist()
        try:
            scored.filter("alert").write.mode("overwrite").parquet(f"{alerts_path}/batch={epoch:012d}")
            scored.filter("requires_human_review").write.mode("overwrite").parquet(f"{reviews_path}/batch={epoch:012d}")
        finally:
            scored.unpersist()

    return df.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_dropped_late(query) -> int:
    """Rows dropped behind the watermark over all reported progress of a query."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
