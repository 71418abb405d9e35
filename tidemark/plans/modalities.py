"""The given tables seen as the modality tables the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def activity(t) -> DataFrame:
    """One row per recorded activity."""
    return t.events.select(
        F.col("user_id").alias("anonymized_id"),
        F.col("event_type").alias("activity_type"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("duration_minutes"),
        "event_id",
    )


def nights(t) -> DataFrame:
    """Sleep spans: each start is an event, its end lies 0–26 hours later by ``value``."""
    return t.events.select(
        F.col("user_id").alias("anonymized_id"),
        F.col("ts").alias("sleep_start"),
        F.timestamp_add("SECOND", F.floor(F.col("value") * 720).cast("int"), F.col("ts")).alias("sleep_end"),
        (F.col("event_id") % 5).alias("interruptions"),
    )


def readings(t) -> DataFrame:
    """Heart readings with RR interval, heart rate, steps and calories."""
    return t.events.select(
        F.col("user_id").alias("anonymized_id"),
        F.col("ts").alias("timestamp"),
        (600 + F.col("value")).alias("rr_intervals"),
        (60 + F.col("value")).alias("heart_rate"),
        F.floor(F.col("value") * 10).cast("long").alias("steps"),
        F.floor(F.col("value") * 3).cast("long").alias("calories"),
        "event_id",
    )


def sessions(t) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("anonymized_id"),
        F.col("ts").alias("session_date"),
        F.when(F.col("event_type").isin("error", "view"), "missed").otherwise("completed").alias("status"),
        "event_id",
    )


def treatment(t) -> DataFrame:
    """Scheduled and completed counts per supplier as the person."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("anonymized_id"),
        F.col("l_quantity").alias("scheduled_sessions"),
        F.floor(F.col("l_quantity") * (1 - 5 * F.col("l_discount"))).alias("completed_sessions"),
        F.col("l_returnflag").alias("intervention_type"),
        F.col("l_shipdate").alias("timestamp"),
    )


def engagement(t) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("anonymized_id"),
        F.lit(1).alias("interaction_count"),
        F.col("value").alias("session_duration_minutes"),
        (F.col("event_type") == "purchase").cast("int").alias("completed_activities"),
        F.col("ts").alias("timestamp"),
    )


def gappy(t) -> DataFrame:
    """Readings in which some cells are null, by a rule both engines can state."""
    return t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") * 2).alias("score"),
    )


GAPPY_SQL = """
gappy AS (SELECT event_id, user_id, ts,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 3 <> 0 THEN value * 2 END AS score FROM events)
"""


def responses(t) -> DataFrame:
    """Free-text answers: documents by source, with turns of conversations as a second set."""
    return t.documents.select(F.col("source").alias("anonymized_id"), F.col("text").alias("text_response"), "doc_id")


def scored_labels(t) -> DataFrame:
    """A deterministic score in (0, 1), the true label and two group columns per document."""
    d = t.documents.join(t.labels, "doc_id")
    score = F.round((F.col("n_chars") % 97) / 97.0 * 0.6 + F.col("quality") * 0.25 + 0.05, 3)
    return d.select(
        "doc_id",
        F.col("quality").alias("label"),
        score.alias("score"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
    )


SCORED_SQL = """
scored AS (SELECT d.doc_id, l.quality AS label, d.lang, d.source,
  round((d.n_chars % 97) / 97.0 * 0.6 + l.quality * 0.25 + 0.05, 3) AS score
  FROM documents d JOIN labels l USING (doc_id))
"""


def order_cases(t) -> DataFrame:
    """Orders as review cases: a 0–100 score from the price, status and times."""
    score = F.round(F.least(F.col("o_totalprice") / 5000.0, F.lit(100.0)), 2)
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("IN_REVIEW")
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("anonymized_id"),
        score.alias("risk_score"),
        status.alias("status"),
        F.concat(F.lit("rev"), (F.col("o_custkey") % 11).cast("string")).alias("assigned_to"),
        F.col("o_orderdate").alias("created_at"),
        F.when(
            F.col("o_orderstatus") == "F",
            F.timestamp_add("MINUTE", (F.col("o_orderkey") % 600).cast("int"), F.col("o_orderdate")),
        ).alias("reviewed_at"),
    )


CASES_SQL = """
cases AS (SELECT o_orderkey AS case_id, o_custkey AS anonymized_id,
  round(least(o_totalprice / 5000.0, 100.0), 2) AS risk_score,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'IN_REVIEW' END AS status,
  'rev' || CAST(o_custkey % 11 AS VARCHAR) AS assigned_to, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_minutes(CAST(o_orderkey % 600 AS INTEGER)) END AS reviewed_at
  FROM orders)
"""
