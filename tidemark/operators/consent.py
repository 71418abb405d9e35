"""Consent status per request, and the gate that uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import keyed_join


def consent_status(requests: DataFrame, consents: DataFrame, now: Column, id_column: str = "anonymized_id") -> DataFrame:
    """Add ``consent_status`` and ``consent_valid`` to requests with ``data_types``.

    Rules in order: no consent row, revoked, expired, types not covered (also reported as
    "not_found"), else valid. ``consents`` holds one row per id (the latest state).
    """
    c = consents.select(
        F.col(id_column),
        F.col("data_types").alias("_granted"),
        F.col("expires_at").alias("_expires"),
        F.col("revoked_at").alias("_revoked"),
        F.lit(True).alias("_known"),
    )
    # a stream cannot be salted by its plan's size; the consent table is the static side
    j = requests.join(c, id_column, "left") if requests.isStreaming else keyed_join(requests, c, [id_column], "left")
    uncovered = F.size(F.array_except(F.coalesce("data_types", F.array().cast("array<string>")), F.col("_granted"))) > 0
    status = (
        F.when(F.col("_known").isNull(), "not_found")
        .when(F.col("_revoked").isNotNull(), "revoked")
        .when(F.col("_expires").isNotNull() & (F.col("_expires") < now), "expired")
        .when(uncovered, "not_found")
        .otherwise("valid")
    )
    out = j.withColumn("consent_status", status)
    return out.withColumn("consent_valid", F.col("consent_status") == "valid").select(
        *requests.columns, "consent_status", "consent_valid"
    )


def consent_gate(requests: DataFrame, consents: DataFrame, now: Column, id_column: str = "anonymized_id"):
    """``(passed, rejected)``: two branches of one status join."""
    checked = consent_status(requests, consents, now, id_column)
    return checked.filter("consent_valid").drop("consent_status", "consent_valid"), checked.filter("NOT consent_valid")


def covers(required: str | Column, granted: str | Column) -> Column:
    """Whether every required type is granted."""
    return F.size(F.array_except(required, granted)) == 0
