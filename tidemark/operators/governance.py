"""Audit events, review queue, overrides and the reports over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import count_if, hours_between, review_flag, review_priority, stable_hash
from tidemark.operators.ordered import forward_fill, keyed_join, latest_per_key
from tidemark.sources.tables import history

OPEN_STATES = ("PENDING", "ASSIGNED", "IN_REVIEW")
STATES = (*OPEN_STATES, "COMPLETED", "ESCALATED")
OVERDUE_HOURS = 4.0
LEVELS = ("LOW", "MODERATE", "HIGH", "CRITICAL")
DECISIONS = ("CONFIRM", "MODIFY", "OVERRIDE")
CONSENT_STATES = ("VALID", "EXPIRED", "REVOKED", "MISSING")
# Fields each audit event type carries besides type and time.
AUDIT_FIELDS = {
    "screening_request": ["anonymized_id", "user_id", "request_hash", "response_hash", "risk_score", "risk_level", "alert_triggered", "requires_human_review"],
    "prediction": ["anonymized_id", "features_hash", "model_id", "model_version", "risk_score", "risk_level", "confidence", "ensemble_models"],
    "human_review": ["case_id", "anonymized_id", "reviewer_id", "decision", "original_risk_score", "modified_risk_score", "justification", "review_duration_seconds"],
    "consent_verification": ["anonymized_id", "data_types", "consent_status", "consent_expiry"],
    "data_access": ["anonymized_id", "user_id", "access_type", "data_types", "purpose"],
    "error": ["error_type", "error_message", "component", "anonymized_id", "context"],
}


def audit_events(df: DataFrame, event_type: str, timestamp: Column, hashes: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows shaped as one audit event type; ``hashes`` maps a field to the columns it digests.

    Fields the input does not have are left out; ``all_events`` unions types by name.
    """
    hashes = hashes or {}
    out = [F.lit(event_type).alias("event_type"), timestamp.alias("timestamp")]
    for f in AUDIT_FIELDS[event_type]:
        if f in hashes:
            out.append(stable_hash(hashes[f]).alias(f))
        elif f in df.columns:
            out.append(F.col(f))
    return df.select(*out)


def all_events(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def audit_trail(log: DataFrame, anonymized_id, start=None, end=None) -> DataFrame:
    return history(log, {"anonymized_id": anonymized_id}, "timestamp", start, end)


def audit_report(log: DataFrame, start, end, event_types: Sequence[str] | None = None) -> DataFrame:
    """Long ``(section, key, value)``: counts by type, people, and one block per event family.

    One scan with conditional aggregates for the fixed keys, one grouped count for the open
    ones (event type, error type, component).
    """
    data = log.filter(
        (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    )
    if event_types is not None:
        data = data.filter(F.col("event_type").isin(*event_types))
    for name, kind in (
        ("risk_level", "string"), ("decision", "string"), ("consent_status", "string"), ("reviewer_id", "string"),
        ("review_duration_seconds", "double"), ("alert_triggered", "boolean"), ("requires_human_review", "boolean"),
        ("error_type", "string"), ("component", "string"),
    ):
        if name not in data.columns:
            data = data.withColumn(name, F.lit(None).cast(kind))

    def of(kind):
        return F.col("event_type") == kind

    fixed: dict[tuple[str, str], Column] = {
        ("total", "events"): F.count("*"),
        ("total", "unique_individuals"): F.count_distinct("anonymized_id"),
        ("total", "unique_reviewers"): F.count_distinct("reviewer_id"),
        ("screening", "total"): count_if(of("screening_request")),
        ("screening", "alerts_triggered"): count_if(of("screening_request") & F.col("alert_triggered")),
        ("screening", "human_reviews_required"): count_if(of("screening_request") & F.col("requires_human_review")),
        ("review", "total"): count_if(of("human_review")),
        ("review", "average_duration_seconds"): F.avg(F.when(of("human_review") & (F.col("review_duration_seconds") != 0), F.col("review_duration_seconds"))),
        ("consent", "total"): count_if(of("consent_verification")),
        ("error", "total"): count_if(of("error")),
    }
    for v in LEVELS:
        fixed["screening", f"level_{v}"] = count_if(of("screening_request") & (F.upper("risk_level") == v))
    for v in DECISIONS:
        fixed["review", f"decision_{v}"] = count_if(of("human_review") & (F.col("decision") == v))
    for v in CONSENT_STATES:
        fixed["consent", f"status_{v}"] = count_if(of("consent_verification") & (F.upper("consent_status") == v))
    row = data.agg(*[e.cast("double").alias(f"{s}.{k}") for (s, k), e in fixed.items()])
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.col(f"`{s}.{k}`").alias("value")) for s, k in fixed])
    open_keys = F.array(
        F.struct(F.lit("event_count").alias("section"), F.coalesce("event_type", F.lit("unknown")).alias("key")),
        F.struct(F.lit("error_type").alias("section"), F.when(of("error"), F.col("error_type")).alias("key")),
        F.struct(F.lit("error_component").alias("section"), F.when(of("error"), F.col("component")).alias("key")),
    )
    counts = data.select(F.inline(open_keys)).filter("key IS NOT NULL").groupBy("section", "key").agg(F.count("*").cast("double").alias("value"))
    return row.select(F.inline(cells)).unionByName(counts)


# -- review queue --------------------------------------------------------------------------


def enqueue_cases(scores: DataFrame, now: Column) -> DataFrame:
    """High-risk scores as pending cases with their priority."""
    return scores.filter(review_flag(F.col("risk_score"))).select(
        F.concat_ws("-", F.lit("case"), F.col("prediction_id").cast("string")).alias("case_id"),
        "anonymized_id",
        "risk_score",
        "risk_level",
        review_priority(F.col("risk_score")).alias("priority"),
        F.lit("PENDING").alias("status"),
        now.alias("created_at"),
    )


def is_open(status: Column) -> Column:
    return status.isin(*OPEN_STATES)


def age_hours(now: Column, created: Column | None = None) -> Column:
    return hours_between(created if created is not None else F.col("created_at"), now)


def is_overdue(now: Column) -> Column:
    return is_open(F.col("status")) & (age_hours(now) > OVERDUE_HOURS)


def pending_cases(cases: DataFrame, reviewer: str | None = None, limit: int | None = None) -> DataFrame:
    """Open cases, highest priority then oldest first; optionally one reviewer's or unassigned."""
    out = cases.filter(is_open(F.col("status")))
    if reviewer is not None:
        out = out.filter(F.col("assigned_to").isNull() | (F.col("assigned_to") == reviewer))
    out = out.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("case_id"))
    return out.limit(limit) if limit is not None else out


def escalate(cases: DataFrame, now: Column) -> DataFrame:
    """Snapshot with overdue open cases set to ESCALATED and stamped."""
    overdue = is_overdue(now)
    kept = [c for c in cases.columns if c not in ("status", "escalated_at")]
    previous = F.col("escalated_at") if "escalated_at" in cases.columns else F.lit(None).cast("timestamp_ntz")
    return cases.select(
        *kept,
        F.when(overdue, F.lit("ESCALATED")).otherwise(F.col("status")).alias("status"),
        F.when(overdue, now).otherwise(previous).alias("escalated_at"),
    )


def case_states(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Current state per case from its log of ``assign`` / ``start`` / ``submit`` actions.

    An assignment always counts. A start counts when the case is free or already the
    actor's; a submit counts only for the case's assignee. The assignee at any point is the
    last assignment so far, else the first start so far, so validity needs no fold over the
    log: a chunked forward fill and one aggregate decide it, and the state is the last
    valid action.
    """
    ts, *tiebreak = order
    data = events.withColumn("_assigned", F.when(F.col("action") == "assign", F.col("actor")))
    data = forward_fill(data, "case_id", ts, ["_assigned"], tiebreak)
    position = F.struct(*order)
    first_start = events.filter("action = 'start'").groupBy("case_id").agg(
        F.min_by("actor", position).alias("_starter"), F.min(position).alias("_start_at")
    )
    j = keyed_join(data, first_start, ["case_id"], "left")
    holder = F.coalesce(F.col("_assigned"), F.when(F.col("_start_at") <= position, F.col("_starter")))
    valid = (
        F.when(F.col("action") == "assign", F.lit(True))
        .when(F.col("action") == "start", holder == F.col("actor"))
        .otherwise(F.coalesce(holder == F.col("actor"), F.lit(False)))
    )
    status = F.when(F.col("action") == "assign", "ASSIGNED").when(F.col("action") == "start", "IN_REVIEW").otherwise("COMPLETED")
    steps = j.withColumn("_valid", valid).filter("_valid").select("case_id", *order, status.alias("status"), holder.alias("assigned_to"))
    last = latest_per_key(steps, ["case_id"], order)
    return last.select("case_id", "status", "assigned_to", F.col(ts).alias("updated_at"))


def queue_statistics(cases: DataFrame, now: Column) -> DataFrame:
    """Long ``(section, key, value)``: by status (all states), by priority, and queue health."""
    cells = F.array(
        F.struct(F.lit("status").alias("section"), F.col("status").alias("key")),
        F.struct(F.lit("priority").alias("section"), F.col("priority").cast("string").alias("key")),
    )
    counts = cases.select(F.inline(cells)).groupBy("section", "key").agg(F.count("*").cast("double").alias("value"))
    opened = is_open(F.col("status"))
    done = (F.col("status") == "COMPLETED") & F.col("reviewed_at").isNotNull()
    row = cases.agg(
        count_if(opened).cast("double").alias("pending_count"),
        count_if(is_overdue(now)).cast("double").alias("overdue_count"),
        F.avg(F.when(done, hours_between(F.col("created_at"), F.col("reviewed_at")))).alias("average_review_time_hours"),
        hours_between(F.min(F.when(opened, F.col("created_at"))), now).alias("oldest_pending_hours"),
        *[F.lit(0.0).alias(f"_{s}") for s in STATES],
    )
    names = ["pending_count", "overdue_count", "average_review_time_hours", "oldest_pending_hours"]
    health = row.select(F.inline(F.array(*[F.struct(F.lit("queue").alias("section"), F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])))
    zero = row.select(F.inline(F.array(*[F.struct(F.lit("status").alias("section"), F.lit(s).alias("key"), F.col(f"_{s}").alias("value")) for s in STATES])))
    by_key = counts.unionByName(zero).groupBy("section", "key").agg(F.sum("value").alias("value"))
    return by_key.unionByName(health)


# -- overrides -------------------------------------------------------------------------------


def initiate_override(requests: DataFrame, now: Column) -> DataFrame:
    """New override rows; the supervisor is marked as notified."""
    return requests.withColumns(
        {"created_at": now, "supervisor_notified": F.lit(True), "reviewed_by_supervisor": F.lit(None).cast("string"), "supervisor_review_at": F.lit(None).cast("timestamp_ntz")}
    )


def review_overrides(overrides: DataFrame, reviews: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(updated, unknown)``: overrides with supervisor reviews applied; reviews of unknown ids."""
    r = reviews.select("override_id", F.col("supervisor_id").alias("_by"), F.col("comments").alias("supervisor_comments"))
    j = overrides.join(r, "override_id", "left")
    done = F.col("_by").isNotNull()
    updated = j.select(
        *[c for c in overrides.columns if c not in ("reviewed_by_supervisor", "supervisor_review_at")],
        F.when(done, F.col("_by")).otherwise(F.col("reviewed_by_supervisor")).alias("reviewed_by_supervisor"),
        F.when(done, now).otherwise(F.col("supervisor_review_at")).alias("supervisor_review_at"),
        "supervisor_comments",
    )
    return updated, reviews.join(overrides.select("override_id"), "override_id", "left_anti")


def override_statistics(overrides: DataFrame) -> DataFrame:
    """Long ``(section, key, value)``: totals, by reason, by clinician, review state, uniques."""
    cells = F.array(
        F.struct(F.lit("reason").alias("section"), F.col("reason").alias("key")),
        F.struct(F.lit("clinician").alias("section"), F.col("clinician_id").alias("key")),
        F.struct(
            F.lit("supervisor").alias("section"),
            F.when(F.col("reviewed_by_supervisor").isNotNull(), "reviewed").otherwise("pending").alias("key"),
        ),
        F.struct(F.lit("total").alias("section"), F.lit("overrides").alias("key")),
    )
    counts = overrides.select(F.inline(cells)).groupBy("section", "key").agg(F.count("*").cast("double").alias("value"))
    row = overrides.agg(*[F.count_distinct(c).cast("double").alias(c) for c in ("clinician_id", "case_id", "anonymized_id")])
    uniques = row.select(
        F.inline(F.array(*[F.struct(F.lit("unique").alias("section"), F.lit(c).alias("key"), F.col(c).alias("value")) for c in row.columns]))
    )
    return counts.unionByName(uniques)


def pending_supervisor_reviews(overrides: DataFrame) -> DataFrame:
    return overrides.filter(F.col("reviewed_by_supervisor").isNull()).orderBy("created_at", "override_id")


def clinician_override_counts(overrides: DataFrame, now: Column, days: int = 30) -> DataFrame:
    recent = overrides.filter(F.col("created_at") >= now - F.expr(f"INTERVAL '{int(days)}' DAY"))
    return recent.groupBy("clinician_id").agg(F.count("*").alias("overrides"))


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def screening_statistics(cases: DataFrame, models: DataFrame, now: Column) -> DataFrame:
    """Queue statistics plus the number of active models."""
    active = models.filter("status = 'active'").agg(F.count("*").cast("double").alias("value"))
    return queue_statistics(cases, now).unionByName(
        active.select(F.lit("models").alias("section"), F.lit("active").alias("key"), "value")
    )
