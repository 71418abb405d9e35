"""Checked queries: recommendations, audit, review queue, overrides, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import common as fn
from tidemark.operators import drift, governance as gov, monitor, recommend
from tidemark.plans import modalities as m
from tidemark.plans.queries_profile import HALVES, KS_SQL, _halves
from tidemark.plans.registry import query
from tidemark.session import scratch_folder
from tidemark.sources import catalog, files, tables

C = m.CASES_SQL
NOW_SQL = "TIMESTAMP '2001-08-02 06:00:00'"


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def now():
    return at("2001-08-02 06:00:00")

# -- recommendations -------------------------------------------------------------------------


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CATALOG_SQL = "cat(position, resource_id, resource_type, name, description, urgency, risk_levels, tags, priority) AS (VALUES " + ", ".join(
    f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', '{r[5]}', {_sql_list(r[7])}, {_sql_list(r[8])}, {r[9]})"
    for i, r in enumerate(catalog.DEFAULT_RESOURCES)
) + ")"
PROFILE_SQL = """prof AS (SELECT c_custkey AS anonymized_id,
  CASE WHEN c_acctbal < 1000 THEN 'critical' WHEN c_acctbal < 4000 THEN 'high' WHEN c_acctbal < 7000 THEN 'moderate' ELSE 'low' END AS risk_level,
  c_nationkey % 2 = 0 AS therapy, c_nationkey % 3 = 0 AS medication, c_nationkey % 5 = 0 AS support, c_custkey % 2 = 0 AS online,
  CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS grp,
  CASE c_mktsegment WHEN 'BUILDING' THEN ['Depression', 'anxiety'] WHEN 'MACHINERY' THEN ['stress'] ELSE [] END AS conditions,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN ['support', 'medit'] WHEN 'FURNITURE' THEN ['Crisis'] ELSE ['therap'] END AS factors FROM customer)"""
SCORE_SQL = f"""{CATALOG_SQL}, {PROFILE_SQL},
pairs AS (SELECT * FROM prof p JOIN cat c ON list_contains(c.risk_levels, p.risk_level)),
cond AS (SELECT anonymized_id, resource_id, sum(25 * list_contains(tags, lower(x))::INT + 10 * contains(lower(description), lower(x))::INT) AS pts
  FROM (SELECT *, unnest(conditions) AS x FROM pairs) GROUP BY ALL),
fact AS (SELECT anonymized_id, resource_id, sum(15 * contains(list_aggregate(tags, 'string_agg', '~'), lower(x))::INT + 5 * contains(lower(description), lower(x))::INT) AS pts
  FROM (SELECT *, unnest(factors) AS x FROM pairs) GROUP BY ALL),
scored AS (SELECT p.*, priority + 20 + 10 * (therapy AND resource_type = 'therapy')::INT + 5 * (NOT therapy AND resource_type IN ('support_group', 'self_help'))::INT
  + 10 * (medication AND resource_type = 'medication')::INT + 15 * (NOT support AND resource_type IN ('support_group', 'community'))::INT
  + 20 * (online AND list_has_any(tags, ['online', 'virtual', 'app']))::INT + 15 * coalesce(grp AND resource_type = 'support_group', false)::INT
  + 10 * coalesce(NOT grp AND resource_type = 'therapy', false)::INT + coalesce(cond.pts, 0) + coalesce(fact.pts, 0) AS relevance_score
  FROM pairs p LEFT JOIN cond USING (anonymized_id, resource_id) LEFT JOIN fact USING (anonymized_id, resource_id))"""


def profiles(t):
    a = F.col("c_acctbal")
    seg = F.col("c_mktsegment")
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    return t.customer.select(
        F.col("c_custkey").alias("anonymized_id"),
        F.when(a < 1000, "critical").when(a < 4000, "high").when(a < 7000, "moderate").otherwise("low").alias("risk_level"),
        F.lit(None).cast("string").alias("age_group"),
        (F.col("c_nationkey") % 2 == 0).alias("has_therapy_history"),
        (F.col("c_nationkey") % 3 == 0).alias("has_medication_history"),
        (F.col("c_nationkey") % 5 == 0).alias("has_support_system"),
        (F.col("c_custkey") % 2 == 0).alias("prefers_online"),
        F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False).alias("prefers_group"),
        F.when(seg == "BUILDING", arr("Depression", "anxiety")).when(seg == "MACHINERY", arr("stress")).otherwise(F.array().cast("array<string>")).alias("specific_conditions"),
        F.when(seg == "HOUSEHOLD", arr("support", "medit")).when(seg == "FURNITURE", arr("Crisis")).otherwise(arr("therap")).alias("contributing_factors"),
    )


@query(
    "g7_j8_j14_relevance_score",
    "anonymized_id:l resource_id:s relevance_score:d",
    f"WITH {SCORE_SQL} SELECT anonymized_id, resource_id, relevance_score FROM scored",
)
def _(t):
    return recommend.score_resources(profiles(t), catalog.default_catalog(t.spark))


RANKED = "row_number() OVER (PARTITION BY anonymized_id ORDER BY relevance_score DESC, position)"


@query(
    "g8_k1_recommend",
    "anonymized_id:l resource_id:s relevance_score:d rank:l",
    f"WITH {SCORE_SQL} SELECT anonymized_id, resource_id, relevance_score, {RANKED} AS rank FROM scored QUALIFY {RANKED} <= 5",
)
def _(t):
    return recommend.recommend(profiles(t), catalog.default_catalog(t.spark))


@query(
    "g8_recommend_immediate",
    "anonymized_id:l resource_id:s relevance_score:d rank:l",
    f"WITH {SCORE_SQL} SELECT anonymized_id, resource_id, relevance_score, {RANKED} AS rank FROM scored WHERE urgency = 'immediate' QUALIFY {RANKED} <= 5",
)
def _(t):
    return recommend.recommend(profiles(t), catalog.default_catalog(t.spark), immediate_only=True)


@query(
    "g9_f17_s12_k3_catalog_search",
    "c_custkey:l resource_id:s place:l",
    f"""WITH {CATALOG_SQL}, {PROFILE_SQL} SELECT anonymized_id AS c_custkey, resource_id, row_number() OVER (PARTITION BY anonymized_id ORDER BY priority DESC, name) AS place
    FROM prof p JOIN cat c ON list_contains(c.risk_levels, p.risk_level) WHERE list_has_any(tags, ['therapy', 'support'])""",
)
def _(t):
    from pyspark.sql import Window

    found = catalog.search(catalog.default_catalog(t.spark), tags=["therapy", "support"])
    levels = found.select("resource_id", "priority", "name", F.explode("risk_levels").alias("risk_level"))
    people = profiles(t).select(F.col("anonymized_id").alias("c_custkey"), "risk_level")
    w = Window.partitionBy("c_custkey").orderBy(F.desc("priority"), F.asc("name"))
    return people.join(levels, "risk_level").withColumn("place", F.row_number().over(w))


@query(
    "s12_loaded_catalog",
    "resource_id:s priority:l people:l",
    f"""WITH {CATALOG_SQL}, {PROFILE_SQL}, n AS (SELECT risk_level, count(*) AS n FROM prof GROUP BY 1)
    SELECT resource_id, priority, coalesce((SELECT sum(n) FROM n WHERE list_contains(cat.risk_levels, n.risk_level)), 0) AS people FROM cat""",
)
def _(t):
    path = scratch_folder(t.spark, "catalog")
    catalog.load_catalog(t.spark, path)
    loaded = catalog.search(t.spark.read.parquet(path))
    people = profiles(t).groupBy("risk_level").agg(F.count("*").alias("n"))
    levels = loaded.select("resource_id", "priority", F.explode("risk_levels").alias("risk_level"))
    return levels.join(people, "risk_level", "left").groupBy("resource_id", "priority").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("people"))


RECS_SQL = """recs AS (SELECT o_orderkey AS recommendation_id, o_custkey AS anonymized_id, o_orderdate AS recommended_at,
  (SELECT list(resource_id ORDER BY position) FROM cat)[o_orderkey % 15 + 1] AS resource_id, o_orderstatus = 'F' AS accessed, round(o_totalprice / 5000, 2) AS relevance_score FROM orders)"""


def recs(t):
    ids = F.array(*[F.lit(r[0]) for r in catalog.DEFAULT_RESOURCES])
    return t.orders.select(
        F.col("o_orderkey").alias("recommendation_id"),
        F.col("o_custkey").alias("anonymized_id"),
        F.col("o_orderdate").alias("recommended_at"),
        F.element_at(ids, (F.col("o_orderkey") % 15 + 1).cast("int")).alias("resource_id"),
        (F.col("o_orderstatus") == "F").alias("accessed"),
        F.round(F.col("o_totalprice") / 5000, 2).alias("relevance_score"),
    )


@query(
    "j2_recent_recommendations",
    "anonymized_id:l recommendation_id:l name:s urgency:s rank:l",
    f"""WITH {CATALOG_SQL}, {RECS_SQL} SELECT anonymized_id, recommendation_id, name, urgency, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY anonymized_id ORDER BY recommended_at DESC, recommendation_id DESC) AS rank FROM recs) JOIN cat USING (resource_id) WHERE rank <= 3""",
)
def _(t):
    return recommend.recent_recommendations(recs(t), catalog.default_catalog(t.spark), 3)


@query(
    "a20_access_statistics",
    "resource_id:s total:l accessed:l avg_relevance:d",
    f"WITH {CATALOG_SQL}, {RECS_SQL} SELECT resource_id, count(*) AS total, count(*) FILTER (accessed) AS accessed, avg(relevance_score) AS avg_relevance FROM recs GROUP BY 1",
)
def _(t):
    return recommend.access_statistics(recs(t))


# -- review queue ----------------------------------------------------------------------------


def cases(t):
    return m.order_cases(t).withColumn("priority", fn.review_priority(F.col("risk_score")))


CASES = C + ", q AS (SELECT *, CASE WHEN risk_score >= 90 THEN 3 WHEN risk_score >= 80 THEN 2 ELSE 1 END AS priority FROM cases)"


@query(
    "g3_f21_enqueue_cases",
    "case_id:s anonymized_id:l risk_score:d risk_level:s priority:l status:s",
    f"""WITH {CASES} SELECT 'case-' || case_id AS case_id, anonymized_id, risk_score, 'critical' AS risk_level, priority, 'PENDING' AS status FROM q WHERE risk_score > 75""",
)
def _(t):
    scored = m.order_cases(t).withColumn("risk_level", fn.risk_level(F.col("risk_score"))).withColumnRenamed("case_id", "prediction_id")
    return gov.enqueue_cases(scored, now())


@query(
    "k2_pending_queue",
    "case_id:l priority:l created_at:t",
    f"""WITH {CASES} SELECT case_id, priority, created_at FROM q WHERE status IN ('PENDING', 'ASSIGNED', 'IN_REVIEW') AND assigned_to = 'rev3'
    ORDER BY priority DESC, created_at, case_id LIMIT 200""",
)
def _(t):
    return gov.pending_cases(cases(t), "rev3", 200)


@query(
    "k2_pending_queue_whole",
    "case_id:l priority:l created_at:t",
    f"""WITH {CASES} SELECT case_id, priority, created_at FROM q WHERE status IN ('PENDING', 'ASSIGNED', 'IN_REVIEW') AND assigned_to = 'rev3'""",
)
def _(t):
    return gov.pending_cases(cases(t), "rev3")


@query(
    "a22_g14_queue_statistics",
    "section:s key:s value:d",
    f"""WITH {CASES}, s(key) AS (VALUES ('PENDING'), ('ASSIGNED'), ('IN_REVIEW'), ('COMPLETED'), ('ESCALATED'))
    SELECT 'status' AS section, s.key, count(q.case_id) AS value FROM s LEFT JOIN q ON q.status = s.key GROUP BY 2
    UNION ALL SELECT 'priority', CAST(priority AS VARCHAR), count(*) FROM q GROUP BY 2
    UNION ALL SELECT 'queue', 'pending_count', count(*) FROM q WHERE status <> 'COMPLETED'
    UNION ALL SELECT 'queue', 'overdue_count', count(*) FROM q WHERE status <> 'COMPLETED' AND date_diff('microsecond', created_at, {NOW_SQL}) / 3600e6 > 4
    UNION ALL SELECT 'queue', 'average_review_time_hours', avg(date_diff('microsecond', created_at, reviewed_at) / 3600e6) FROM q WHERE status = 'COMPLETED'
    UNION ALL SELECT 'queue', 'oldest_pending_hours', date_diff('microsecond', min(created_at), {NOW_SQL}) / 3600e6 FROM q WHERE status <> 'COMPLETED'
    UNION ALL SELECT 'models', 'active', count(*) FROM supplier WHERE s_acctbal > 5000""",
)
def _(t):
    models = t.supplier.withColumn("status", F.when(F.col("s_acctbal") > 5000, "active").otherwise("retired"))
    return gov.screening_statistics(cases(t), models, now())


@query(
    "g4_w9_escalate",
    "case_id:l status:s escalated_at:t age_hours:d",
    f"""WITH {CASES} SELECT case_id, CASE WHEN status <> 'COMPLETED' AND age_hours > 4 THEN 'ESCALATED' ELSE status END AS status,
      CASE WHEN status <> 'COMPLETED' AND age_hours > 4 THEN TIMESTAMP '1998-01-01 02:00:00' END AS escalated_at, age_hours FROM
    (SELECT *, date_diff('microsecond', created_at, TIMESTAMP '1998-01-01 02:00:00') / 3600e6 AS age_hours FROM q)""",
)
def _(t):
    now = at("1998-01-01 02:00:00")
    return gov.escalate(cases(t), now).withColumn("age_hours", gov.age_hours(now))


def case_log(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("seq"),
        F.col("l_extendedprice").alias("seq2"),
        F.when(F.col("l_returnflag") == "A", "assign").when(F.col("l_returnflag") == "N", "start").otherwise("submit").alias("action"),
        F.concat(F.lit("rev"), (F.col("l_suppkey") % 2).cast("string")).alias("actor"),
    )


# The reference behaviour stated as a plain left fold over each case's log.
FOLD_SQL = """log AS (SELECT l_orderkey AS case_id, l_shipdate AS ts, l_partkey AS seq, l_extendedprice AS seq2,
  CASE l_returnflag WHEN 'A' THEN 'assign' WHEN 'N' THEN 'start' ELSE 'submit' END AS action, 'rev' || CAST(l_suppkey % 2 AS VARCHAR) AS actor,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_extendedprice) AS rn FROM lineitem),
fold AS (SELECT case_id, rn, CASE WHEN action = 'submit' THEN NULL ELSE actor END AS holder,
    CASE action WHEN 'assign' THEN 'ASSIGNED' WHEN 'start' THEN 'IN_REVIEW' END AS status, CASE WHEN action <> 'submit' THEN ts END AS updated_at FROM log WHERE rn = 1
  UNION ALL SELECT f.case_id, l.rn,
    CASE WHEN l.action = 'assign' OR (l.action = 'start' AND f.holder IS NULL) THEN l.actor ELSE f.holder END,
    CASE WHEN l.action = 'assign' THEN 'ASSIGNED' WHEN l.action = 'start' AND coalesce(f.holder, l.actor) = l.actor THEN 'IN_REVIEW'
      WHEN l.action = 'submit' AND f.holder = l.actor THEN 'COMPLETED' ELSE f.status END,
    CASE WHEN l.action = 'assign' OR (l.action = 'start' AND coalesce(f.holder, l.actor) = l.actor) OR (l.action = 'submit' AND f.holder = l.actor) THEN l.ts ELSE f.updated_at END
  FROM fold f JOIN log l ON l.case_id = f.case_id AND l.rn = f.rn + 1)"""


@query(
    "g5_case_states",
    "case_id:l status:s assigned_to:s updated_at:t",
    f"""WITH RECURSIVE {FOLD_SQL} SELECT case_id, status, holder AS assigned_to, updated_at FROM fold
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rn DESC) = 1 AND status IS NOT NULL""",
)
def _(t):
    return gov.case_states(case_log(t), ["ts", "seq", "seq2"])


# -- audit -----------------------------------------------------------------------------------


def audit_log(t):
    """Six event types from the given tables, built by the audit shapers."""
    o = m.order_cases(t).withColumn("risk_level", F.upper(fn.risk_level(F.col("risk_score"))))
    screening = o.withColumns({"alert_triggered": fn.alert_flag(F.col("risk_score")), "requires_human_review": fn.review_flag(F.col("risk_score"))})
    reviews = o.filter("status = 'COMPLETED'").select(
        "case_id", "anonymized_id", F.col("assigned_to").alias("reviewer_id"), "created_at", F.col("risk_score").alias("original_risk_score"),
        F.element_at(F.array(F.lit("CONFIRM"), F.lit("MODIFY"), F.lit("OVERRIDE")), (F.col("case_id") % 3 + 1).cast("int")).alias("decision"),
        (F.col("case_id") % 50).cast("double").alias("review_duration_seconds"),
    )
    errors = t.events.filter("event_type = 'error'").select(
        F.col("user_id").alias("anonymized_id"), "ts", F.concat(F.lit("E"), (F.col("event_id") % 4).cast("string")).alias("error_type"),
        F.concat(F.lit("part"), (F.col("user_id") % 3).cast("string")).alias("component"),
    )
    return gov.all_events(
        [
            gov.audit_events(screening, "screening_request", F.col("created_at"), {"request_hash": ["case_id", "anonymized_id"]}),
            gov.audit_events(reviews, "human_review", F.col("created_at")),
            gov.audit_events(errors, "error", F.col("ts")),
        ]
    )


AUDIT_SQL = f"""{C}, log AS (SELECT 'screening_request' AS event_type, created_at AS timestamp, anonymized_id, risk_score, NULL AS reviewer_id,
  NULL::DOUBLE AS dur, NULL AS decision, NULL AS error_type, NULL AS component FROM cases
  UNION ALL SELECT 'human_review', created_at, anonymized_id, NULL, assigned_to, case_id % 50, ['CONFIRM', 'MODIFY', 'OVERRIDE'][case_id % 3 + 1], NULL, NULL FROM cases WHERE status = 'COMPLETED'
  UNION ALL SELECT 'error', ts, user_id, NULL, NULL, NULL, NULL, 'E' || event_id % 4, 'part' || user_id % 3 FROM events WHERE event_type = 'error'),
w AS (SELECT * FROM log WHERE timestamp BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2024-01-20')"""


@query(
    "g1_audit_events",
    "event_type:s n:l hashed:l people:l",
    f"""WITH {AUDIT_SQL} SELECT event_type, count(*) AS n, CASE WHEN event_type = 'screening_request' THEN count(*) ELSE 0 END AS hashed,
      count(DISTINCT anonymized_id) AS people FROM log GROUP BY 1""",
)
def _(t):
    return audit_log(t).groupBy("event_type").agg(
        F.count("*").alias("n"), fn.count_if(F.rlike("request_hash", F.lit("^[0-9a-f]{64}$"))).alias("hashed"), F.count_distinct("anonymized_id").alias("people")
    )


@query(
    "a23_a21_audit_report",
    "section:s key:s value:d",
    f"""WITH {AUDIT_SQL}, s AS (SELECT * FROM w WHERE event_type = 'screening_request'), r AS (SELECT * FROM w WHERE event_type = 'human_review')
    SELECT 'total' AS section, 'events' AS key, count(*)::DOUBLE AS value FROM w
    UNION ALL SELECT 'total', 'unique_individuals', count(DISTINCT anonymized_id) FROM w UNION ALL SELECT 'total', 'unique_reviewers', count(DISTINCT reviewer_id) FROM w
    UNION ALL SELECT 'screening', 'total', count(*) FROM s UNION ALL SELECT 'screening', 'alerts_triggered', count(*) FROM s WHERE risk_score > 75
    UNION ALL SELECT 'screening', 'human_reviews_required', count(*) FROM s WHERE risk_score > 75
    UNION ALL SELECT 'screening', 'level_LOW', count(*) FROM s WHERE risk_score <= 25
    UNION ALL SELECT 'screening', 'level_MODERATE', count(*) FROM s WHERE risk_score > 25 AND risk_score <= 50
    UNION ALL SELECT 'screening', 'level_HIGH', count(*) FROM s WHERE risk_score > 50 AND risk_score <= 75
    UNION ALL SELECT 'screening', 'level_CRITICAL', count(*) FROM s WHERE risk_score > 75
    UNION ALL SELECT 'review', 'total', count(*) FROM r UNION ALL SELECT 'review', 'average_duration_seconds', avg(dur) FROM r WHERE dur <> 0
    UNION ALL SELECT 'review', 'decision_' || d, (SELECT count(*) FROM r WHERE decision = d) FROM (VALUES ('CONFIRM'), ('MODIFY'), ('OVERRIDE')) v(d)
    UNION ALL SELECT 'consent', k, 0 FROM (VALUES ('total'), ('status_VALID'), ('status_EXPIRED'), ('status_REVOKED'), ('status_MISSING')) v(k)
    UNION ALL SELECT 'error', 'total', count(*) FROM w WHERE event_type = 'error'
    UNION ALL SELECT 'event_count', event_type, count(*) FROM w GROUP BY 2
    UNION ALL SELECT 'error_type', error_type, count(*) FROM w WHERE event_type = 'error' GROUP BY 2
    UNION ALL SELECT 'error_component', component, count(*) FROM w WHERE event_type = 'error' GROUP BY 2""",
)
def _(t):
    return gov.audit_report(audit_log(t), "1997-01-01", "2024-01-20")


@query(
    "g2_k4_audit_trail",
    "event_type:s timestamp:t anonymized_id:l",
    f"WITH {AUDIT_SQL} SELECT event_type, timestamp, anonymized_id FROM log WHERE anonymized_id = 42 AND timestamp >= TIMESTAMP '1996-01-01'",
)
def _(t):
    return gov.audit_trail(audit_log(t), 42, "1996-01-01")


@query(
    "a19_group_counts",
    "o_orderstatus:s o_orderpriority:s n:l",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
)
def _(t):
    return gov.group_counts(t.orders, "o_orderstatus", "o_orderpriority")


@query(
    "v17_history_filters",
    "o_orderkey:l o_orderdate:t",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""",
)
def _(t):
    return tables.history(t.orders, {"o_orderstatus": "F", "o_orderpriority": None}, "o_orderdate", "1996-01-01", "1997-06-30", ["o_orderkey"], 100)


@query(
    "v17_history_filters_whole",
    "o_orderkey:l o_orderdate:t",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'""",
)
def _(t):
    return tables.history(t.orders, {"o_orderstatus": "F", "o_orderpriority": None}, "o_orderdate", "1996-01-01", "1997-06-30", ["o_orderkey"])


# -- overrides -------------------------------------------------------------------------------


def overrides(t):
    asked = t.orders.select(
        F.col("o_orderkey").alias("override_id"), F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("anonymized_id"),
        F.concat(F.lit("clin"), (F.col("o_custkey") % 7).cast("string")).alias("clinician_id"), F.col("o_orderpriority").alias("reason"),
        F.col("o_orderdate").alias("asked_at"),
    )
    started = gov.initiate_override(asked, F.col("asked_at"))
    reviews = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("override_id"), F.lit("boss").alias("supervisor_id"), F.lit("seen").alias("comments")
    )
    return gov.review_overrides(started, reviews, now())


@query(
    "g6_override_statistics",
    "section:s key:s value:d",
    """SELECT 'reason' AS section, o_orderpriority AS key, count(*)::DOUBLE AS value FROM orders GROUP BY 2
    UNION ALL SELECT 'clinician', 'clin' || o_custkey % 7, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'supervisor', CASE WHEN o_orderstatus = 'F' THEN 'reviewed' ELSE 'pending' END, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'total', 'overrides', count(*) FROM orders UNION ALL SELECT 'unique', 'clinician_id', count(DISTINCT o_custkey % 7) FROM orders
    UNION ALL SELECT 'unique', 'case_id', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'unique', 'anonymized_id', count(DISTINCT o_custkey) FROM orders""",
)
def _(t):
    return gov.override_statistics(overrides(t)[0])


@query(
    "g16_override_events",
    "override_id:l reviewed_by_supervisor:s supervisor_notified:b",
    "SELECT o_orderkey AS override_id, CASE WHEN o_orderstatus = 'F' THEN 'boss' END AS reviewed_by_supervisor, true AS supervisor_notified FROM orders",
)
def _(t):
    return overrides(t)[0]


@query(
    "g16_pending_supervisor_reviews",
    "override_id:l clinician_id:s",
    "SELECT o_orderkey AS override_id, 'clin' || o_custkey % 7 AS clinician_id FROM orders WHERE o_orderstatus <> 'F'",
)
def _(t):
    return gov.pending_supervisor_reviews(overrides(t)[0])


@query(
    "g6_clinician_recent_overrides",
    "clinician_id:s overrides:l",
    "SELECT 'clin' || o_custkey % 7 AS clinician_id, count(*) AS overrides FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-02 06:00:00' - INTERVAL 365 DAY GROUP BY 1",
)
def _(t):
    return gov.clinician_override_counts(overrides(t)[0], now(), 365)


# -- monitoring ------------------------------------------------------------------------------


def metrics(t):
    return t.events.select(
        F.col("event_type").alias("model_id"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("metric"), "ts", "value"
    )


METRICS_SQL = """met AS (SELECT event_type AS model_id, 'm' || user_id % 4 AS metric, ts, value FROM events),
base AS (SELECT model_id, metric, avg(value) AS value FROM met WHERE ts < TIMESTAMP '2024-01-10' AND metric <> 'm3' GROUP BY 1, 2),
win AS (SELECT model_id, metric, count(*) AS data_points, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  arg_max(value, ts) AS latest FROM met WHERE ts BETWEEN TIMESTAMP '2024-01-28' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-28' GROUP BY 1, 2),
cmp AS (SELECT *, (latest - value) / value * 100 AS change_pct FROM win JOIN base USING (model_id, metric)),
al AS (SELECT met.model_id, met.metric, ts, base.value AS b, met.value AS c, abs(met.value - base.value) / base.value * 100 AS pct FROM met JOIN base USING (model_id, metric)
  WHERE (met.value - base.value) / base.value < -0.1)"""
def week():
    return at("2024-01-28")


def baselines(t):
    early = metrics(t).filter((F.col("ts") < at("2024-01-10")) & (F.col("metric") != "m3"))
    return early.groupBy("model_id", "metric").agg(F.avg("value").alias("value"))


@query(
    "a28_metric_window_summary",
    "model_id:s metric:s data_points:l mean:d std:d min:d max:d latest:d",
    f"WITH {METRICS_SQL} SELECT * FROM win",
)
def _(t):
    return monitor.window_summary(metrics(t), week())


@query(
    "j13_g11_against_baseline",
    "model_id:s metric:s baseline:d latest:d change_pct:d status:s",
    f"""WITH {METRICS_SQL} SELECT model_id, metric, value AS baseline, latest, change_pct,
      CASE WHEN abs(change_pct) < 5 THEN 'stable' WHEN change_pct > 0 THEN 'improved' ELSE 'degraded' END AS status FROM cmp""",
)
def _(t):
    return monitor.against_baseline(monitor.window_summary(metrics(t), week()), baselines(t))


@query(
    "g10_degradation_alerts",
    "model_id:s metric:s ts:t severity:s degradation_pct:d",
    f"WITH {METRICS_SQL} SELECT model_id, metric, ts, CASE WHEN pct > 20 THEN 'high' ELSE 'medium' END AS severity, pct AS degradation_pct FROM al",
)
def _(t):
    return monitor.degradation_alerts(metrics(t), baselines(t))


@query(
    "s13_alert_log",
    "model_id:s alert_type:s severity:s n:l highest:d",
    f"""WITH {METRICS_SQL}, {HALVES}, k AS ({KS_SQL}), d AS (SELECT max(statistic) AS s FROM k),
    every AS (SELECT model_id, 'performance_degradation' AS alert_type, CASE WHEN pct > 20 THEN 'high' ELSE 'medium' END AS severity, pct AS score FROM al
      UNION ALL SELECT 'm-drift', 'data_drift', 'medium', s FROM d WHERE s > 0.01)
    SELECT model_id, alert_type, severity, count(*) AS n, max(score) AS highest FROM every GROUP BY 1, 2, 3""",
)
def _(t):
    path = scratch_folder(t.spark, "alerts")
    fell = monitor.degradation_alerts(metrics(t), baselines(t)).select("model_id", "ts", "alert_type", "severity", F.col("degradation_pct").alias("score"))
    report = drift.monitor_drift(*_halves(t), ["o_totalprice", "o_custkey"], limit=0.01)
    drifted = monitor.drift_alerts(report, "data", "m-drift", week(), 0.01).select("model_id", "ts", "alert_type", "severity", F.col("drift_score").alias("score"))
    for name, alerts in (("fell", fell), ("drifted", drifted), ("fell", fell)):  # a job that is run again adds nothing
        files.append_alerts(alerts, path, name)
    log = files.read_alerts(t.spark, path, "model_id STRING, ts TIMESTAMP_NTZ, alert_type STRING, severity STRING, score DOUBLE")
    return log.groupBy("model_id", "alert_type", "severity").agg(F.count("*").alias("n"), F.max("score").alias("highest"))


@query(
    "a30_alerts_per_day",
    "day:a alerts:l",
    f"WITH {METRICS_SQL} SELECT CAST(ts AS DATE) AS day, count(*) AS alerts FROM al GROUP BY 1",
)
def _(t):
    return monitor.alerts_per_day(monitor.degradation_alerts(metrics(t), baselines(t)))


@query(
    "g12_retraining_advice",
    "model_id:s type:s priority:s reason:s",
    f"""WITH {METRICS_SQL}, n AS (SELECT model_id, count(*) AS n FROM al WHERE ts >= TIMESTAMP '2024-01-28' - INTERVAL 7 DAY GROUP BY 1),
    f AS (SELECT model_id, 'performance_degradation' AS type, 'high' AS priority, format('{{}} degraded by {{:.1f}}%', metric, abs(change_pct)) AS reason FROM cmp WHERE change_pct < -10
      UNION ALL SELECT model_id, 'high_alert_frequency', 'medium', n || ' alerts in past week' FROM n WHERE n > 10)
    SELECT * FROM f UNION ALL SELECT DISTINCT model_id, 'periodic_maintenance', 'low', 'No critical issues detected' FROM met WHERE model_id NOT IN (SELECT model_id FROM f)""",
)
def _(t):
    comparison = monitor.against_baseline(monitor.window_summary(metrics(t), week()), baselines(t))
    return monitor.retraining_advice(comparison, monitor.degradation_alerts(metrics(t), baselines(t)), metrics(t), week())


@query(
    "g12_weekly_report",
    "model_id:s metric:s data_points:l change_pct:d alert_count:l",
    f"""WITH {METRICS_SQL}, n AS (SELECT model_id, count(*) AS n FROM al WHERE ts >= TIMESTAMP '2024-01-28' - INTERVAL 7 DAY GROUP BY 1)
    SELECT win.model_id, win.metric, win.data_points, change_pct, coalesce(n, 0) AS alert_count FROM win LEFT JOIN cmp USING (model_id, metric) LEFT JOIN n USING (model_id)""",
)
def _(t):
    alerts = monitor.degradation_alerts(metrics(t), baselines(t))
    return monitor.weekly_report(metrics(t), baselines(t), alerts, week())


@query(
    "a29_prediction_stats",
    "model_id:s mean:d std:d min:d max:d median:d",
    "SELECT event_type AS model_id, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median FROM events GROUP BY 1",
)
def _(t):
    return monitor.prediction_stats(metrics(t), "value", ["model_id"])


@query(
    "a34_baseline_average",
    "model_id:s metric:s improvement:d",
    f"""WITH {METRICS_SQL}, a AS (SELECT metric, avg(value) AS v FROM base GROUP BY 1)
    SELECT model_id, win.metric, mean - v AS improvement FROM win JOIN a USING (metric)""",
)
def _(t):
    current = monitor.window_summary(metrics(t), week()).select("model_id", "metric", F.col("mean").alias("value"))
    return monitor.baseline_average(current, baselines(t))


@query(
    "g15_limitation_rules",
    "model_id:l rule:s",
    """WITH x AS (SELECT s_suppkey AS model_id, s_acctbal / 10000 AS a, (s_suppkey % 10) / 10.0 AS p, (s_suppkey % 7) / 7.0 AS r FROM supplier)
    SELECT model_id, 'low_accuracy' AS rule FROM x WHERE a < 0.8 UNION ALL SELECT model_id, 'low_recall' FROM x WHERE r < 0.7
    UNION ALL SELECT model_id, 'strong_performance' FROM x WHERE a >= 0.85 UNION ALL SELECT model_id, 'favours_precision' FROM x WHERE p > r + 0.1
    UNION ALL SELECT model_id, 'favours_recall' FROM x WHERE r > p + 0.1 UNION ALL SELECT model_id, 'linear_model' FROM x""",
)
def _(t):
    wide = t.supplier.select(
        F.col("s_suppkey").alias("model_id"), (F.col("s_acctbal") / 10000).alias("accuracy"), ((F.col("s_suppkey") % 10) / 10.0).alias("precision"),
        ((F.col("s_suppkey") % 7) / 7.0).alias("recall"), F.lit("logistic_regression").alias("model_type"),
    )
    return monitor.limitation_rules(wide)


@query(
    "g17_model_summary",
    "model_id:s m0:d m3:d bias_analysis:s top_feature:s",
    f"""WITH {METRICS_SQL}, l AS (SELECT model_id, metric, arg_max(value, ts) AS v FROM met GROUP BY 1, 2)
    SELECT model_id, max(v) FILTER (metric = 'm0') AS m0, max(v) FILTER (metric = 'm3') AS m3,
      'Demographic parity shows disparity (difference: 0.250) Equalized odds are well-maintained (difference: 0.050)' AS bias_analysis,
      arg_max(metric, v) AS top_feature FROM l GROUP BY 1""",
)
def _(t):
    models = metrics(t).select("model_id").distinct()
    parity = models.withColumns({"demographic_parity_difference": F.lit(0.25), "equalized_odds_difference": F.lit(0.05)})
    latest = metrics(t).groupBy("model_id", "metric").agg(F.max_by("value", F.struct("ts", "value")).alias("importance"))
    out = monitor.model_summary(models, metrics(t), parity, latest.withColumnRenamed("metric", "feature"))
    return out.select("model_id", F.col("metrics")["m0"].alias("m0"), F.col("metrics")["m3"].alias("m3"), "bias_analysis", F.col("top_features")[0].alias("top_feature"))
