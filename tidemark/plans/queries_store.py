"""Checked queries: feature store, dataset versions, lineage, experiments, set operations, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import profile, runs, store, versions
from tidemark.plans import features, modalities as m
from tidemark.plans.queries_features import ACTIVITY_SQL
from tidemark.plans.registry import query
from tidemark.session import scratch_folder
from tidemark.sources import files, tables


def at(text):
    return F.lit(text).cast("timestamp_ntz")


# -- feature store ---------------------------------------------------------------------------


def _registry():
    r = store.FeatureRegistry()
    r.register(store.FeatureDefinition("net", "numeric", "l_extendedprice * (1 - l_discount)", {"l_extendedprice": "float"}))
    r.register(store.FeatureDefinition("gross", "numeric", "net * (1 + l_tax)", {"net": "float"}, ("net",)))
    r.register(store.FeatureDefinition("unit", "numeric", lambda df: df["gross"] / df["l_quantity"], {}, ("gross",)))
    r.register(store.FeatureDefinition("pair", "numeric", {"half": "net / 2", "band": "CASE WHEN net > 30000 THEN 'big' ELSE 'small' END"}, {}, ("net",)))
    return r


@query(
    "x1_x2_x3_z1_z2_f22_compute_features",
    "entity_id:s unit:d half:d band:s",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS entity_id, l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity AS unit,
      l_extendedprice * (1 - l_discount) / 2 AS half, CASE WHEN l_extendedprice * (1 - l_discount) > 30000 THEN 'big' ELSE 'small' END AS band FROM lineitem""",
)
def _(t):
    df = t.lineitem.withColumn("entity_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return store.compute_features(_registry(), ["unit", "pair"], df)


def feature_values(t):
    wide = t.events.select(F.col("user_id").alias("entity_id"), F.col("value").alias("last_value"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), "ts")
    return wide.select(
        "entity_id", "ts",
        F.inline(F.array(F.struct(F.lit("last_value").alias("feature"), F.col("last_value").cast("string").alias("value")), F.struct(F.lit("kind").alias("feature"), F.col("kind").alias("value")))),
    ).filter("value IS NOT NULL").withColumnRenamed("ts", "computed_at")


@query(
    "s9_x4_materialize",
    "feature:s n:l people:l",
    """SELECT 'last_value' AS feature, count(*) AS n, count(DISTINCT user_id) AS people FROM events
    UNION ALL SELECT 'kind', count(*), count(DISTINCT user_id) FROM events WHERE event_id % 3 = 0""",
)
def _(t):
    path = scratch_folder(t.spark, "values")
    wide = t.events.select(F.col("user_id").alias("entity_id"), F.col("value").alias("last_value"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"))
    store.append_values(store.materialize(wide, at("2024-02-01")), path)
    return t.spark.read.parquet(path).groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("people"))


@query(
    "w1_latest_feature_values",
    "entity_id:l feature:s value:s",
    """SELECT * FROM (SELECT user_id AS entity_id, 'kind' AS feature, arg_max(event_type, ts) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1
    UNION ALL SELECT user_id, 'last_value', CAST(arg_max(value, ts) AS VARCHAR) FROM events GROUP BY 1)""",
)
def _(t):
    return store.latest_values(feature_values(t))


@query(
    "x5_j9_j10_serve_latest",
    "entity_id:l last_value:d kind:s",
    """WITH a AS (SELECT user_id, arg_max(value, ts) AS v FROM events GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, ts) AS k FROM events WHERE event_id % 3 = 0 GROUP BY 1)
    SELECT c_custkey AS entity_id, v AS last_value, k AS kind FROM customer LEFT JOIN a ON a.user_id = c_custkey LEFT JOIN b ON b.user_id = c_custkey""",
)
def _(t):
    ids = t.customer.select(F.col("c_custkey").alias("entity_id"))
    return store.serve(feature_values(t), ids, ["last_value", "kind"], {"last_value": "double"})


# -- versions and lineage --------------------------------------------------------------------


@query("s7_s8_x6_x7_version_round_trip", "version:s o_orderkey:l o_totalprice:d", "SELECT '2' AS version, o_orderkey, o_totalprice FROM orders")
def _(t):
    vs = versions.VersionStore(t.spark, scratch_folder(t.spark, "versions"))
    first = t.orders.filter("o_orderstatus = 'F'")
    vs.register(first, "orders", "given", at("2024-01-01"))
    vs.register(t.orders, "orders", "given", at("2024-01-02"), parent="1")
    again = vs.register(t.orders.orderBy(F.desc("o_totalprice")), "orders", "given", at("2024-01-03"))
    return vs.get("orders").withColumn("version", F.lit(again))


@query(
    "x9_tracked_transformations",
    "input_version:s output_version:s transformation:s rows_in:l rows_out:l",
    """WITH n AS (SELECT count(*) AS n1, count(*) FILTER (o_orderstatus = 'F') AS n2, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS n3 FROM orders)
    SELECT '1' AS input_version, '2' AS output_version, 'closed' AS transformation, n1 AS rows_in, n2 AS rows_out FROM n UNION ALL SELECT '2', '3', 'large', n2, n3 FROM n""",
)
def _(t):
    vs = versions.VersionStore(t.spark, scratch_folder(t.spark, "tracked"))
    last = vs.register(t.orders, "orders", "given", at("2024-01-01"))
    for name, rule, day in (("closed", "o_orderstatus = 'F'", "2024-01-02"), ("large", "o_totalprice > 100000", "2024-01-03")):
        made = vs.register(vs.get("orders", last).filter(rule), "orders", name, at(day), parent=last)
        vs.track(last, made, name, at(day), code=rule)
        last = made
    known = versions.list_versions(vs.versions()).select("version", "n_rows")
    sizes = vs.lineage().join(known.withColumnsRenamed({"version": "input_version", "n_rows": "rows_in"}), "input_version")
    return sizes.join(known.withColumnsRenamed({"version": "output_version", "n_rows": "rows_out"}), "output_version")


VERSIONS_SQL = """v AS (SELECT p_partkey AS version_id, 'd' || p_size AS dataset_name, CAST(p_partkey AS VARCHAR) AS version,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(p_partkey AS INTEGER)) AS created_at FROM part),
e AS (SELECT p_partkey AS input_version, p_partkey + 1 + p_size AS output_version, p_type AS transformation FROM part)"""


def version_table(t):
    return t.part.select(
        F.col("p_partkey").alias("version_id"), F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("dataset_name"),
        F.col("p_partkey").cast("string").alias("version"), F.timestamp_add("MINUTE", F.col("p_partkey").cast("int"), at("2024-01-01")).alias("created_at"),
    )


def edge_table(t):
    return t.part.select(F.col("p_partkey").alias("input_version"), (F.col("p_partkey") + 1 + F.col("p_size")).alias("output_version"), F.col("p_type").alias("transformation"))


@query(
    "x8_list_datasets",
    "dataset_name:s n_versions:l latest_version:s updated_at:t",
    f"WITH {VERSIONS_SQL} SELECT dataset_name, count(*) AS n_versions, arg_max(version, created_at) AS latest_version, max(created_at) AS updated_at FROM v GROUP BY 1",
)
def _(t):
    return versions.list_datasets(version_table(t))


@query(
    "j3_x9_lineage_neighbours",
    "version_id:l related_version:l transformation:s dataset_name:s",
    f"WITH {VERSIONS_SQL} SELECT output_version AS version_id, input_version AS related_version, transformation, dataset_name FROM e JOIN v ON v.version_id = e.input_version",
)
def _(t):
    return versions.lineage_neighbours(edge_table(t), version_table(t))


@query(
    "j4_traverse_lineage",
    "root:l version_id:l depth:l",
    f"""WITH RECURSIVE {VERSIONS_SQL}, b AS (SELECT input_version AS x, output_version AS y FROM e UNION SELECT output_version, input_version FROM e),
    w AS (SELECT version_id AS root, version_id, 0 AS depth FROM v WHERE dataset_name = 'd7'
      UNION SELECT root, y, depth + 1 FROM w JOIN b ON b.x = w.version_id WHERE depth < 3)
    SELECT root, version_id, min(depth) AS depth FROM w GROUP BY 1, 2""",
)
def _(t):
    return versions.traverse_lineage(edge_table(t), version_table(t).filter("dataset_name = 'd7'"), 3)


# -- experiments -----------------------------------------------------------------------------

RUNS_SQL = """r AS (SELECT o_orderkey AS run_id, o_custkey AS experiment_id, o_orderstatus AS status, o_orderdate AS start_time, o_totalprice AS cost FROM orders),
mm AS (SELECT l_orderkey AS run_id, l_returnflag AS metric, l_extendedprice AS value, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS step, l_shipdate AS ts, l_partkey FROM lineitem)"""


def run_table(t):
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("start_time"),
        F.col("o_totalprice").alias("cost"), F.create_map(F.lit("depth"), F.col("o_orderpriority")).alias("params"),
    )


def metric_table(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("metric"), F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("step"), F.struct("l_shipdate", "l_partkey", "l_extendedprice").alias("ts"),
    )


@query(
    "j5_latest_runs",
    "experiment_id:l run_id:l experiment_name:s",
    f"""WITH {RUNS_SQL} SELECT experiment_id, run_id, c_name AS experiment_name FROM (SELECT * FROM r
      QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY start_time DESC, run_id DESC) = 1) JOIN customer ON c_custkey = experiment_id""",
)
def _(t):
    names = t.customer.select(F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("experiment_name"))
    return runs.latest_runs(run_table(t), names)


@query(
    "k6_k7_search_runs",
    "run_id:l cost:d",
    f"WITH {RUNS_SQL} SELECT run_id, cost FROM r WHERE status = 'F' AND cost > 200000 ORDER BY cost DESC, run_id LIMIT 50",
)
def _(t):
    return runs.search_runs(run_table(t), "cost > 200000", ["cost desc", "run_id"], 50, status="F")


@query(
    "x10_f19_compare_runs",
    "run_id:l status:s param_depth:s metric_A:d metric_N:d",
    f"""WITH {RUNS_SQL}, p AS (SELECT run_id, metric, coalesce(
        (arg_max(value, (step, ts, l_partkey, value)) FILTER (step IS NOT NULL)), arg_min(value, (ts, l_partkey, value))) AS v FROM mm GROUP BY 1, 2)
    SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS param_depth,
      max(v) FILTER (metric = 'A') AS "metric_A", max(v) FILTER (metric = 'N') AS "metric_N"
    FROM orders LEFT JOIN p ON p.run_id = o_orderkey GROUP BY 1, 2, 3""",
)
def _(t):
    return runs.compare_runs(run_table(t), metric_table(t), ["A", "N"], ["depth"])


@query(
    "x11_run_metrics",
    "run_id:l metric:s step:l value:d",
    f"WITH {RUNS_SQL} SELECT run_id, metric, step, value FROM mm WHERE metric = 'R'",
)
def _(t):
    return runs.run_metrics(metric_table(t), metric="R")


@query(
    "x12_merged_params",
    "run_id:l color:s size:s",
    """SELECT user_id AS run_id, arg_max(event_type, ts) AS color, CAST(arg_max(event_id % 9, ts) FILTER (event_type = 'click') AS VARCHAR) AS size FROM events GROUP BY 1""",
)
def _(t):
    color = F.create_map(F.lit("color"), F.col("event_type"))
    size = F.when(F.col("event_type") == "click", F.create_map(F.lit("size"), (F.col("event_id") % 9).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    changes = t.events.select(F.col("user_id").alias("run_id"), "ts", F.map_concat(color, size).alias("params"))
    out = runs.merged_params(changes)
    return out.select("run_id", F.col("params")["color"].alias("color"), F.col("params")["size"].alias("size"))


@query(
    "x12_logged_artifacts",
    "run_id:s artifact_type:s size_bytes:l",
    """SELECT 'run-' || n_regionkey AS run_id, 'lines' AS artifact_type, sum(octet_length(encode(n_name)) + 1) AS size_bytes FROM nation GROUP BY n_regionkey""",
)
def _(t):
    import datetime as dt

    root = scratch_folder(t.spark, "artifacts-of-runs")
    t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("value")).repartition(1).write.partitionBy("k").text(f"{root}/files")
    log = runs.RunLog(t.spark, f"{root}/log")
    now = dt.datetime(2024, 1, 1)
    for k in [r["n_regionkey"] for r in t.nation.select("n_regionkey").distinct().collect()]:  # a run per region
        log.start_run("regions", f"run-{k}", now)
        log.log_artifact(f"{root}/files/k={k}", now, "lines")
        log.end_run(now)
    return log.table("artifacts")


@query("x13_s13_run_lifecycle", "status:s metrics:l total:d2", "SELECT 'FINISHED' AS status, 2 AS metrics, (SELECT sum(o_totalprice) FROM orders) + (SELECT count(*) FROM orders) AS total")
def _(t):
    import datetime as dt

    log = runs.RunLog(t.spark, scratch_folder(t.spark, "runs"))
    now = dt.datetime(2024, 1, 1)
    log.start_run("orders", "run-1", now)
    row = t.orders.agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n")).first()
    log.log_metrics({"total": row["total"], "rows": row["n"]}, now, step=1)
    log.log_params({"source": "orders"}, now)
    log.end_run(now + dt.timedelta(hours=1))
    metrics = log.table("metrics").groupBy("run_id").agg(F.count("*").alias("metrics"), F.sum("value").alias("total"))
    return log.runs().join(metrics, "run_id")


# -- set operations, sampling, hashing ---------------------------------------------------------


@query("u1_union_all", "k:l n:l", "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY 1")
def _(t):
    a, b = t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"))
    return a.unionByName(b).groupBy("k").agg(F.count("*").alias("n"))


@query("u2_shared_columns", "n_rows:l only_left:s only_right:s both:s", "SELECT count(*) AS n_rows, 'event_id' AS only_left, 'score' AS only_right, 'ts,user_id' AS both FROM events")
def _(t):
    left, right = t.events.select("event_id", "user_id", "ts"), t.events.select("user_id", "ts", F.lit(1).alias("score"))
    a, b = set(left.columns), set(right.columns)
    return left.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(",".join(sorted(a - b))).alias("only_left"), F.lit(",".join(sorted(b - a))).alias("only_right"), F.lit(",".join(sorted(a & b))).alias("both")
    )


@query(
    "u2_compared_columns",
    "column_name:s place:s left_type:s right_type:s left_nulls:l right_nulls:l",
    """SELECT 'event_id' AS column_name, 'left' AS place, 'bigint' AS left_type, NULL AS right_type, count(*) FILTER (event_id IS NULL) AS left_nulls, NULL AS right_nulls FROM events
    UNION ALL SELECT 'user_id', 'both', 'bigint', 'bigint', count(*) FILTER (user_id IS NULL), count(*) FILTER (user_id IS NULL) FROM events
    UNION ALL SELECT 'value', 'both', 'double', 'double', count(*) FILTER (value IS NULL), count(*) FILTER (value IS NULL OR event_type = 'error') FROM events
    UNION ALL SELECT 'event_type', 'right', NULL, 'string', NULL, count(*) FILTER (event_type IS NULL) FROM events""",
)
def _(t):
    left = t.events.select("event_id", "user_id", "value")
    right = t.events.select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_type")
    return profile.compare_columns(left, right)


@query("k8_seeded_sample", "o_orderkey:l o_custkey:l", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 100")
def _(t):
    return files.sample_rows(t.orders, 100, 7, ["o_orderkey"])


@query(
    "j9_lookup_many",
    "o_orderkey:l",
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _(t):
    ids = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.lookup_many(t.orders, ids, "o_custkey")


@query(
    "f18_stable_hash",
    "distinct_hashes:l rows:l",
    "SELECT count(DISTINCT (event_type, user_id)) AS distinct_hashes, count(*) AS rows FROM events",
)
def _(t):
    from tidemark.functions.common import stable_hash

    h = t.events.select(stable_hash(["user_id", "event_type"]).alias("h"))
    return h.agg(F.count_distinct("h").alias("distinct_hashes"), F.count("*").alias("rows"))


@query(
    "f13_f14_calendar_parts",
    "event_id:l hour:l weekday:l date:a hours:d days:l",
    """SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, CAST(ts AS DATE) AS date, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3600e6 AS hours,
      floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 86400e6) AS days FROM events""",
)
def _(t):
    from tidemark.functions import common as fn

    start = at("2024-01-01")
    parts = fn.calendar_parts(F.col("ts"))
    return t.events.select("event_id", *[c.alias(n) for n, c in parts.items()], fn.hours_between(start, F.col("ts")).alias("hours"), fn.whole_days_between(start, F.col("ts")).alias("days"))


@query(
    "f15_f16_clip_and_regularity",
    "user_id:l mean_clipped:d regularity:d",
    "SELECT user_id, avg(greatest(10, least(80, value))) AS mean_clipped, 1 / (1 + stddev_samp(value) / avg(value)) AS regularity FROM events GROUP BY 1",
)
def _(t):
    from tidemark.functions import common as fn

    v = F.col("value")
    return t.events.groupBy("user_id").agg(F.avg(fn.clip(v, 10.0, 80.0)).alias("mean_clipped"), fn.cv_regularity(F.stddev_samp(v), F.avg(v)).alias("regularity"))


# -- merged features ---------------------------------------------------------------------------


@query(
    "j1_feature_merge",
    "anonymized_id:l activity_count_7d:l activity_count_30d:l rmssd:d max_consecutive_missed:l completions:d",
    f"""WITH a AS ({ACTIVITY_SQL}), d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events),
    h AS (SELECT user_id, sqrt(avg(x * x)) AS rmssd FROM d GROUP BY 1),
    s0 AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS latest FROM events), s AS (SELECT *, event_type IN ('error', 'view') AS miss FROM s0 WHERE ts >= latest - INTERVAL 30 DAY),
    i AS (SELECT user_id, miss, sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s),
    r AS (SELECT user_id, max(n) AS streak FROM (SELECT user_id, g, count(*) FILTER (miss) AS n FROM i GROUP BY ALL) GROUP BY 1),
    e AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS c FROM s GROUP BY 1)
    SELECT a.anonymized_id, activity_count_7d, activity_count_30d, rmssd, streak AS max_consecutive_missed, c AS completions
    FROM a JOIN h ON h.user_id = a.anonymized_id JOIN r ON r.user_id = a.anonymized_id JOIN e ON e.user_id = a.anonymized_id""",
)
def _(t):
    merged = features.extract_features(
        behavioral=m.activity(t), hrv=m.readings(t), sleep=m.nights(t), activity=m.readings(t), sessions=m.sessions(t), engagement=m.engagement(t),
        tiebreak=("event_id",),
    )
    return merged.withColumnRenamed("total_completions", "completions")
