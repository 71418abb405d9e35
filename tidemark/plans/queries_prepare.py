"""Checked queries: sources, validation, cleaning, imputing, encoding, scaling, privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import common as fn
from tidemark.operators import clean, consent, encode, impute, ordered, privacy, scale, validate
from tidemark.plans import etl, modalities as m
from tidemark.plans.registry import query
from tidemark.session import scratch_folder
from tidemark.sources import files, tables

G = m.GAPPY_SQL
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
EVENT_COLUMNS = "event_id:l ts:t user_id:l event_type:s value:d props:s"

# -- sources and sinks ---------------------------------------------------------------------


@query("s1_s3_csv_round_trip", EVENT_COLUMNS, "SELECT * FROM events")
def _(t):
    path = scratch_folder(t.spark, "csv")
    files.write_csv(t.events, path)
    return files.read_csv(t.spark, path, EVENT_SCHEMA)


@query("s2_json_round_trip", EVENT_COLUMNS, "SELECT * FROM events")
def _(t):
    path = scratch_folder(t.spark, "json")
    files.write_json(t.events, path)
    return files.read_json(t.spark, path, EVENT_SCHEMA)


@query(
    "s4_s5_log_append_and_scan",
    "event_type:s good:l bad:l",
    """SELECT coalesce(event_type, 'broken') AS event_type, count(*) FILTER (k = 0) AS good, count(*) FILTER (k > 0) AS bad
    FROM (SELECT CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_type END AS event_type,
      CASE WHEN event_id % 4 = 1 THEN 1 WHEN event_id % 4 = 2 THEN 2 ELSE 0 END AS k FROM events) GROUP BY 1""",
)
def _(t):
    path = scratch_folder(t.spark, "log")
    k = F.col("event_id") % 4
    stamp = F.when(k != 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a time")
    line = F.to_json(F.struct("event_type", "user_id", stamp.alias("timestamp")))
    broken = F.when(k == 1, F.lit('{"event_type": ')).otherwise(line)
    t.events.select(broken.alias("value")).write.mode("append").text(path)
    log = files.read_log(t.spark, path, "event_type STRING, user_id BIGINT, timestamp STRING")
    return log.groupBy(F.coalesce("event_type", F.lit("broken")).alias("event_type")).agg(
        fn.count_if(~F.col("_bad")).alias("good"), fn.count_if(F.col("_bad")).alias("bad")
    )


@query(
    "s4_repeated_appends",
    "event_id:l event_type:s timestamp:t",
    """SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN TIMESTAMP '2024-06-01' ELSE ts END AS timestamp FROM events""",
)
def _(t):
    path = scratch_folder(t.spark, "appends")
    stamp = F.when(F.col("event_id") % 10 > 0, F.col("ts"))
    for half in (0, 1, 0):  # the first batch comes twice, and counts once
        part = t.events.filter(F.col("event_id") % 2 == half).select("event_id", "event_type", stamp.alias("timestamp"))
        files.append_json_lines(part, path, now="2024-06-01 00:00:00", batch=f"half-{half}")
    files.write_json(t.events.select("event_id", "event_type", F.col("ts").alias("timestamp")), f"{path}/batch-died")  # never committed
    return files.good_lines(files.read_log(t.spark, path, "event_id BIGINT, event_type STRING, timestamp STRING"))


@query(
    "s6_records_from_json",
    "event_id:l k:l",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    return files.json_records(t.events.select("event_id", "props"), "props", "k BIGINT")


@query("s11_artifact_inventory", "n_files:l bad_hashes:l empty_files:l")
def _(t):
    path = scratch_folder(t.spark, "artifacts")
    t.documents.repartition(files.parts_for(t.documents, 4), "doc_id").write.parquet(path)
    found = files.artifact_inventory(t.spark, path)
    return found.agg(
        F.count("*").alias("n_files"),
        fn.count_if(~F.rlike("sha256", F.lit("^[0-9a-f]{64}$"))).alias("bad_hashes"),
        fn.count_if(F.col("size_bytes") == 0).alias("empty_files"),
    )


@query(
    "s11_own_artifacts",
    "k:l size_bytes:l sha256:s",
    """SELECT s_nationkey AS k, octet_length(encode(string_agg(s_name || ',' || s_suppkey, chr(10) ORDER BY s_suppkey) || chr(10))) AS size_bytes,
      sha256(string_agg(s_name || ',' || s_suppkey, chr(10) ORDER BY s_suppkey) || chr(10)) AS sha256 FROM supplier GROUP BY 1""",
)
def _(t):
    path = scratch_folder(t.spark, "own-artifacts")
    line = F.concat_ws(",", "s_name", "s_suppkey")
    # one file per nation, its lines in the order of the key
    lines = t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey", line.alias("value")).repartition(8, "k").sortWithinPartitions("k", "s_suppkey")
    lines.select("k", "value").write.partitionBy("k").text(path)
    found = files.artifact_inventory(t.spark, path)
    return found.select(F.regexp_extract("path", "k=([0-9]+)/", 1).cast("long").alias("k"), "size_bytes", "sha256")


@query(
    "s10_upsert_latest_wins",
    "o_custkey:l o_orderkey:l o_totalprice:d",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old, new = t.orders.filter(F.col("o_orderdate") < cut), t.orders.filter(F.col("o_orderdate") >= cut)
    return tables.upsert(old, new, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "s15_guarded_update",
    "o_orderkey:l o_orderstatus:s was_updated:b",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND c_acctbal < 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus,
      o_orderstatus = 'O' AND coalesce(c_acctbal < 0, false) AS was_updated
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    debtors = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.guarded_update(t.orders, debtors, ["o_custkey"], F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("R")})


@query(
    "s15_match_counts",
    "requested:l matched:l",
    """SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS requested,
      (SELECT count(*) FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS matched""",
)
def _(t):
    debtors = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.match_counts(t.orders, debtors, ["o_custkey"], F.col("o_orderstatus") == "O")


@query(
    "s16_lookup_newest",
    "o_orderkey:l o_orderdate:t",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""",
)
def _(t):
    return tables.lookup(t.orders, {"o_orderpriority": "1-URGENT"}, ["o_orderdate", "o_orderkey"], 100)


@query("s16_lookup_newest_whole", "o_orderkey:l o_orderdate:t", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    return tables.lookup(t.orders, {"o_orderpriority": "1-URGENT"}, ["o_orderdate", "o_orderkey"])


# -- validation ----------------------------------------------------------------------------

# Survey records built from events: the number in ``props`` drives which rules break.
SURVEY_JSON = """to_json(named_struct(
  'survey_id', CASE WHEN k % 11 = 0 THEN 'bad id!' ELSE concat('s-', event_id) END,
  'timestamp', '2024-01-01T00:00:00',
  'responses', named_struct('mood_score', k % 13, 'anxiety_level', k % 23,
     'substance_use', CASE WHEN k % 5 = 0 THEN 'weekly' ELSE 'none' END,
     'self_harm', k % 9 = 0, 'life_events', CASE WHEN k % 17 = 0 THEN array('loss', 'party') ELSE array('loss') END),
  'device_type', CASE WHEN k % 6 = 0 THEN 'pager' ELSE 'mobile' END))"""


def _surveys(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k")).withColumn("record", F.expr(SURVEY_JSON))


@query(
    "v1_v1b_v1c_v1d_v1f_survey_validation",
    "event_id:l is_valid:b n_errors:l n_warnings:l errors:s",
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
    x AS (SELECT event_id, k, concat_ws(' | ',
       CASE WHEN k % 11 = 0 THEN 'Field ''survey_id'': does not match ''^[a-zA-Z0-9_-]+$''' END,
       CASE WHEN k % 13 < 1 THEN 'Field ''responses.mood_score'': is less than the minimum of 1' END,
       CASE WHEN k % 13 > 10 THEN 'Field ''responses.mood_score'': is greater than the maximum of 10' END,
       CASE WHEN k % 23 > 21 THEN 'Field ''responses.anxiety_level'': is greater than the maximum of 21' END,
       CASE WHEN k % 5 = 0 THEN 'Field ''responses.substance_use'': is not one of [''none'', ''occasional'', ''frequent'', ''daily'']' END,
       CASE WHEN k % 6 = 0 THEN 'Field ''device_type'': is not one of [''mobile'', ''tablet'', ''desktop'', ''other'']' END,
       CASE WHEN k % 17 = 0 THEN 'Field ''responses.life_events.1'': is not one of [''loss'', ''trauma'', ''relationship_change'', ''job_change'', ''health_issue'', ''financial_stress'', ''other'']' END) AS errors,
       (k % 11 = 0)::INT + (k % 13 < 1)::INT + (k % 13 > 10)::INT + (k % 23 > 21)::INT + (k % 5 = 0)::INT + (k % 6 = 0)::INT + (k % 17 = 0)::INT AS n
     FROM e)
    SELECT event_id, n = 0 AS is_valid, n AS n_errors, (k % 9 = 0)::INT AS n_warnings, errors FROM x""",
)
def _(t):
    return validate.check_records(_surveys(t), "record", "survey").select(
        "event_id",
        "is_valid",
        F.size("errors").alias("n_errors"),
        F.size("warnings").alias("n_warnings"),
        F.array_join("errors", " | ").alias("errors"),
    )


# Records whose very shape is wrong: absent fields, wrong types, unknown fields, long text.
SHAPE_JSON = """concat('{', concat_ws(',',
  CASE WHEN k % 5 <> 0 THEN '"survey_id":"s1"' END, '"timestamp":"t"',
  concat('"responses":', CASE WHEN k % 7 = 0 THEN '[1]' ELSE concat('{"mood_score":', CASE WHEN k % 3 = 0 THEN '"5"' WHEN k % 3 = 1 THEN '5.0' ELSE '5' END,
     CASE WHEN k % 4 = 0 THEN ',"hobby":1' ELSE '' END, ',"free_text_response":"', repeat('x', 4990 + k % 20), '"}') END),
  CASE WHEN k % 6 = 0 THEN '"colour":"red"' END, CASE WHEN k % 8 = 0 THEN '"completion_time_seconds":true' END), CASE WHEN k % 11 = 0 THEN '' ELSE '}' END)"""


@query(
    "v1a_v1e_v1g_v1h_structure_validation",
    "event_id:l is_valid:b n_errors:l root_extra:b",
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
    x AS (SELECT event_id, k, CASE WHEN k % 11 = 0 THEN 1 ELSE (k % 5 = 0)::INT + (k % 6 = 0)::INT + (k % 8 = 0)::INT
      + CASE WHEN k % 7 = 0 THEN 1 ELSE (k % 3 = 0)::INT + (k % 4 = 0)::INT + (k % 20 > 10)::INT END END AS n FROM e)
    SELECT event_id, n = 0 AS is_valid, n AS n_errors, k % 11 <> 0 AND k % 6 = 0 AS root_extra FROM x""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rec = t.events.select("event_id", k.alias("k")).withColumn("record", F.expr(SHAPE_JSON))
    extra = F.array_contains("errors", F.lit("Field 'root': additional properties not allowed: colour"))
    return validate.check_records(rec, "record", "survey").select("event_id", "is_valid", F.size("errors").alias("n_errors"), extra.alias("root_extra"))


WEARABLE_JSON = """to_json(named_struct('device_id', concat('d-', user_id), 'start_timestamp', 'a', 'end_timestamp', 'b',
  'metrics', named_struct('heart_rate', named_struct('average_bpm', 60 + value), 'stress_score', k),
  'data_quality', named_struct('completeness_percent', k, 'wear_time_minutes', k * 14)))"""


@query(
    "v2_quality_warnings",
    "event_id:l is_valid:b warnings:s",
    """WITH e AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
    SELECT event_id, 60 + value <= 220 AS is_valid, concat_ws(' | ',
      CASE WHEN k < 70 THEN 'Low data completeness: ' || k || '%' END,
      CASE WHEN k * 14 < 720 THEN 'Low wear time: ' || k * 14 || ' minutes' END) AS warnings FROM e""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rec = t.events.withColumn("k", k).withColumn("record", F.expr(WEARABLE_JSON))
    return validate.check_records(rec, "record", "wearable").select(
        "event_id", "is_valid", F.array_join("warnings", " | ").alias("warnings")
    )


EMR_JSON = """to_json(named_struct('record_id', concat('r', event_id), 'timestamp', 'x',
  'record_type', CASE WHEN k % 4 = 0 THEN 'note' ELSE 'diagnosis' END,
  'diagnoses', array(named_struct('code', CASE WHEN k % 3 = 0 THEN 'f32' ELSE 'F32.1' END, 'description', 'd'),
                     named_struct('code', 'F41', 'description', CASE WHEN k % 7 = 0 THEN NULL ELSE 'e' END)),
  'hospitalizations', array(named_struct('admission_date', 'a', 'involuntary', k % 8 = 0)),
  'risk_factors', named_struct('suicide_attempts', k % 2)))"""


@query(
    "v3_route_by_source",
    "event_id:l source_type:s is_valid:b n_errors:l n_warnings:l",
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
      CASE event_type WHEN 'click' THEN 'survey' WHEN 'view' THEN 'emr' ELSE 'fax' END AS source_type FROM events),
    x AS (SELECT event_id, source_type, k, CASE source_type
       WHEN 'survey' THEN (k % 11 = 0)::INT + (k % 13 < 1)::INT + (k % 13 > 10)::INT + (k % 23 > 21)::INT + (k % 5 = 0)::INT + (k % 6 = 0)::INT + (k % 17 = 0)::INT
       WHEN 'emr' THEN (k % 4 = 0)::INT + (k % 3 = 0)::INT + (k % 7 = 0)::INT ELSE 1 END AS n,
       CASE source_type WHEN 'survey' THEN (k % 9 = 0)::INT WHEN 'emr' THEN (k % 2 > 0)::INT + (k % 8 = 0)::INT ELSE 0 END AS w FROM e)
    SELECT event_id, source_type, n = 0 AS is_valid, n AS n_errors, w AS n_warnings FROM x""",
)
def _(t):
    source = F.when(F.col("event_type") == "click", "survey").when(F.col("event_type") == "view", "emr").otherwise("fax")
    k = F.get_json_object("props", "$.k").cast("int")
    rec = t.events.select("event_id", source.alias("source_type"), k.alias("k")).withColumn(
        "record", F.when(F.col("source_type") == "survey", F.expr(SURVEY_JSON)).otherwise(F.expr(EMR_JSON))
    )
    return validate.check_by_source(rec, "record", "source_type").select(
        "event_id", "source_type", "is_valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings")
    )


@query(
    "v4_v5_invalid_to_null",
    "event_id:l event_type:s value:d",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE event_type END AS event_type,
      CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value FROM events""",
)
def _(t):
    marked = t.events.withColumns(
        {
            "event_type": F.when(F.col("event_type") == "view", "N/A").when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type")),
            "value": F.when(F.col("event_type") == "signup", F.lit(float("inf"))).otherwise(F.col("value")),
        }
    )
    return clean.handle_invalid_values(marked)


@query(
    "v4_invalid_counts",
    "column_name:s replaced:l",
    """SELECT 'event_type' AS column_name, count(*) FILTER (event_type IN ('error', 'view')) AS replaced FROM events
    UNION ALL SELECT 'value', count(*) FILTER (event_id % 11 = 0) FROM events""",
)
def _(t):
    value = F.when(F.col("event_id") % 22 == 0, float("inf")).when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value"))
    return clean.invalid_counts(t.events.select("event_id", "event_type", value.alias("value")), ["error", "view"])


@query(
    "v6_domain_outliers",
    "event_id:l value_outlier:b",
    "SELECT event_id, value < 5 OR value > 150 AS value_outlier FROM events",
)
def _(t):
    return clean.flag_outliers(t.events, ["value"], bounds={"value": (0.0, 1.0)}, domain_rules={"value": (5, 150)})


@query(
    "v7_iqr_outliers",
    "l_orderkey:l l_linenumber:l l_extendedprice_outlier:b l_quantity_outlier:b",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a1, quantile_cont(l_extendedprice, 0.75) AS a3,
      quantile_cont(l_quantity, 0.25) AS b1, quantile_cont(l_quantity, 0.75) AS b3 FROM lineitem)
    SELECT l_orderkey, l_linenumber,
      l_extendedprice < a1 - 0.5 * (a3 - a1) OR l_extendedprice > a3 + 0.5 * (a3 - a1) AS l_extendedprice_outlier,
      l_quantity < b1 - 0.5 * (b3 - b1) OR l_quantity > b3 + 0.5 * (b3 - b1) AS l_quantity_outlier FROM lineitem, q""",
)
def _(t):
    return clean.flag_outliers_iqr(t.lineitem, ["l_extendedprice", "l_quantity"], k=0.5)


BAND = "CASE WHEN s <= 25 THEN 'low' WHEN s <= 50 THEN 'moderate' WHEN s <= 75 THEN 'high' ELSE 'critical' END"


@query(
    "v8_v9_v10_v17_bands_and_flags",
    "case_id:l risk_level:s alert:b review_by_score:b review_by_confidence:b priority:l min_score:d max_score:d",
    f"""WITH {m.CASES_SQL}, x AS (SELECT case_id, risk_score AS s, (case_id % 100) / 100.0 AS c FROM cases),
    y AS (SELECT *, {BAND} AS risk_level FROM x)
    SELECT case_id, risk_level, s > 75 AS alert, s > 75 AS review_by_score, s > 75 OR c < 0.6 AS review_by_confidence,
      CASE WHEN s >= 90 THEN 3 WHEN s >= 80 THEN 2 ELSE 1 END AS priority,
      CASE risk_level WHEN 'low' THEN 0 WHEN 'moderate' THEN 26 WHEN 'high' THEN 51 ELSE 76 END AS min_score,
      CASE risk_level WHEN 'low' THEN 25 WHEN 'moderate' THEN 50 WHEN 'high' THEN 75 ELSE 100 END AS max_score FROM y""",
)
def _(t):
    s, c = F.col("risk_score"), (F.col("case_id") % 100) / 100.0
    return m.order_cases(t).select(
        "case_id",
        fn.risk_level(s).alias("risk_level"),
        fn.alert_flag(s).alias("alert"),
        fn.review_flag(s).alias("review_by_score"),
        fn.review_flag(s, c).alias("review_by_confidence"),
        fn.review_priority(s).alias("priority"),
        fn.level_range(fn.risk_level(s)).alias("r"),
    ).select("*", "r.*")


@query(
    "v11_v12_v15_numeric_projection",
    "l_orderkey:l l_linenumber:l l_quantity:d l_extendedprice:d l_discount:d l_tax:d",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def _(t):
    wanted = [c for c in clean.numeric_columns(t.lineitem) if c not in ("l_partkey", "l_suppkey")]
    problems = validate.schema_conformity(t.lineitem, {"l_orderkey": "int", "l_quantity": "float", "l_returnflag": "string"})
    if problems:
        raise ValueError(problems)
    return validate.require_columns(t.lineitem, wanted)


@query(
    "v13_row_completeness",
    "event_id:l null_fraction:d mostly_missing:b",
    f"""WITH {G}, x AS (SELECT event_id, ((value IS NULL)::INT + (event_type IS NULL)::INT + (score IS NULL)::INT) / 6.0 AS f FROM gappy)
    SELECT event_id, f AS null_fraction, f > 0.3 AS mostly_missing FROM x""",
)
def _(t):
    return validate.completeness(m.gappy(t), 0.3)


@query(
    "v14_constant_columns",
    "column_name:s is_constant:b",
    """SELECT unnest(['value', 'one', 'none']) AS column_name,
      unnest([(SELECT count(DISTINCT value) <= 1 FROM events), true, true]) AS is_constant""",
)
def _(t):
    df = t.events.select("value", F.lit(1).alias("one"), F.lit(None).cast("double").alias("none"))
    return validate.constant_columns(df, ["value", "one", "none"])


@query(
    "v16_right_closed_bins",
    "l_orderkey:l l_linenumber:l size_band:s",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'small'
      WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'medium' WHEN l_quantity > 30 AND l_quantity <= 45 THEN 'large' END AS size_band
    FROM lineitem""",
)
def _(t):
    band = fn.bin_right_closed(F.col("l_quantity"), [0, 10, 30, 45], ["small", "medium", "large"])
    return t.lineitem.select("l_orderkey", "l_linenumber", band.alias("size_band"))


@query("v18_drop_null_rows", "event_id:l", f"WITH {G} SELECT event_id FROM gappy WHERE value IS NOT NULL AND score IS NOT NULL")
def _(t):
    return m.gappy(t).dropna(subset=["value", "score"])


# -- order-dependent cleaning ----------------------------------------------------------------


@query(
    "w2_keep_first_duplicate",
    "user_id:l day:a event_id:l value:d",
    """SELECT user_id, CAST(ts AS DATE) AS day, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""",
)
def _(t):
    return clean.remove_duplicates(t.events.withColumn("day", F.to_date("ts")), "user_id", "day", ["ts", "event_id"])


@query(
    "w3_z5_group_z_score",
    "event_id:l value:d",
    """SELECT event_id, (value - avg(value) OVER w) / coalesce(nullif(stddev_samp(value) OVER w, 0), 1) AS value
    FROM events WINDOW w AS (PARTITION BY user_id)""",
)
def _(t):
    return scale.fit_group_standard(t.events, ["value"], "user_id").transform(t.events)


@query(
    "j7_group_parameters_unseen_null",
    "event_id:l value:d",
    """WITH p AS (SELECT user_id, avg(value) AS mu, coalesce(nullif(stddev_samp(value), 0), 1) AS sd
      FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-03' GROUP BY 1)
    SELECT event_id, (value - mu) / sd AS value FROM events LEFT JOIN p USING (user_id)""",
)
def _(t):
    seen = t.events.filter((F.col("event_type") == "click") & (F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")))
    return scale.fit_group_standard(seen, ["value"], "user_id").transform(t.events)


@query(
    "w4_forward_fill_by_id",
    "event_id:l value:d event_type:s",
    f"""WITH {G} SELECT event_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(event_type IGNORE NULLS) OVER w AS event_type
    FROM gappy WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    return ordered.forward_fill(m.gappy(t), "user_id", "ts", ["value", "event_type"], ["event_id"])


@query(
    "w4_forward_fill_limited",
    "event_id:l score:d",
    """WITH gappy AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN value END AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    x AS (SELECT *, last_value(CASE WHEN score IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS seen, last_value(score IGNORE NULLS) OVER w AS v
      FROM gappy WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, CASE WHEN rn - seen <= 2 THEN v END AS score FROM x""",
)
def _(t):
    sparse = t.events.withColumn("score", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    return ordered.forward_fill(sparse, "user_id", "ts", ["score"], ["event_id"], limit=2)


@query(
    "w5_fill_over_all_rows",
    "event_id:l value:d",
    f"""WITH {G} SELECT event_id, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
      first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM gappy""",
)
def _(t):
    down = ordered.forward_fill(m.gappy(t), None, "ts", ["value"], ["event_id"])
    return ordered.forward_fill(down, None, "ts", ["value"], ["event_id"], backward=True)


# -- impute, encode, scale -------------------------------------------------------------------


@query(
    "e1_e2_e3_impute",
    "event_id:l value:d score:d event_type:s",
    f"""WITH {G}, p AS (SELECT avg(value) AS a, median(score) AS b FROM gappy),
    k AS (SELECT event_type AS k FROM gappy WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT event_id, coalesce(value, a) AS value, coalesce(score, b) AS score, coalesce(event_type, k) AS event_type FROM gappy, p, k""",
)
def _(t):
    g = m.gappy(t)
    return impute.fit_imputer(g, {"value": "mean", "score": "median", "event_type": "mode"}).transform(g)


@query(
    "e4_e5_fill_strategies",
    "event_id:l value:d score:d",
    f"""WITH {G} SELECT event_id, coalesce(value, first_value(value IGNORE NULLS) OVER
      (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value,
      coalesce(score, 0) AS score FROM gappy""",
)
def _(t):
    g = m.gappy(t)
    fitted = impute.fit_imputer(g, {"value": "backward_fill", "score": "constant"})
    return fitted.transform(g, "user_id", ["ts", "event_id"])


@query(
    "e6_j6_target_encode",
    "event_id:l event_type_encoded:d",
    f"""WITH {G}, g AS (SELECT avg(score) AS m FROM gappy),
    c AS (SELECT event_type, (count(score) * avg(score) + 1.0 * any_value(m)) / (count(score) + 1.0) AS e FROM gappy, g
      WHERE event_type IS NOT NULL GROUP BY 1)
    SELECT event_id, coalesce(e, m) AS event_type_encoded FROM gappy LEFT JOIN c USING (event_type), g""",
)
def _(t):
    g = m.gappy(t)
    return encode.fit_target_encoding(g, "event_type", "score").transform(g)


@query(
    "e7_one_hot",
    "event_id:l event_type_error:l event_type_purchase:l event_type_signup:l event_type_view:l",
    f"""WITH {G} SELECT event_id, coalesce((event_type = 'error')::INT, 0) AS event_type_error,
      coalesce((event_type = 'purchase')::INT, 0) AS event_type_purchase, coalesce((event_type = 'signup')::INT, 0) AS event_type_signup,
      coalesce((event_type = 'view')::INT, 0) AS event_type_view FROM gappy""",
)
def _(t):
    g = m.gappy(t)
    return encode.fit_one_hot(g, ["event_type"]).transform(g)


@query(
    "e8_ordinal_encode",
    "o_orderkey:l o_orderpriority_encoded:l",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE -1 END
      AS o_orderpriority_encoded FROM orders""",
)
def _(t):
    return encode.ordinal_encode(t.orders, {"o_orderpriority": ["5-LOW", "3-MEDIUM", "1-URGENT"]})


@query(
    "e9_standardize",
    "l_orderkey:l l_linenumber:l l_extendedprice:d l_quantity:d",
    """WITH p AS (SELECT avg(l_extendedprice) AS a, stddev_samp(l_extendedprice) AS b, avg(l_quantity) AS c, stddev_samp(l_quantity) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, (l_extendedprice - a) / b AS l_extendedprice, (l_quantity - c) / d AS l_quantity FROM lineitem, p""",
)
def _(t):
    return scale.fit_standard(t.lineitem, ["l_extendedprice", "l_quantity"]).transform(t.lineitem)


@query(
    "e10_min_max",
    "l_orderkey:l l_linenumber:l l_extendedprice:d",
    """WITH p AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, -1 + 2 * (l_extendedprice - a) / (b - a) AS l_extendedprice FROM lineitem, p""",
)
def _(t):
    return scale.fit_min_max(t.lineitem, ["l_extendedprice"], (-1, 1)).transform(t.lineitem)


ETL_SQL = f"""WITH {G}, d AS (SELECT * FROM gappy QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM d),
o AS (SELECT d.*, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS value_outlier FROM d, q),
p AS (SELECT median(value) AS md, avg(score) AS mn FROM o),
i AS (SELECT event_id, user_id, ts, coalesce(value, md) AS value, coalesce(score, mn) AS score, value_outlier,
  coalesce(last_value(event_type IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS event_type FROM o, p),
h AS (SELECT avg(score) AS a, stddev_samp(score) AS s FROM i)"""


@query(
    "e11_e12_etl_fit_transform",
    "event_id:l value_outlier:b value:d score:d event_type_error:l event_type_view:l",
    f"""{ETL_SQL} SELECT event_id, value_outlier, (value - avg(value) OVER w) / coalesce(nullif(stddev_samp(value) OVER w, 0), 1) AS value,
      (score - a) / s AS score, (event_type = 'error')::INT AS event_type_error, (event_type = 'view')::INT AS event_type_view
    FROM i, h WINDOW w AS (PARTITION BY user_id)""",
)
def _(t):
    config = etl.EtlConfig(
        outlier_columns=["value"],
        impute={"value": "median", "score": "mean", "event_type": "forward_fill"},
        one_hot_columns=["event_type"],
        group_scale_columns=["value"],
        standardize_columns=["score"],
        id_column="user_id",
        timestamp_column="ts",
        tiebreak=["event_id"],
    )
    g = m.gappy(t)
    return etl.fit_transform(g, config)[1]


@query(
    "s14_saved_parameters",
    "event_id:l value_outlier:b value:d score:d",
    f"""{ETL_SQL} SELECT event_id, value_outlier, (value - avg(value) OVER w) / coalesce(nullif(stddev_samp(value) OVER w, 0), 1) AS value, (score - a) / s AS score
    FROM i, h WINDOW w AS (PARTITION BY user_id)""",
)
def _(t):
    config = etl.EtlConfig(
        outlier_columns=["value"], impute={"value": "median", "score": "mean", "event_type": "forward_fill"}, group_scale_columns=["value"],
        standardize_columns=["score"], id_column="user_id", timestamp_column="ts", tiebreak=["event_id"],
    )
    g = m.gappy(t)
    path = scratch_folder(t.spark, "etl")
    etl.fit_etl(g, config).save(path)
    return etl.load_etl(t.spark, path).transform(g)


@query(
    "e13_sequences",
    "user_id:l n:l padded:l first_step:d last_step:d label:d",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k,
      count(*) OVER (PARTITION BY user_id) AS c FROM events)
    SELECT user_id, 80 AS n, greatest(80 - any_value(c), 0) AS padded,
      CASE WHEN any_value(c) < 80 THEN 0 ELSE max(value) FILTER (k = 80) END AS first_step,
      max(value) FILTER (k = 1) AS last_step, max(event_id) FILTER (k = 1) AS label FROM r GROUP BY 1""",
)
def _(t):
    seq = etl.sequences(t.events, "user_id", "ts", ["value"], "event_id", 80, tiebreak=["event_id"])
    return seq.select(
        "user_id",
        F.size("sequence").alias("n"),
        (80 - F.col("n_steps")).alias("padded"),
        F.element_at("sequence", 1)[0].alias("first_step"),
        F.element_at("sequence", -1)[0].alias("last_step"),
        F.col("label").cast("double").alias("label"),
    )


# -- privacy and consent ---------------------------------------------------------------------

SALT = "pinch"


@query(
    "f1_f2_f6_salted_hashes",
    "c_custkey:l c_name:s composite:s is_anonymized:b",
    f"""SELECT c_custkey, sha256(c_name || '{SALT}') AS c_name,
      sha256(c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR) || '{SALT}') AS composite, true AS is_anonymized FROM customer""",
)
def _(t):
    parts = ["c_mktsegment", F.lit(""), F.col("c_nationkey")]
    df = t.customer.withColumn("composite", privacy.composite_identifier(parts, SALT))
    hashed = privacy.anonymize_record(df, ["c_name", "absent"], SALT)
    return privacy.verify_anonymized(hashed, ["c_name", "composite"])


PII_SQL_STEPS = []
for _i, (_n, _p) in enumerate(privacy.PII_PATTERNS.items()):
    _prev = f"s{_i - 1}" if _i else "src"
    _lit = _p.replace("'", "''")
    PII_SQL_STEPS.append(
        f"s{_i} AS (SELECT doc_id, n + len(regexp_extract_all(text, '{_lit}')) AS n, "
        f"regexp_replace(text, '{_lit}', '[REDACTED]', 'g') AS text FROM {_prev})"
    )
PII_SQL = ",\n".join(PII_SQL_STEPS)


@query(
    "f3_redact_text",
    "doc_id:l redaction_count:l digest:s",
    "WITH src AS (SELECT doc_id, 0 AS n, 'write to a.b@mail.example or 555-123-4567, id 123-45-6789, card 4111 1111 1111 1111, "
    "zip 94103-1234, host 10.0.0.' || doc_id % 250 || ' ' || text AS text FROM documents), "
    + PII_SQL
    + " SELECT doc_id, n AS redaction_count, md5(text) AS digest FROM s5",
)
def _(t):
    planted = (
        "write to a.b@mail.example or 555-123-4567, id 123-45-6789, card 4111 1111 1111 1111, zip 94103-1234, host 10.0.0."
    )
    df = t.documents.select(
        "doc_id", F.concat(F.lit(planted), (F.col("doc_id") % 250).cast("string"), F.lit(" "), "text").alias("text")
    )
    return privacy.redact(df, "text").select("doc_id", "redaction_count", F.md5("text").alias("digest"))


@query(
    "f4_anonymize_nested",
    "event_id:l id_hash:s note:s",
    f"""SELECT event_id, sha256(CAST(user_id AS VARCHAR) || '{SALT}') AS id_hash, 'mail [REDACTED] now' AS note FROM events""",
)
def _(t):
    df = t.events.select(
        "event_id",
        F.struct(
            F.struct(F.col("user_id").cast("string").alias("id")).alias("person"), F.lit("mail x@y.example now").alias("note")
        ).alias("record"),
    )
    out = privacy.anonymize_nested(df, ["record.person.id", "record.person.absent"], ["record.note"], SALT)
    return out.select("event_id", F.col("record.person.id").alias("id_hash"), F.col("record.note").alias("note"))


@query("f5_verify_hash_shape", "doc_id:l ok:b", "SELECT doc_id, regexp_matches(md5(text) || md5(text), '^[0-9a-fA-F]{64}$') AS ok FROM documents")
def _(t):
    return t.documents.select("doc_id", privacy.looks_hashed(F.concat(F.md5("text"), F.md5("text"))).alias("ok"))


CONSENT_SQL = """c AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN ['survey'] ELSE ['survey', 'wearable'] END AS granted,
  CASE WHEN c_acctbal < 2000 THEN TIMESTAMP '1997-01-01' END AS expires, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1996-01-01' END AS revoked
  FROM customer WHERE c_mktsegment <> 'BUILDING'),
r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN ['survey', 'wearable'] ELSE ['survey'] END AS wants FROM orders),
st AS (SELECT o_orderkey, CASE WHEN c.id IS NULL THEN 'not_found' WHEN revoked IS NOT NULL THEN 'revoked'
  WHEN expires < TIMESTAMP '1998-01-01' THEN 'expired' WHEN NOT list_has_all(granted, wants) THEN 'not_found' ELSE 'valid' END AS consent_status
  FROM r LEFT JOIN c ON o_custkey = c.id)"""


def consents(t):
    return t.customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("anonymized_id"),
        F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("survey"))).otherwise(F.array(F.lit("survey"), F.lit("wearable"))).alias("data_types"),
        F.when(F.col("c_acctbal") < 2000, F.lit("1997-01-01").cast("timestamp_ntz")).alias("expires_at"),
        F.when(F.col("c_acctbal") < 0, F.lit("1996-01-01").cast("timestamp_ntz")).alias("revoked_at"),
    )


def requests(t):
    both = F.array(F.lit("survey"), F.lit("wearable"))
    return t.orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("anonymized_id"),
        F.when(F.col("o_orderstatus") == "F", both).otherwise(F.array(F.lit("survey"))).alias("data_types"),
    )


def now():
    return F.lit("1998-01-01").cast("timestamp_ntz")


@query("j11_u6_consent_status", "o_orderkey:l consent_status:s consent_valid:b", f"WITH {CONSENT_SQL} SELECT o_orderkey, consent_status, consent_status = 'valid' AS consent_valid FROM st")
def _(t):
    return consent.consent_status(requests(t), consents(t), now())


@query(
    "j12_consent_gate",
    "o_orderkey:l branch:s",
    f"WITH {CONSENT_SQL} SELECT o_orderkey, CASE WHEN consent_status = 'valid' THEN 'passed' ELSE 'rejected' END AS branch FROM st",
)
def _(t):
    passed, rejected = consent.consent_gate(requests(t), consents(t), now())
    return passed.select("o_orderkey", F.lit("passed").alias("branch")).unionByName(
        rejected.select("o_orderkey", F.lit("rejected").alias("branch"))
    )
