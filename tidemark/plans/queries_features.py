"""Checked queries: features per individual."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import emotion_columns, analyze_sentiment, sentiment_features
from tidemark.functions import text as lexicon
from tidemark.operators import adherence as ad, behavioral as be, ordered, physiological as ph
from tidemark.plans import modalities as m
from tidemark.plans.registry import query


def _activity_sql(days):
    return f"""
    w{days} AS (SELECT e.* FROM events e JOIN (SELECT user_id, max(ts) AS latest FROM events GROUP BY 1) x USING (user_id)
      WHERE e.ts >= x.latest - INTERVAL {days} DAY),
    t{days} AS (SELECT user_id, event_type, count(*) AS n FROM w{days} GROUP BY ALL),
    m{days} AS (SELECT user_id, event_type FROM t{days} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1),
    h{days} AS (SELECT user_id, -sum(n / tot * ln(n / tot)) AS h FROM
      (SELECT user_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY user_id)::DOUBLE AS tot FROM t{days}) GROUP BY 1),
    a{days} AS (SELECT user_id, count(*) AS activity_count_{days}d,
      count(*) / greatest(floor(date_diff('microsecond', min(ts), max(ts)) / 86400e6) + 1, 1) AS activity_frequency_{days}d,
      count(DISTINCT event_type) AS unique_activities_{days}d FROM w{days} GROUP BY 1)"""


ACTIVITY_COLUMNS = (
    "anonymized_id:l activity_count_7d:l activity_frequency_7d:d unique_activities_7d:l most_common_activity_7d:s "
    "activity_diversity_7d:d activity_count_30d:l activity_frequency_30d:d unique_activities_30d:l "
    "most_common_activity_30d:s activity_diversity_30d:d"
)
ACTIVITY_SQL = f"""WITH {_activity_sql(7)}, {_activity_sql(30)}
SELECT a7.user_id AS anonymized_id, a7.*, m7.event_type AS most_common_activity_7d, h7.h AS activity_diversity_7d,
  a30.* EXCLUDE (user_id), m30.event_type AS most_common_activity_30d, h30.h AS activity_diversity_30d
FROM a7 JOIN m7 USING (user_id) JOIN h7 USING (user_id) JOIN a30 USING (user_id) JOIN m30 USING (user_id) JOIN h30 USING (user_id)"""


@query("a1_activity_features", ACTIVITY_COLUMNS, ACTIVITY_SQL)
def _(t):
    return be.activity_features(m.activity(t))


@query(
    "a2_category_entropy",
    "anonymized_id:l n:l n_categories:l entropy:d",
    """SELECT user_id AS anonymized_id, sum(n) AS n, count(*) AS n_categories,
         -sum(n / tot * ln(n / tot)) AS entropy FROM
       (SELECT user_id, event_type, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY user_id)::DOUBLE AS tot
        FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    return be.category_entropy(m.activity(t), ["anonymized_id"], "activity_type")


def _dim_sql(name, expr, top):
    return f"""{name} AS (SELECT user_id, 1 - (-sum(n / tot * ln(n / tot))) / {top} AS c FROM
      (SELECT user_id, {expr} AS lv, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY user_id)::DOUBLE AS tot
       FROM events GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "a3_routine_consistency",
    "anonymized_id:l hour_consistency:d day_consistency:d activity_type_consistency:d overall_routine_consistency:d",
    f"""WITH {_dim_sql('hh', 'hour(ts)', 'ln(24)')}, {_dim_sql('dd', 'isodow(ts)', 'ln(7)')},
    {_dim_sql('tt', 'event_type', 'CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END')}
    SELECT hh.user_id AS anonymized_id, hh.c AS hour_consistency, dd.c AS day_consistency,
      tt.c AS activity_type_consistency, (hh.c + dd.c + tt.c) / 3 AS overall_routine_consistency
    FROM hh JOIN dd USING (user_id) JOIN tt USING (user_id)""",
)
def _(t):
    return be.routine_consistency(m.activity(t))


W30 = """w AS (SELECT e.* FROM events e JOIN (SELECT user_id, max(ts) AS latest FROM events GROUP BY 1) x USING (user_id)
  WHERE e.ts >= x.latest - INTERVAL 30 DAY),
daily AS (SELECT user_id, count(*) AS active_days,
  CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_samp(n) / avg(n)) ELSE 0 END AS regularity
  FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM w GROUP BY ALL) GROUP BY 1)"""


@query(
    "a4_social_metrics",
    "anonymized_id:l interaction_count:l interaction_frequency_per_day:d unique_interaction_types:l "
    "total_interaction_duration:d mean_interaction_duration:d median_interaction_duration:d "
    "max_interaction_duration:d interaction_regularity:d",
    f"""WITH {W30} SELECT user_id AS anonymized_id, count(*) AS interaction_count,
      count(*) / 30.0 AS interaction_frequency_per_day, count(DISTINCT event_type) AS unique_interaction_types,
      sum(value) AS total_interaction_duration, avg(value) AS mean_interaction_duration,
      median(value) AS median_interaction_duration, max(value) AS max_interaction_duration,
      any_value(regularity) AS interaction_regularity
    FROM w JOIN daily USING (user_id) GROUP BY user_id""",
)
def _(t):
    return be.social_metrics(m.activity(t), interaction_column="activity_type")


NIGHTS_SQL = """nights AS (SELECT user_id, event_id % 5 AS i,
  floor(value * 720) / 3600 AS h, CASE WHEN floor(value * 720) / 3600 > 0 AND floor(value * 720) / 3600 <= 24
  THEN floor(value * 720) / 3600 END AS v FROM events)"""


@query(
    "a5_sleep_features",
    "anonymized_id:l mean_sleep_duration:d median_sleep_duration:d std_sleep_duration:d min_sleep_duration:d "
    "max_sleep_duration:d sleep_regularity:d",
    f"""WITH {NIGHTS_SQL} SELECT user_id AS anonymized_id, coalesce(avg(v), 0) AS mean_sleep_duration,
      coalesce(median(v), 0) AS median_sleep_duration,
      CASE WHEN count(v) > 0 THEN stddev_samp(v) ELSE 0 END AS std_sleep_duration,
      coalesce(min(v), 0) AS min_sleep_duration, coalesce(max(v), 0) AS max_sleep_duration,
      CASE WHEN count(v) = 0 THEN 0 WHEN avg(v) > 0 THEN 1 / (1 + stddev_samp(v) / avg(v)) ELSE 0 END AS sleep_regularity
    FROM nights GROUP BY 1""",
)
def _(t):
    return ph.sleep_features(m.nights(t))


@query(
    "a6_interruption_stats",
    "anonymized_id:l mean_interruptions:d median_interruptions:d max_interruptions:d",
    f"""WITH {NIGHTS_SQL} SELECT user_id AS anonymized_id, avg(i) AS mean_interruptions,
      median(i) AS median_interruptions, max(i) AS max_interruptions FROM nights GROUP BY 1""",
)
def _(t):
    return ph.sleep_features(m.nights(t))


@query(
    "a7_sleep_efficiency",
    "anonymized_id:l mean_sleep_efficiency:d median_sleep_efficiency:d",
    f"""WITH {NIGHTS_SQL}, e AS (SELECT user_id, greatest(0, least(1, 1 - abs(h - 8) / 8)) AS x FROM nights)
    SELECT user_id AS anonymized_id, avg(x) AS mean_sleep_efficiency, median(x) AS median_sleep_efficiency
    FROM e GROUP BY 1""",
)
def _(t):
    return ph.sleep_features(m.nights(t))


@query(
    "a8_hrv_from_rr",
    "anonymized_id:l rmssd:d sdnn:d pnn50:d mean_rr:d std_rr:d lf_hf_ratio_proxy:d",
    """WITH d AS (SELECT user_id, 600 + value AS rr,
        (600 + value) - lag(600 + value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events)
    SELECT user_id AS anonymized_id, sqrt(avg(x * x)) AS rmssd, stddev_samp(rr) AS sdnn,
      100.0 * count(*) FILTER (abs(x) > 50) / count(x) AS pnn50, avg(rr) AS mean_rr, stddev_pop(rr) AS std_rr,
      sqrt(avg(x * x)) / stddev_samp(rr) AS lf_hf_ratio_proxy FROM d GROUP BY 1""",
)
def _(t):
    return ph.hrv_metrics(m.readings(t), tiebreak=("event_id",))


@query(
    "a9_heart_rate_stats",
    "anonymized_id:l mean_heart_rate:d std_heart_rate:d min_heart_rate:d max_heart_rate:d heart_rate_range:d hr_variability:d",
    """WITH d AS (SELECT user_id, 60 + value AS hr,
        value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events)
    SELECT user_id AS anonymized_id, avg(hr) AS mean_heart_rate, stddev_samp(hr) AS std_heart_rate,
      min(hr) AS min_heart_rate, max(hr) AS max_heart_rate, max(hr) - min(hr) AS heart_rate_range,
      stddev_pop(x) AS hr_variability FROM d GROUP BY 1""",
)
def _(t):
    return ph.hrv_metrics(m.readings(t).drop("rr_intervals"), tiebreak=("event_id",))


@query(
    "a10_heart_rate_zones",
    "anonymized_id:l zone1_pct:d zone2_pct:d zone3_pct:d zone4_pct:d zone5_pct:d activity_intensity_score:d active_time_pct:d",
    """WITH z AS (SELECT user_id, count(*) AS n,
      count(*) FILTER (60 + value >= 0.5 * 190 AND 60 + value < 0.6 * 190) AS a,
      count(*) FILTER (60 + value >= 0.6 * 190 AND 60 + value < 0.7 * 190) AS b,
      count(*) FILTER (60 + value >= 0.7 * 190 AND 60 + value < 0.8 * 190) AS c,
      count(*) FILTER (60 + value >= 0.8 * 190 AND 60 + value < 0.9 * 190) AS d,
      count(*) FILTER (60 + value >= 0.9 * 190) AS e FROM events GROUP BY 1)
    SELECT user_id AS anonymized_id, 100.0 * a / n AS zone1_pct, 100.0 * b / n AS zone2_pct, 100.0 * c / n AS zone3_pct,
      100.0 * d / n AS zone4_pct, 100.0 * e / n AS zone5_pct,
      (a + 2 * b + 3 * c + 4 * d + 5 * e) / n AS activity_intensity_score, 100.0 * (c + d + e) / n AS active_time_pct FROM z""",
)
def _(t):
    return ph.activity_intensity(m.readings(t))


@query(
    "a11_steps_calories",
    "anonymized_id:l total_steps:d mean_daily_steps:d median_daily_steps:d max_daily_steps:d step_consistency:d "
    "total_calories:d mean_daily_calories:d median_daily_calories:d",
    """WITH z AS (SELECT user_id, CAST(floor(value * 10) AS BIGINT) AS s, CAST(floor(value * 3) AS BIGINT) AS c FROM events)
    SELECT user_id AS anonymized_id, sum(s) AS total_steps, avg(s) AS mean_daily_steps, median(s) AS median_daily_steps,
      max(s) AS max_daily_steps, CASE WHEN avg(s) > 0 THEN 1 / (1 + stddev_samp(s) / avg(s)) ELSE 0 END AS step_consistency,
      sum(c) AS total_calories, avg(c) AS mean_daily_calories, median(c) AS median_daily_calories FROM z GROUP BY 1""",
)
def _(t):
    return ph.activity_intensity(m.readings(t))


TREATMENT_SQL = """tr AS (SELECT l_suppkey AS id, l_quantity AS s, floor(l_quantity * (1 - 5 * l_discount)) AS c,
  l_returnflag AS k, l_shipdate AS ts FROM lineitem)"""


@query(
    "a12_adherence_rate",
    "anonymized_id:l overall_adherence_rate:d total_scheduled:d total_completed:d total_missed:d adherence_category:s",
    f"""WITH {TREATMENT_SQL}, x AS (SELECT id, sum(s) AS ss, sum(c) AS cc FROM tr GROUP BY 1)
    SELECT id AS anonymized_id, CASE WHEN ss > 0 THEN cc / ss * 100 ELSE 0 END AS overall_adherence_rate,
      ss AS total_scheduled, cc AS total_completed, ss - cc AS total_missed,
      CASE WHEN cc / ss * 100 >= 80 THEN 'high' WHEN cc / ss * 100 >= 50 THEN 'moderate' ELSE 'low' END AS adherence_category
    FROM x""",
)
def _(t):
    return ad.adherence_rate(m.treatment(t), intervention_type_column=None, timestamp_column="")


@query(
    "a13_adherence_by_type",
    "anonymized_id:l adherence_A:d adherence_N:d adherence_R:d",
    f"""WITH {TREATMENT_SQL} SELECT id AS anonymized_id,
      sum(c) FILTER (k = 'A') / nullif(sum(s) FILTER (k = 'A'), 0) * 100 AS "adherence_A",
      sum(c) FILTER (k = 'N') / nullif(sum(s) FILTER (k = 'N'), 0) * 100 AS "adherence_N",
      sum(c) FILTER (k = 'R') / nullif(sum(s) FILTER (k = 'R'), 0) * 100 AS "adherence_R" FROM tr GROUP BY 1""",
)
def _(t):
    return ad.adherence_rate(m.treatment(t), timestamp_column="", intervention_types=["A", "N", "R"])


@query(
    "a14_recent_adherence",
    "anonymized_id:l recent_adherence_rate_30d:d",
    f"""WITH {TREATMENT_SQL}, x AS (SELECT tr.*, max(ts) OVER (PARTITION BY id) AS latest FROM tr)
    SELECT id AS anonymized_id, sum(c) / nullif(sum(s), 0) * 100 AS recent_adherence_rate_30d
    FROM x WHERE ts >= latest - INTERVAL 30 DAY GROUP BY 1""",
)
def _(t):
    return ad.adherence_rate(m.treatment(t), intervention_type_column=None)


SESSIONS_SQL = """s0 AS (SELECT user_id, ts, event_id, event_type IN ('error', 'view') AS miss,
  max(ts) OVER (PARTITION BY user_id) AS latest FROM events),
s AS (SELECT * FROM s0 WHERE ts >= latest - INTERVAL 30 DAY)"""
STREAK_SQL = """i AS (SELECT user_id, miss, sum(CASE WHEN miss THEN 0 ELSE 1 END) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s),
r AS (SELECT user_id, max(n) AS streak FROM (SELECT user_id, island, count(*) FILTER (miss) AS n FROM i GROUP BY ALL) GROUP BY 1)"""


@query(
    "a15_missed_sessions",
    "anonymized_id:l missed_sessions_count:l total_sessions:l missed_sessions_rate:d high_miss_rate_flag:b "
    "max_consecutive_missed:l consecutive_miss_flag:b recent_missed_7d:l recent_miss_flag:b",
    f"""WITH {SESSIONS_SQL}, {STREAK_SQL}
    SELECT user_id AS anonymized_id, count(*) FILTER (miss) AS missed_sessions_count, count(*) AS total_sessions,
      100.0 * count(*) FILTER (miss) / count(*) AS missed_sessions_rate,
      100.0 * count(*) FILTER (miss) / count(*) > 30 AS high_miss_rate_flag,
      any_value(streak) AS max_consecutive_missed, any_value(streak) >= 3 AS consecutive_miss_flag,
      count(*) FILTER (miss AND ts >= latest - INTERVAL 7 DAY) AS recent_missed_7d,
      count(*) FILTER (miss AND ts >= latest - INTERVAL 7 DAY) > 0 AS recent_miss_flag
    FROM s JOIN r USING (user_id) GROUP BY 1""",
)
def _(t):
    return ad.missed_sessions(m.sessions(t), tiebreak=("event_id",))


@query(
    "w6_longest_streak",
    "user_id:l streak:l",
    f"""WITH {SESSIONS_SQL.replace("WHERE ts >= latest - INTERVAL 30 DAY", "")}, {STREAK_SQL} SELECT user_id, streak FROM r""",
)
def _(t):
    return ordered.longest_run(t.events, "user_id", "ts", F.col("event_type").isin("error", "view"), "streak", ["event_id"])


@query(
    "w7_successive_differences",
    "user_id:l n_diff:l sum_diff:d sum_sq_diff:d n_over_50:l",
    """WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events)
    SELECT user_id, count(x) AS n_diff, sum(x) AS sum_diff, sum(x * x) AS sum_sq_diff, count(*) FILTER (abs(x) > 50) AS n_over_50 FROM d GROUP BY 1""",
)
def _(t):
    return ordered.successive_differences(t.events, "user_id", "ts", "value", ("event_id",))


@query(
    "w8_trailing_frame",
    "user_id:l event_id:l in_7d:b in_14d:b",
    """WITH x AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS latest FROM events)
    SELECT user_id, event_id, ts >= latest - INTERVAL 7 DAY AS in_7d, ts >= latest - INTERVAL 14 DAY AS in_14d FROM x""",
)
def _(t):
    return ordered.trailing(t.events, "user_id", "ts", marks=[7, 14])


@query(
    "a16_engagement_score",
    "anonymized_id:l interaction_frequency:d interaction_score:d mean_session_duration:d total_session_duration:d "
    "duration_score:d total_completions:d completion_rate:d completion_score:d engagement_consistency:d active_days:l "
    "active_days_pct:d overall_engagement_score:d engagement_level:s",
    f"""WITH {W30}, x AS (SELECT user_id, count(*) / 30.0 AS f, avg(value) AS md, sum(value) AS td,
        count(*) FILTER (event_type = 'purchase') AS c, count(*) AS n FROM w GROUP BY 1),
    y AS (SELECT x.*, active_days, least(f / 5, 1.0) AS s1, least(md / 30, 1.0) AS s2, least(c / n / 0.8, 1.0) AS s3,
        CASE WHEN active_days > 1 THEN regularity END AS s4 FROM x JOIN daily USING (user_id)),
    z AS (SELECT *, CASE WHEN s4 IS NULL THEN (s1 + s2 + s3) / 3 ELSE (s1 + s2 + s3 + s4) / 4 END AS o FROM y)
    SELECT user_id AS anonymized_id, f AS interaction_frequency, s1 AS interaction_score, md AS mean_session_duration,
      td AS total_session_duration, s2 AS duration_score, c AS total_completions, c / n AS completion_rate,
      s3 AS completion_score, s4 AS engagement_consistency, CASE WHEN active_days > 1 THEN active_days END AS active_days,
      CASE WHEN active_days > 1 THEN active_days / 30.0 * 100 END AS active_days_pct, o AS overall_engagement_score,
      CASE WHEN o >= 0.7 THEN 'high' WHEN o >= 0.4 THEN 'moderate' ELSE 'low' END AS engagement_level FROM z""",
)
def _(t):
    return ad.engagement_score(m.engagement(t))


# -- text ---------------------------------------------------------------------------------


def _presence(words):
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for w in words) + ")"


def _balance(high, low):
    return f"CASE WHEN {high} + {low} > 0 THEN ({high} - {low}) / CAST({high} + {low} AS DOUBLE) ELSE 0 END"


MARKS = "(length(text) - length(replace(text, '!', '')))"
SCORES_SQL = f"""
c AS (SELECT *, {_presence(lexicon.POSITIVE_WORDS)} AS p, {_presence(lexicon.NEGATIVE_WORDS)} AS n,
  {_presence(lexicon.HIGH_AROUSAL_WORDS)} + {MARKS} AS ha, {_presence(lexicon.LOW_AROUSAL_WORDS)} AS la,
  {_presence(lexicon.HIGH_DOMINANCE_WORDS)} AS hd, {_presence(lexicon.LOW_DOMINANCE_WORDS)} AS ld FROM src),
s AS (SELECT *, {_balance('p', 'n')} AS sentiment_valence, {_balance('ha', 'la')} AS sentiment_arousal,
  {_balance('hd', 'ld')} AS sentiment_dominance FROM c)"""
DOCS_SRC = "src AS (SELECT doc_id, source, text FROM documents)"

for _id, _name, _col in (
    ("f7", "lexicon_valence", "sentiment_valence"),
    ("f8", "lexicon_arousal", "sentiment_arousal"),
    ("f9", "lexicon_dominance", "sentiment_dominance"),
):

    @query(f"{_id}_{_name}", f"doc_id:l {_col}:d", f"WITH {DOCS_SRC}, {SCORES_SQL} SELECT doc_id, {_col} FROM s")
    def _(t, _col=_col):
        return analyze_sentiment(m.responses(t)).select("doc_id", _col)


@query(
    "f10_emotions",
    "doc_id:l joy:d anxiety:d sadness:d",
    f"""WITH {DOCS_SRC}, {SCORES_SQL}, v AS (SELECT doc_id, sentiment_valence AS v, sentiment_arousal AS a FROM s)
    SELECT doc_id, CASE WHEN v > 0.3 AND a > 0.3 THEN least(v, a) ELSE 0 END AS joy,
      CASE WHEN v < -0.3 AND a > 0.3 THEN least(abs(v), a) ELSE 0 END AS anxiety,
      CASE WHEN v < -0.3 AND a < -0.3 THEN least(abs(v), abs(a)) ELSE 0 END AS sadness FROM v""",
)
def _(t):
    return emotion_columns(analyze_sentiment(m.responses(t)))


def _phrase_hits(text):
    # phrases are plain words, so a boundary test is "no letter, digit or underscore next to it"
    hits = []
    for p in lexicon.CRISIS_PHRASES:
        lit = p.replace("'", "''").replace("-", "\\-")
        pattern = f"(^|[^\\pL\\pN_]){lit}($|[^\\pL\\pN_])"
        hits.append(f"CASE WHEN regexp_matches(lower({text}), '{pattern}') THEN '{p.replace(chr(39), chr(39) * 2)}' END")
    return "concat_ws(', ', " + ", ".join(hits) + ")"


# Worrying phrases do not occur in the generated prose, so each text gets one by its number.
PLANTED = ["i want to die soon", "It is HOPELESS, overdose", "suicidally calm", "can't go on!", "a self-harm note", "worthlessness"]


@query(
    "f11_crisis_phrases",
    "doc_id:l crisis_keywords:s crisis_flag:b",
    "WITH src AS (SELECT doc_id, text || ' ' || "
    + "(CASE CAST(doc_id % 7 AS INTEGER) "
    + " ".join(f"WHEN {i} THEN '{p.replace(chr(39), chr(39) * 2)}'" for i, p in enumerate(PLANTED))
    + " ELSE '' END) AS text FROM documents), k AS (SELECT doc_id, "
    + _phrase_hits("text")
    + " AS k FROM src) SELECT doc_id, nullif(k, '') AS crisis_keywords, k <> '' AS crisis_flag FROM k",
)
def _(t):
    planted = F.coalesce(F.element_at(F.array(*[F.lit(p) for p in PLANTED], F.lit("")), (F.col("doc_id") % 7 + 1).cast("int")), F.lit(""))
    docs = t.documents.select("doc_id", F.concat_ws(" ", "text", planted).alias("text_response"))
    return analyze_sentiment(docs)


@query(
    "f12_batch_sentiment",
    "conv_id:l turn:l sentiment_valence:d sentiment_arousal:d sentiment_dominance:d sentiment_compound:d crisis_flag:b",
    f"""WITH src AS (SELECT * FROM conversations), {SCORES_SQL} SELECT conv_id, turn, sentiment_valence, sentiment_arousal,
      sentiment_dominance, sentiment_valence AS sentiment_compound, {_phrase_hits('text')} <> '' AS crisis_flag FROM s""",
)
def _(t):
    return analyze_sentiment(t.conversations, "text")


@query(
    "a17_sentiment_rollup",
    "anonymized_id:s sentiment_valence_mean:d sentiment_valence_std:d sentiment_valence_min:d sentiment_valence_max:d "
    "sentiment_arousal_mean:d sentiment_arousal_std:d sentiment_dominance_mean:d sentiment_dominance_std:d "
    "sentiment_compound_mean:d sentiment_compound_std:d crisis_flag_sum:l",
    f"""WITH {DOCS_SRC}, {SCORES_SQL} SELECT source AS anonymized_id,
      avg(sentiment_valence) AS sentiment_valence_mean, stddev_samp(sentiment_valence) AS sentiment_valence_std,
      min(sentiment_valence) AS sentiment_valence_min, max(sentiment_valence) AS sentiment_valence_max,
      avg(sentiment_arousal) AS sentiment_arousal_mean, stddev_samp(sentiment_arousal) AS sentiment_arousal_std,
      avg(sentiment_dominance) AS sentiment_dominance_mean, stddev_samp(sentiment_dominance) AS sentiment_dominance_std,
      avg(sentiment_valence) AS sentiment_compound_mean, stddev_samp(sentiment_valence) AS sentiment_compound_std,
      count(*) FILTER ({_phrase_hits('text')} <> '') AS crisis_flag_sum FROM s GROUP BY 1""",
)
def _(t):
    return sentiment_features(m.responses(t))
