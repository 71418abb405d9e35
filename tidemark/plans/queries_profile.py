"""Checked queries: profiling, drift, evaluation, fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import behavioral, drift, evaluate, profile
from tidemark.plans import modalities as m
from tidemark.plans.registry import query, twin
from tidemark.plans.queries_features import ACTIVITY_SQL

G = m.GAPPY_SQL
S = m.SCORED_SQL


def _numeric_sql(table, col):
    return f"""SELECT '{col}' AS column_name, count({col}) AS count, avg({col}) AS mean, stddev_samp({col}) AS std, min({col}) AS min,
    quantile_cont({col}, 0.25) AS q25, median({col}) AS median, quantile_cont({col}, 0.75) AS q75, max({col}) AS max,
    skewness({col}) AS skewness, kurtosis({col}) AS kurtosis FROM {table}"""


NUMERIC_COLUMNS = "column_name:s count:l mean:d std:d min:d q25:d median:d q75:d max:d skewness:d kurtosis:d"


@query(
    "a24_numeric_summary",
    NUMERIC_COLUMNS,
    " UNION ALL ".join(_numeric_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
def _(t):
    return profile.numeric_summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _categorical_sql(table, col):
    return f"""SELECT '{col}' AS column_name, (SELECT count({col}) FROM {table}) AS count, (SELECT count(DISTINCT {col}) FROM {table}) AS "unique",
    {col} AS top, n AS freq, (SELECT count(*) - count({col}) FROM {table}) AS missing
    FROM (SELECT {col}, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)"""


@query(
    "a25_categorical_summary",
    "column_name:s count:l unique:l top:s freq:l missing:l",
    f"WITH {G} " + _categorical_sql("gappy", "event_type"),
)
def _(t):
    return profile.categorical_summary(m.gappy(t), ["event_type"])


@query(
    "a18_top_values",
    "column_name:s value:s n:l rank:l",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM
      (SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY 2
       UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)) WHERE rank <= 5""",
)
def _(t):
    return profile.top_values(t.part, ["p_brand", "p_type"], 5)


@query(
    "a27_null_counts",
    "column_name:s nulls:l",
    f"""WITH {G} SELECT unnest(['event_id', 'user_id', 'ts', 'value', 'event_type', 'score']) AS column_name,
      unnest([0, 0, 0, (SELECT count(*) - count(value) FROM gappy), (SELECT count(*) - count(event_type) FROM gappy),
      (SELECT count(*) - count(score) FROM gappy)]) AS nulls""",
)
def _(t):
    return profile.null_counts(m.gappy(t))


@query(
    "a26_version_statistics",
    "column_name:s key:s value:d4 item:s",
    """WITH n AS (SELECT 'o_totalprice' AS column_name, o_totalprice AS x FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders
      UNION ALL SELECT 'o_orderkey', o_orderkey FROM orders),
    s AS (SELECT column_name, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, median(x) AS median FROM n GROUP BY 1),
    c AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS item, count(*) AS n FROM orders GROUP BY 2
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2)
    SELECT column_name, key, value, NULL AS item FROM (UNPIVOT s ON mean, std, min, max, median INTO NAME key VALUE value)
    UNION ALL SELECT column_name, 'unique', count(*), NULL FROM c GROUP BY 1
    UNION ALL SELECT column_name, 'top', n, item FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, item) AS r FROM c) WHERE r <= 5
    UNION ALL SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']), 'nulls', 0, NULL""",
)
def _(t):
    return profile.version_statistics(t.orders)


@query(
    "a31_feature_summary",
    "num_individuals:l num_features:l num_numeric_features:l missing_values_pct:d behavioral_features:l sentiment_features:l "
    "physiological_features:l adherence_features:l",
    f"""WITH f AS ({ACTIVITY_SQL}) SELECT count(*) AS num_individuals, 10 AS num_features, 9 AS num_numeric_features,
      0.0 AS missing_values_pct, 8 AS behavioral_features, 0 AS sentiment_features, 0 AS physiological_features, 0 AS adherence_features FROM f""",
)
def _(t):
    return profile.feature_summary(behavioral.activity_features(m.activity(t)))


@query(
    "a33_class_distribution",
    "label:l n:l share:d is_minority:b",
    """SELECT quality AS label, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS share,
      count(*) = min(count(*)) OVER () AS is_minority FROM labels GROUP BY 1""",
)
def _(t):
    return profile.class_distribution(t.labels.withColumnRenamed("quality", "label"), "label")


@query(
    "u4_u5_duplicate_rows",
    "rows:l duplicates:l",
    "SELECT count(*) AS rows, count(*) - count(DISTINCT (event_type, user_id)) AS duplicates FROM events",
)
def _(t):
    return profile.duplicate_rows(t.events.select("event_type", "user_id"))


def _issue(kind, col, bad, base, steps, floor):
    ladder = " ".join(f"WHEN p >= {a} THEN '{b}'" for a, b in steps)
    return f"""SELECT '{kind}' AS issue_type, CASE {ladder} ELSE '{floor}' END AS severity, '{col}' AS column_name, n AS affected_rows, p AS pct
    FROM (SELECT {bad} AS n, 100.0 * ({bad}) / {base} AS p FROM src) WHERE n > 0"""


def _iqr_issue(col):
    test = f"(SELECT count(*) FROM src, (SELECT quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.75) AS b FROM src) WHERE {col} < a - 3 * (b - a) OR {col} > b + 3 * (b - a))"
    return f"""SELECT 'outlier' AS issue_type, CASE WHEN p >= 10 THEN 'high' WHEN p >= 5 THEN 'medium' ELSE 'low' END, '{col}', n, p
    FROM (SELECT {test} AS n, 100.0 * {test} / (SELECT count({col}) FROM src) AS p) WHERE n > 0"""


QUALITY_SRC = """src AS (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind,
  1 AS one, user_id % 3 AS bucket FROM events)"""


def _quality_source(t):
    return t.events.select(
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"),
        F.lit(1).alias("one"),
        (F.col("user_id") % 3).alias("bucket"),
    )


QUALITY_SQL = (
    f"WITH {QUALITY_SRC} "
    + _issue("missing", "value", "count(*) - count(value)", "count(*)", profile.MISSING_STEPS, "low")
    + " UNION ALL "
    + _issue("missing", "kind", "count(*) - count(kind)", "count(*)", profile.MISSING_STEPS, "low")
    + " UNION ALL "
    + _iqr_issue("value")
    + " UNION ALL "
    + _iqr_issue("bucket")
    + """ UNION ALL SELECT 'inconsistent', 'medium', 'one', count(*), 100.0 FROM src
    UNION ALL SELECT 'duplicate', CASE WHEN p >= 10 THEN 'high' WHEN p >= 5 THEN 'medium' ELSE 'low' END, NULL, n, p FROM
      (SELECT c - d AS n, 100.0 * (c - d) / c AS p FROM (SELECT (SELECT count(*) FROM src) AS c, (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS d)) WHERE n > 0"""
)


@query("d1_f20_quality_issues", "issue_type:s severity:s column_name:s affected_rows:l pct:d", QUALITY_SQL)
def _(t):
    return profile.quality_issues(_quality_source(t))


@query(
    "d2_outlier_rows",
    "column_name:s event_id:l value:d",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT 'value' AS column_name, event_id, value FROM events, q WHERE value < a - 3 * (b - a) OR value > b + 3 * (b - a)
    ORDER BY event_id LIMIT 100""",
)
def _(t):
    return profile.outlier_rows(t.events, ["value"], ["event_id"], per_column=100)


@query(
    "d2_outlier_rows_whole",
    "column_name:s event_id:l value:d",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT 'value' AS column_name, event_id, value FROM events, q WHERE value < a - 3 * (b - a) OR value > b + 3 * (b - a)""",
)
def _(t):
    return profile.outlier_rows(t.events, ["value"], ["event_id"])


LINE_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(
    "d3_pearson",
    "feature_a:s feature_b:s r:d",
    " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM lineitem" for a, b in LINE_PAIRS),
)
def _(t):
    return profile.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "d3_spearman_pairwise",
    "feature_a:s feature_b:s r:d",
    f"""WITH {G}, x AS (SELECT value, score FROM gappy WHERE value IS NOT NULL AND score IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS a,
      rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM x)
    SELECT 'value' AS feature_a, 'score' AS feature_b, corr(a, b) AS r FROM r""",
)
def _(t):
    return profile.correlations(m.gappy(t), ["value", "score"], "spearman")


@query(
    "d3_spearman_all_pairs",
    "feature_a:s feature_b:s r:d",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, (SELECT corr(x, y) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x,
        rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem)) AS r"""
        for a, b in LINE_PAIRS
    ),
)
def _(t):
    return profile.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "spearman")


@query(
    "d4_high_correlations",
    "feature_a:s feature_b:s r:d",
    """SELECT * FROM (SELECT 'value' AS feature_a, 'twice' AS feature_b, corr(value, 2 * value + 1) AS r FROM events
    UNION ALL SELECT 'value', 'user_id', corr(value, user_id) FROM events UNION ALL SELECT 'twice', 'user_id', corr(2 * value + 1, user_id) FROM events) WHERE abs(r) > 0.9""",
)
def _(t):
    df = t.events.select("value", (2 * F.col("value") + 1).alias("twice"), "user_id")
    return profile.high_correlations(profile.correlations(df, ["value", "twice", "user_id"]))


@query(
    "d5_dataset_flags",
    "flag:s n:l",
    f"""WITH i AS ({QUALITY_SQL}) SELECT 'critical_issues' AS flag, count(*) AS n FROM i WHERE severity = 'critical' HAVING count(*) > 0
    UNION ALL SELECT 'high_issues', count(*) FROM i WHERE severity = 'high' HAVING count(*) > 0""",
)
def _(t):
    return profile.dataset_flags(_quality_source(t))


def _profile_sql():
    """The whole profile of orders, section by section."""
    numeric, text = ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority")
    forms = {"count": "count({})", "mean": "avg({})", "std": "stddev_samp({})", "min": "min({})", "q25": "quantile_cont({}, 0.25)", "median": "median({})", "q75": "quantile_cont({}, 0.75)",
             "max": "max({})", "skewness": "skewness({})", "kurtosis": "kurtosis({})"}
    parts = [f"SELECT 'numeric', '{c}', '{k}', CAST({f.format(f'CAST({c} AS DOUBLE)')} AS DOUBLE) FROM orders" for c in numeric for k, f in forms.items()]
    parts = [parts[0].replace("SELECT 'numeric',", "SELECT 'numeric' AS section,").replace("'o_orderkey',", "'o_orderkey' AS column_name,").replace("'count',", "'count' AS key,").replace(" FROM", " AS value FROM"), *parts[1:]]
    for c in text:
        counts = f"(SELECT {c}, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"
        parts += [f"SELECT 'categorical', '{c}', '{k}', {f} FROM {counts}" for k, f in (("count", "sum(n)"), ("unique", "count(*)"), ("freq", "max(n)"), ("missing", f"max((SELECT count(*) FROM orders WHERE {c} IS NULL))"))]
    for c in numeric:
        out = f"(SELECT count(*) FILTER ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) AS n, count({c}) AS k FROM orders, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM orders))"
        parts.append(f"SELECT 'issue', '{c}', 'outlier:' || CASE WHEN 100.0 * n / k >= 10 THEN 'high' WHEN 100.0 * n / k >= 5 THEN 'medium' ELSE 'low' END, n FROM {out} WHERE n > 0")
    parts += [f"SELECT 'correlation', '{a}', '{b}', corr({a}, {b}) FROM orders" for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    return " UNION ALL ".join(parts)


@query("d6_full_profile", "section:s column_name:s key:s value:d4", _profile_sql())
def _(t):
    return profile.full_profile(t.orders)


# -- drift ---------------------------------------------------------------------------------

def half():
    return F.lit("1998-01-01").cast("timestamp_ntz")


def _halves(t):
    a = t.orders.filter(F.col("o_orderdate") < half()).select("o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderpriority")
    b = t.orders.filter(F.col("o_orderdate") >= half()).select(
        (F.col("o_totalprice") + 20000).alias("o_totalprice"), F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderpriority"
    )
    return a, b


HALVES = """a AS (SELECT o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS (SELECT o_totalprice + 20000 AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""


def _ks_sql(c):
    return f"""SELECT '{c}' AS column_name, max(na) AS n_ref, max(nb) AS n_cur, max(abs(ca / na - cb / nb)) AS statistic FROM
    (SELECT v, sum(sum(x)) OVER (ORDER BY v) AS ca, sum(sum(y)) OVER (ORDER BY v) AS cb, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb
     FROM (SELECT {c} AS v, 1 AS x, 0 AS y FROM a UNION ALL SELECT {c}, 0, 1 FROM b) GROUP BY v)"""


KS_SQL = _ks_sql("o_totalprice") + " UNION ALL " + _ks_sql("o_custkey")


@query("d7_ks_statistic", "column_name:s n_ref:l n_cur:l statistic:d", f"WITH {HALVES} {KS_SQL}")
def _(t):
    a, b = _halves(t)
    return drift.ks_statistics(a, b, ["o_totalprice", "o_custkey"])


@query(
    "d8_ks_p_value",
    "column_name:s p_value:d",
    f"""WITH {HALVES}, k AS ({KS_SQL}), l AS (SELECT column_name, statistic * sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) AS lam FROM k)
    SELECT column_name, CASE WHEN any_value(lam) < 0.2 THEN 1 ELSE greatest(0, least(1, sum((CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * i * i * lam * lam)))) END AS p_value
    FROM l, range(1, 101) r(i) GROUP BY 1""",
)
def _(t):
    a, b = _halves(t)
    ks = drift.ks_statistics(a, b, ["o_totalprice", "o_custkey"])
    return ks.select("column_name", drift.ks_p_value(F.col("statistic"), F.col("n_ref"), F.col("n_cur")).alias("p_value"))


def _kl_sql(c):
    return f"""SELECT '{c}' AS column_name, sum(p * ln(p / q)) AS kl FROM (SELECT pp / sum(pp) OVER () AS p, qq / sum(qq) OVER () AS q FROM
    (SELECT i, count(v) FILTER (s = 1) / (any_value(nb) * any_value(w)) + 1e-10 AS pp, count(v) FILTER (s = 0) / (any_value(na) * any_value(w)) + 1e-10 AS qq
     FROM range(0, 10) g(i), (SELECT count(*) AS na FROM a), (SELECT count(*) AS nb FROM b),
       (SELECT (max({c}) - min({c})) / 10 AS w, min({c}) AS lo FROM (SELECT {c} FROM a UNION ALL SELECT {c} FROM b))
     LEFT JOIN (SELECT {c} AS v, 0 AS s FROM a UNION ALL SELECT {c}, 1 FROM b) d ON least(floor((v - lo) / w), 9) = i GROUP BY i))"""


@query(
    "d9_kl_divergence",
    "column_name:s kl:d",
    f"WITH {HALVES} {_kl_sql('o_totalprice')} UNION ALL {_kl_sql('o_custkey')}",
)
def _(t):
    a, b = _halves(t)
    return drift.kl_divergences(a, b, ["o_totalprice", "o_custkey"])


CHI_SQL = """chi AS (SELECT 'o_orderpriority' AS column_name, count(*) AS k, sum((o - x) * (o - x) / x) AS statistic FROM
 (SELECT coalesce(ob, 0) AS o, ea * (SELECT count(*) FROM b) / (SELECT count(*) FROM a)::DOUBLE AS x FROM
  (SELECT o_orderpriority AS p, count(*) AS ea FROM a GROUP BY 1) FULL JOIN (SELECT o_orderpriority AS p, count(*) AS ob FROM b GROUP BY 1) USING (p)))"""


@query(
    "d10_u3_chi_square",
    "column_name:s k:l statistic:d score:d",
    f"WITH {HALVES}, {CHI_SQL} SELECT *, least(1, statistic / (k * 10)) AS score FROM chi",
)
def _(t):
    a, b = _halves(t)
    return drift.chi_square_drift(a, b, ["o_orderpriority"])


@query(
    "d11_version_drift",
    "column_name:s test:s score:d",
    f"""WITH {HALVES}, {CHI_SQL} SELECT column_name, 'kolmogorov_smirnov' AS test, statistic AS score FROM ({KS_SQL})
    UNION ALL SELECT column_name, 'chi_square', least(1, statistic / (k * 10)) FROM chi""",
)
def _(t):
    a, b = _halves(t)
    return drift.version_drift(a, b)


@query(
    "d11_version_drift_summary",
    "drift_score:d advice:s",
    f"""WITH {HALVES}, {CHI_SQL}, s AS (SELECT statistic AS score FROM ({KS_SQL}) UNION ALL SELECT least(1, statistic / (k * 10)) FROM chi)
    SELECT avg(score) AS drift_score, CASE WHEN avg(score) < 0.1 THEN 'low' WHEN avg(score) < 0.3 THEN 'moderate' ELSE 'high' END AS advice FROM s""",
)
def _(t):
    a, b = _halves(t)
    return drift.version_drift_summary(drift.version_drift(a, b))


@query(
    "d12_monitor_drift",
    "column_name:s score:d drift_score:d drift_detected:b",
    f"""WITH {HALVES}, k AS ({KS_SQL}) SELECT column_name, statistic AS score, max(statistic) OVER () AS drift_score,
      max(statistic) OVER () > 0.3 AS drift_detected FROM k""",
)
def _(t):
    a, b = _halves(t)
    return drift.monitor_drift(a, b, ["o_totalprice", "o_custkey"])


# -- evaluation ------------------------------------------------------------------------------

CURVE = f"""{S}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY score DESC)::DOUBLE AS fp,
  sum(pos) OVER ()::DOUBLE AS p, sum(neg) OVER ()::DOUBLE AS n FROM g)"""


@query(
    "q1_w10_auroc",
    "auroc:d optimal_threshold:d optimal_tpr:d optimal_fpr:d optimal_j_score:d",
    f"""WITH {CURVE}, j AS (SELECT * FROM c ORDER BY tp * n - fp * p DESC, score DESC LIMIT 1)
    SELECT (SELECT sum(neg * (tp - pos / 2)) / any_value(p * n) FROM c) AS auroc, score AS optimal_threshold, tp / p AS optimal_tpr,
      fp / n AS optimal_fpr, tp / p - fp / n AS optimal_j_score FROM j""",
)
def _(t):
    return evaluate.auroc(m.scored_labels(t))


@query(
    "q2_pr_auc",
    "pr_auc:d optimal_threshold_f1:d optimal_precision:d optimal_recall:d optimal_f1:d",
    f"""WITH {CURVE}, f AS (SELECT *, 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-10) AS f1 FROM c),
    b AS (SELECT * FROM f ORDER BY round(f1, 12) DESC, score LIMIT 1)
    SELECT (SELECT sum(pos / p * tp / (tp + fp)) FROM c) AS pr_auc, score AS optimal_threshold_f1, tp / (tp + fp) AS optimal_precision,
      tp / p AS optimal_recall, f1 AS optimal_f1 FROM b""",
)
def _(t):
    return evaluate.pr_auc(m.scored_labels(t))


EDGES = [i * 0.1 for i in range(10)]


def _above(op, edges):
    return " + ".join(f"(score {op} {e!r}::DOUBLE)::INT" for e in edges)


@query(
    "q3_calibration_curve",
    "bin:l n:l prob_true:d prob_pred:d",
    f"WITH {S} SELECT {_above('>', EDGES[1:])} AS bin, count(*) AS n, avg(label) AS prob_true, avg(score) AS prob_pred FROM scored GROUP BY 1",
)
def _(t):
    return evaluate.calibration_curve(m.scored_labels(t))


@query(
    "q4_calibration_errors",
    "brier_score:d expected_calibration_error:d maximum_calibration_error:d",
    f"""WITH {S}, x AS (SELECT *, {_above('>', EDGES[1:])} AS u, {_above('>=', EDGES)} - 1 AS l FROM scored)
    SELECT (SELECT avg((score - label) * (score - label)) FROM x) AS brier_score,
      (SELECT sum(e) FROM (SELECT abs(avg(score) - avg(label)) * count(*) / (SELECT count(*) FROM x) AS e FROM x WHERE score < 1 GROUP BY l)) AS expected_calibration_error,
      (SELECT max(e) FROM (SELECT abs(avg(score) - avg(label)) AS e FROM x GROUP BY u)) AS maximum_calibration_error""",
)
def _(t):
    return evaluate.calibration_errors(m.scored_labels(t))


@query(
    "q5_decision_curve",
    "step:l threshold:d net_benefit:d treat_all:d",
    f"""WITH {S}, h AS (SELECT i + 1 AS step, CASE WHEN i = 98 THEN 0.99 ELSE 0.01::DOUBLE + i * ((0.99::DOUBLE - 0.01) / 98) END AS th FROM range(0, 99) r(i)),
    n AS (SELECT count(*)::DOUBLE AS n, sum(label) AS p FROM scored)
    SELECT step, th AS threshold, (SELECT count(*) FILTER (label = 1) / n - count(*) FILTER (label = 0) / n * th / (1 - th) FROM scored WHERE score >= th) AS net_benefit,
      p / n - (n - p) / n * th / (1 - th) AS treat_all FROM h, n""",
)
def _(t):
    return evaluate.decision_curve(m.scored_labels(t))


RATES = f"""{S}, u AS (SELECT 'lang' AS feature, lang AS grp, label, score FROM scored UNION ALL SELECT 'source', source, label, score FROM scored),
k AS (SELECT feature, grp, count(*) AS n, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM u GROUP BY 1, 2),
gg AS (SELECT feature, grp, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM u GROUP BY 1, 2, 3),
cc AS (SELECT *, sum(pos) OVER w::DOUBLE AS ctp, sum(neg) OVER w::DOUBLE AS cfp, sum(pos) OVER (PARTITION BY feature, grp)::DOUBLE AS p,
  sum(neg) OVER (PARTITION BY feature, grp)::DOUBLE AS nn FROM gg WINDOW w AS (PARTITION BY feature, grp ORDER BY score DESC)),
au AS (SELECT feature, grp, CASE WHEN any_value(p) > 0 AND any_value(nn) > 0 THEN sum(neg * (ctp - pos / 2)) / any_value(p * nn) END AS auroc,
  CASE WHEN any_value(p) > 0 THEN sum(pos / p * ctp / (ctp + cfp)) END AS pr_auc FROM cc GROUP BY 1, 2),
rates AS (SELECT feature, grp AS "group", n AS n_samples, (tp + fn) / n AS prevalence, auroc, pr_auc, coalesce(tp / nullif(tp + fn, 0), 0) AS tpr,
  coalesce(fp / nullif(fp + tn, 0), 0) AS fpr, coalesce(tn / nullif(fp + tn, 0), 0) AS tnr, coalesce(fn / nullif(tp + fn, 0), 0) AS fnr,
  coalesce(tp / nullif(tp + fp, 0), 0) AS ppv, coalesce(tn / nullif(tn + fn, 0), 0) AS npv, (tp + tn) / n AS accuracy, (tp + fp) / n AS positive_rate
  FROM k JOIN au USING (feature, grp))"""
RATE_COLUMNS = (
    "feature:s group:s n_samples:l prevalence:d auroc:d pr_auc:d tpr:d fpr:d tnr:d fnr:d ppv:d npv:d accuracy:d positive_rate:d"
)
BY = ["lang", "source"]


@query("q6_group_rates", RATE_COLUMNS, f"WITH {RATES} SELECT * FROM rates")
def _(t):
    return evaluate.group_rates(m.scored_labels(t), BY)


@query(
    "q7_disparities",
    "feature:s metric:s disparity:d flagged:b",
    f"""WITH {RATES} SELECT feature, metric, max(v) - min(v) AS disparity, max(v) - min(v) > 0.1 AS flagged FROM
    (UNPIVOT (SELECT feature, auroc, pr_auc, tpr, fpr, ppv FROM rates) ON auroc, pr_auc, tpr, fpr, ppv INTO NAME metric VALUE v) GROUP BY 1, 2 HAVING count(v) >= 2""",
)
def _(t):
    return evaluate.disparities(evaluate.group_rates(m.scored_labels(t), BY))


@query(
    "q8_parity_differences",
    "feature:s demographic_parity_difference:d equalized_odds_tpr_difference:d equalized_odds_fpr_difference:d "
    "equalized_odds_difference:d accuracy_parity_difference:d",
    f"""WITH {RATES} SELECT feature, max(positive_rate) - min(positive_rate) AS demographic_parity_difference,
      max(tpr) - min(tpr) AS equalized_odds_tpr_difference, max(fpr) - min(fpr) AS equalized_odds_fpr_difference,
      greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS equalized_odds_difference,
      max(accuracy) - min(accuracy) AS accuracy_parity_difference FROM rates GROUP BY 1""",
)
def _(t):
    return evaluate.parity_differences(evaluate.group_rates(m.scored_labels(t), BY))


@query(
    "q9_disparate_impact",
    "privileged_rate:d unprivileged_rate:d disparate_impact:d passes:b",
    f"""WITH {S}, r AS (SELECT avg((score >= 0.5)::INT) FILTER (lang = 'en') AS a, avg((score >= 0.5)::INT) FILTER (lang <> 'en') AS b FROM scored)
    SELECT a AS privileged_rate, b AS unprivileged_rate, coalesce(b / nullif(a, 0), 0) AS disparate_impact, coalesce(b / nullif(a, 0), 0) >= 0.8 AS passes FROM r""",
)
def _(t):
    return evaluate.disparate_impact(m.scored_labels(t), "lang", "en", F.col("score") >= 0.5)


@query(
    "q10_equalized_odds_two_groups",
    "tpr_difference:d fpr_difference:d equalized_odds_difference:d",
    f"""WITH {RATES}, a AS (SELECT * FROM rates WHERE feature = 'lang' AND "group" = 'en'), b AS (SELECT * FROM rates WHERE feature = 'lang' AND "group" = 'fr')
    SELECT abs(a.tpr - b.tpr) AS tpr_difference, abs(a.fpr - b.fpr) AS fpr_difference, greatest(abs(a.tpr - b.tpr), abs(a.fpr - b.fpr)) AS equalized_odds_difference FROM a, b""",
)
def _(t):
    return evaluate.equalized_odds_two_groups(evaluate.group_rates(m.scored_labels(t), ["lang"]), "lang", "en", "fr")


@query(
    "q11_calibration_by_group",
    "lang:s bin:l n:l prob_true:d prob_pred:d",
    f"WITH {S} SELECT lang, {_above('>=', EDGES[1:])} AS bin, count(*) AS n, avg(label) AS prob_true, avg(score) AS prob_pred FROM scored GROUP BY 1, 2",
)
def _(t):
    return evaluate.calibration_curve(m.scored_labels(t), keys=["lang"], lower_closed=True)


@query(
    "q12_evaluation_report",
    "section:s item:s metric:s value:d",
    f"""WITH {RATES}, rr AS (SELECT feature || '=' || "group" AS item, n_samples::DOUBLE AS n_samples, prevalence, auroc, pr_auc, tpr, fpr, ppv, npv FROM rates)
    SELECT 'group' AS section, item, metric, value FROM rr UNPIVOT INCLUDE NULLS (value FOR metric IN (n_samples, prevalence, auroc, pr_auc, tpr, fpr, ppv, npv))
    UNION ALL SELECT 'disparity', feature, metric, max(v) - min(v) FROM
      (UNPIVOT (SELECT feature, auroc, pr_auc, tpr, fpr, ppv FROM rates) ON auroc, pr_auc, tpr, fpr, ppv INTO NAME metric VALUE v) GROUP BY 2, 3 HAVING count(v) >= 2""",
)
def _(t):
    # the whole-table sections have twins of their own (q1, q2, q4, q5)
    return evaluate.evaluation_report(m.scored_labels(t), ["lang", "source"]).filter("section IN ('group', 'disparity')")


_DISCRIMINATION = "auroc, optimal_threshold, optimal_j_score, pr_auc, optimal_threshold_f1, optimal_f1"
_CALIBRATION = "brier_score, expected_calibration_error, maximum_calibration_error"


@query(
    "q12_evaluation_report_whole",
    "section:s item:s metric:s value:d",
    f"""WITH q1 AS ({twin("q1_w10_auroc")}), q2 AS ({twin("q2_pr_auc")}), q4 AS ({twin("q4_calibration_errors")}), q5 AS ({twin("q5_decision_curve")}),
    d AS (SELECT auroc, optimal_threshold, optimal_j_score, pr_auc, optimal_threshold_f1, optimal_f1 FROM q1, q2),
    b AS (SELECT net_benefit AS max_benefit, threshold AS max_benefit_threshold FROM q5 ORDER BY net_benefit DESC, threshold LIMIT 1)
    SELECT 'discrimination' AS section, NULL::VARCHAR AS item, metric, value FROM d UNPIVOT INCLUDE NULLS (value FOR metric IN ({_DISCRIMINATION}))
    UNION ALL SELECT 'calibration', NULL, metric, value FROM q4 UNPIVOT INCLUDE NULLS (value FOR metric IN ({_CALIBRATION}))
    UNION ALL SELECT 'decision', NULL, metric, value FROM b UNPIVOT INCLUDE NULLS (value FOR metric IN (max_benefit, max_benefit_threshold))
    UNION ALL SELECT * FROM ({twin("q12_evaluation_report")})""",
)
def _(t):
    return evaluate.evaluation_report(m.scored_labels(t), ["lang", "source"])
