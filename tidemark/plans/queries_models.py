"""Checked queries: splitting, balancing, training, scoring, explaining, screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import explain, score, split, train
from tidemark.plans import modalities as m, screening
from tidemark.plans.queries_prepare import CONSENT_SQL, consents
from tidemark.plans.registry import query
from tidemark.sources import catalog


def at(text):
    return F.lit(text).cast("timestamp_ntz")


# -- splitting -------------------------------------------------------------------------------


@query(
    "m1_chronological_split",
    "l_orderkey:l l_partkey:l l_shipdate:t part:s",
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem)
    SELECT l_orderkey, l_partkey, l_shipdate, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM o""",
)
def _(t):
    a, b = split.chronological_split(t.lineitem, "l_shipdate", 0.2, ["l_orderkey", "l_partkey", "l_extendedprice"])
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query(
    "m2_stratified_folds",
    "event_type:s fold:l n:l",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, f AS fold, floor((n - f - 1) / 5) + 1 AS n FROM c, range(0, 5) r(f)""",
)
def _(t):
    return split.stratified_folds(t.events, "event_type", ["event_id"]).groupBy("event_type", "fold").agg(F.count("*").alias("n"))


@query(
    "m2_fold_rows",
    "event_id:l event_type:s fold:l",
    """SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) - 1) % 5 AS fold FROM events""",
)
def _(t):
    return split.stratified_folds(t.events, "event_type", ["event_id"])


def rare(t):
    """Orders with a rare positive class (price above 440 000)."""
    return t.orders.select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderdate", (F.col("o_totalprice") > 440000).cast("int").alias("label")
    )


@query(
    "m3_undersample",
    "label:l n:l",
    """SELECT label, min(count(*)) OVER () AS n FROM (SELECT (o_totalprice > 440000)::INT AS label FROM orders) GROUP BY 1""",
)
def _(t):
    return split.undersample(rare(t), "label", ["o_orderkey"]).groupBy("label").agg(F.count("*").alias("n"))


RARE_SQL = "r AS (SELECT o_orderkey, o_orderdate, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, (o_totalprice > 440000)::INT AS label FROM orders)"


def _kept_sql(table):
    """The rows that an undersampled table keeps: of each class the first by the hash, as many as the smallest has."""
    return f"""(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || o_orderkey), o_orderkey)
      <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY label)))"""


@query("m3_undersampled_rows", "o_orderkey:l label:l", f"WITH {RARE_SQL} SELECT o_orderkey, label FROM {_kept_sql('r')}")
def _(t):
    return split.undersample(rare(t), "label", ["o_orderkey"])


@query(
    "m4_smote",
    "label:l n:l in_range:b",
    """SELECT label, max(count(*)) OVER () AS n, true AS in_range FROM (SELECT (o_totalprice > 440000)::INT AS label FROM orders) GROUP BY 1""",
)
def _(t):
    out = split.smote(rare(t), ["o_totalprice", "o_custkey"], "label", "o_orderkey")
    fits = ~F.col("is_synthetic") | (F.col("o_totalprice") > 440000)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.min(fits).alias("in_range"))


@query(
    "m4_synthetic_parents",
    "id:l j:l nid:l share:d8 x0:d x1:d nx0:d nx1:d",
    f"""WITH {RARE_SQL}, p AS (SELECT o_orderkey AS id, o_totalprice AS a, o_custkey AS b FROM r WHERE label = 1),
    z AS (SELECT count(*) AS n, (SELECT count(*) FROM r WHERE label = 0) - count(*) AS wanted FROM p),
    c AS (SELECT id, a, b, wanted // n + (row_number() OVER (ORDER BY md5('42|' || id), id) <= wanted % n)::INT AS copies FROM p, z),
    k AS (SELECT id, a, b, unnest(range(1, copies + 1)) AS j FROM c),
    g AS (SELECT p.id, q.id AS nid, q.a AS na, q.b AS nb, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)), q.id) AS rk
      FROM p JOIN p q ON p.id <> q.id QUALIFY rk <= 5),
    m AS (SELECT id, max(rk) AS m FROM g GROUP BY 1)
    SELECT k.id, j, nid, CAST('0x' || substr(md5('43|' || k.id || '|' || j), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS share, a AS x0, b AS x1, na AS nx0, nb AS nx1
    FROM k JOIN m USING (id) JOIN g ON g.id = k.id AND g.rk = CAST('0x' || substr(md5('42|' || k.id || '|' || j), 1, 8) AS BIGINT) % m + 1""",
)
def _(t):
    rows = rare(t)
    counts = split.class_counts(rows, "label")
    made = split.smote_parents(rows.filter("label = 1"), ["o_totalprice", "o_custkey"], "o_orderkey", counts[0] - counts[1])
    sides = [F.col(c)[i].alias(f"{c[1:]}{i}") for c in ("_x", "_nx") for i in (0, 1)]
    return made.select(F.col("_id").alias("id"), F.col("_j").alias("j"), F.col("_nid").alias("nid"), F.col("_g").alias("share"), *sides)


@query(
    "m5_split_rows",
    "o_orderkey:l part:s",
    f"""WITH {RARE_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM r),
    p AS (SELECT *, CASE WHEN rn <= floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS part FROM o), t AS (SELECT * FROM p WHERE part = 'train')
    SELECT o_orderkey, part FROM {_kept_sql('t')} UNION ALL SELECT o_orderkey, part FROM p WHERE part <> 'train'""",
)
def _(t):
    parts = split.train_val_test_split(rare(t), ["o_totalprice", "o_custkey"], "label", "o_orderkey", "o_orderdate", balance="undersample")
    named = [d.select("o_orderkey", F.lit(n).alias("part")) for d, n in zip(parts, ("train", "val", "test"))]
    return named[0].union(named[1]).union(named[2])


@query(
    "m5_train_val_test_split",
    "part:s n:l",
    """WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, (SELECT n FROM n) AS n FROM orders),
    p AS (SELECT o_totalprice, CASE WHEN rn <= floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS part FROM o)
    SELECT part, CASE WHEN part = 'train' THEN 2 * count(*) FILTER (o_totalprice > 440000) ELSE count(*) END AS n FROM p GROUP BY 1""",
)
def _(t):
    a, b, c = split.train_val_test_split(rare(t), ["o_totalprice", "o_custkey"], "label", "o_orderkey", "o_orderdate", balance="undersample")
    parts = [d.select(F.lit(n).alias("part")) for d, n in ((a, "train"), (b, "val"), (c, "test"))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("part").agg(F.count("*").alias("n"))


# -- training --------------------------------------------------------------------------------


def labelled(t):
    d = m.scored_labels(t).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return d.select("doc_id", "label", F.col("score").alias("x1"), F.ln(F.col("n_chars").cast("double")).alias("x2"), (F.col("n_chars") % 7).cast("double").alias("x3"))


@query("m6_logistic_search", "params:s auc:d")
def _(t):
    model, params, auc = train.train_logistic(labelled(t), ["x1", "x2", "x3"], "label", ["doc_id"], folds=3)
    scored = score.score_with_model(labelled(t), model)
    return scored.agg(F.lit(str(params)).alias("params"), F.lit(auc).alias("auc"))


@query("m7_boosted_trees", "label:l n:l mean_probability:d")
def _(t):
    data = labelled(t)
    fit, val = data.filter(F.col("doc_id") % 5 > 0), data.filter(F.col("doc_id") % 5 == 0)
    model, _, _ = train.train_boosted(fit, val, ["x1", "x2", "x3"], "label", ["doc_id"], folds=2, max_iter=8)
    return score.score_with_model(data, model).groupBy("label").agg(F.count("*").alias("n"), F.avg("probability_1").alias("mean_probability"))


def _readings(t):
    return t.events.select("event_id", "value", (F.col("user_id") % 20).cast("double").alias("group"), F.hour("ts").cast("double").alias("hour"), F.col("event_type"))


@query("m8_isolation_forest", "is_anomaly:b n:l mean_value:d")
def _(t):
    data = _readings(t)
    forest = train.fit_isolation_forest(data, ["value", "group", "hour"], ["event_id"], n_trees=50)
    return forest.predict(data).groupBy("is_anomaly").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


@query("d13_permutation_shift", "feature:s importance:d")
def _(t):
    data = _readings(t)
    forest = train.fit_isolation_forest(data, ["value", "group", "hour"], ["event_id"], n_trees=20)
    return train.permutation_shift(data, ["value", "group", "hour"], ["event_id"], forest.score)


@query(
    "d13_shift_of_a_linear_score",
    "feature:s importance:d",
    """WITH o AS (SELECT value, CAST(user_id % 20 AS DOUBLE) AS grp, CAST(hour(ts) AS DOUBLE) AS hour, row_number() OVER (ORDER BY md5('42|' || event_id), event_id) - 1 AS at, count(*) OVER () AS n FROM events),
    s AS (SELECT f.feature, i, 1 + CAST('0x' || substr(md5('42|' || i), 1, 8) AS BIGINT) % (n - 1) AS step, n FROM (SELECT any_value(n) AS n FROM o), (VALUES ('value', 0), ('group', 1), ('hour', 2)) f(feature, i)),
    m AS (SELECT feature, 1 / (1 + exp(-(CASE i WHEN 0 THEN b.value ELSE a.value END / 50 - CASE i WHEN 1 THEN b.grp ELSE a.grp END / 10
        + CASE i WHEN 2 THEN b.hour ELSE a.hour END * CASE i WHEN 0 THEN b.value ELSE a.value END / 600))) AS score
      FROM s JOIN o a ON true JOIN o b ON b.at = (a.at + step) % s.n)
    SELECT feature, abs(avg(score) - (SELECT avg(1 / (1 + exp(-(value / 50 - grp / 10 + hour * value / 600)))) FROM o)) AS importance FROM m GROUP BY 1""",
)
def _(t):
    def score_of(df):
        logit = F.col("value") / 50 - F.col("group") / 10 + F.col("hour") * F.col("value") / 600
        return df.withColumn("score", 1 / (1 + F.exp(-logit)))

    return train.permutation_shift(_readings(t), ["value", "group", "hour"], ["event_id"], score_of)


ANOMALY_SQL = """z AS (SELECT -value / 500 AS score, (event_type = 'error')::INT AS label FROM events),
b AS (SELECT min(score) AS lo, max(score) AS hi FROM z), k AS (SELECT score, label, 100 * (hi - score) / (hi - lo) AS c FROM z, b)"""


def anomaly_scores(t):
    return t.events.select((-F.col("value") / 500).alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), (F.col("value") > 100).alias("is_anomaly"))


@query(
    "m9_anomaly_calibration",
    "score_min:d score_max:d calibrated_mean:d calibrated_std:d optimal_threshold:d optimal_f1:d",
    f"""WITH {ANOMALY_SQL}, t AS (SELECT p, quantile_cont(c, p) AS th FROM k, (VALUES (0.5), (0.6), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95)) v(p) GROUP BY p),
    f AS (SELECT th, 2.0 * count(*) FILTER (label = 1 AND c >= th) / (count(*) FILTER (c >= th) + count(*) FILTER (label = 1)) AS f1 FROM t, k GROUP BY th)
    SELECT (SELECT lo FROM b) AS score_min, (SELECT hi FROM b) AS score_max, (SELECT avg(c) FROM k) AS calibrated_mean, (SELECT stddev_pop(c) FROM k) AS calibrated_std,
      (SELECT th FROM f ORDER BY round(f1, 12) DESC, th LIMIT 1) AS optimal_threshold, (SELECT max(f1) FROM f) AS optimal_f1""".replace("quantile_cont(c, p)", "quantile_cont(c, [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])[list_position([0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95], p)]"),
)
def _(t):
    return train.calibrate(anomaly_scores(t), "score", "label")


@query(
    "m20_anomaly_evaluation",
    "auroc:d precision:d recall:d f1_score:d n_anomalies:l anomaly_rate:d",
    """WITH z AS (SELECT value, event_type = 'error' AS y, value > 100 AS hit FROM events), g AS (SELECT value, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM z GROUP BY 1),
    c AS (SELECT *, sum(p) OVER (ORDER BY value DESC) AS tp FROM g)
    SELECT (SELECT sum(n * (tp - p / 2)) / (sum(p) * sum(n)) FROM c) AS auroc, count(*) FILTER (y AND hit) / count(*) FILTER (hit) AS precision,
      count(*) FILTER (y AND hit) / count(*) FILTER (y) AS recall, 2 * count(*) FILTER (y AND hit) / (count(*) FILTER (y) + count(*) FILTER (hit)) AS f1_score,
      count(*) FILTER (hit) AS n_anomalies, count(*) FILTER (hit) / count(*) AS anomaly_rate FROM z""",
)
def _(t):
    return train.anomaly_evaluation(anomaly_scores(t), "label")


# -- scoring ---------------------------------------------------------------------------------

PROB_SQL = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS a, l_discount * 10 AS b, 1 / (1 + exp(-(l_tax * 40 - 1.5))) AS c FROM lineitem)"""


def probabilities(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"),
        score.linear_probability({"l_tax": 40.0}, -1.5).alias("c"),
    )


LINE_KEYS = "l_orderkey:l l_linenumber:l l_partkey:l"


@query(
    "m10_linear_batch_scoring",
    f"{LINE_KEYS} c:d label:l",
    f"WITH {PROB_SQL} SELECT l_orderkey, l_linenumber, l_partkey, c, (c >= 0.5)::INT AS label FROM p",
)
def _(t):
    return probabilities(t).withColumn("label", (F.col("c") >= 0.5).cast("int"))


@query(
    "m11_ensemble_combine",
    f"{LINE_KEYS} weighted:d mean:d highest:d median:d",
    f"WITH {PROB_SQL} SELECT l_orderkey, l_linenumber, l_partkey, 0.5 * a + 0.3 * b + 0.2 * c AS weighted, (a + b + c) / 3 AS mean, greatest(a, b, c) AS highest, list_sort([a, b, c])[2] AS median FROM p",
)
def _(t):
    cols = [F.col(x) for x in "abc"]
    return probabilities(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", score.combine(cols, weights=[0.5, 0.3, 0.2]).alias("weighted"),
        score.combine(cols, "simple_average").alias("mean"), score.combine(cols, "max").alias("highest"), score.combine(cols, "median").alias("median"),
    )


@query(
    "m12_ensemble_confidence",
    f"{LINE_KEYS} agreement:d variance:d entropy:d",
    f"""WITH {PROB_SQL}, q AS (SELECT *, (a + b + c) / 3 AS mu FROM p), r AS (SELECT *, ((a - mu) ** 2 + (b - mu) ** 2 + (c - mu) ** 2) / 3 AS v FROM q)
    SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(1, 1 - sqrt(v) / 0.5)) AS agreement, greatest(0, least(1, 1 - v / 0.25)) AS variance,
      greatest(0, least(1, 1 + mu * log2(mu + 1e-10) + (1 - mu) * log2(1 - mu + 1e-10))) AS entropy FROM r""",
)
def _(t):
    cols = [F.col(x) for x in "abc"]
    return probabilities(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", *[score.confidence(cols, k).alias(k) for k in ("agreement", "variance", "entropy")]
    )


BAND = "CASE WHEN s <= 25 THEN 'low' WHEN s <= 50 THEN 'moderate' WHEN s <= 75 THEN 'high' ELSE 'critical' END"


@query(
    "m13_ensemble_score_rows",
    "risk_level:s alert:b n:l mean_score:d mean_confidence:d",
    f"""WITH {PROB_SQL}, q AS (SELECT 100 * (a + b + c) / 3 AS s, (a + b + c) / 3 AS mu, a, b, c FROM p)
    SELECT {BAND} AS risk_level, s > 75 AS alert, count(*) AS n, avg(s) AS mean_score,
      avg(greatest(0, least(1, 1 - sqrt(((a - mu) ** 2 + (b - mu) ** 2 + (c - mu) ** 2) / 3) / 0.5))) AS mean_confidence FROM q GROUP BY 1, 2""",
)
def _(t):
    return score.ensemble_scores(probabilities(t), ["a", "b", "c"]).groupBy("risk_level", "alert").agg(
        F.count("*").alias("n"), F.avg("risk_score").alias("mean_score"), F.avg("confidence").alias("mean_confidence")
    )


# -- explaining ------------------------------------------------------------------------------

MODEL = explain.LinearModel(
    {"l_quantity": 1.4, "l_discount": -0.9, "l_tax": 0.6}, 0.3137, {"l_quantity": 25.3, "l_discount": 0.0513, "l_tax": 0.0407}, {"l_quantity": 14.0, "l_discount": 0.03, "l_tax": 0.03}
)
SCALED_SQL = "x AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity AS oq, l_discount AS od, l_tax AS ot, (l_quantity - 25.3::DOUBLE) / 14.0 AS q, (l_discount - 0.0513::DOUBLE) / 0.03 AS d, (l_tax - 0.0407::DOUBLE) / 0.03 AS t FROM lineitem)"


@query(
    "m14_k5_global_importance",
    "feature:s importance:d",
    f"""WITH {SCALED_SQL}, mu AS (SELECT avg(q) AS q, avg(d) AS d, avg(t) AS t FROM x)
    SELECT 'l_quantity' AS feature, avg(abs(1.4 * (x.q - mu.q))) AS importance FROM x, mu UNION ALL SELECT 'l_discount', avg(abs(-0.9 * (x.d - mu.d))) FROM x, mu
    UNION ALL SELECT 'l_tax', avg(abs(0.6 * (x.t - mu.t))) FROM x, mu""",
)
def _(t):
    return explain.global_importance(explain.contributions(t.lineitem, MODEL, ["l_orderkey"]), 3)


@query(
    "m14_contributions",
    "l_orderkey:l l_partkey:l feature:s phi:d",
    f"""WITH {SCALED_SQL}, mu AS (SELECT avg(q) AS q, avg(d) AS d, avg(t) AS t FROM x)
    SELECT l_orderkey, l_partkey, 'l_quantity' AS feature, 1.4 * (x.q - mu.q) AS phi FROM x, mu UNION ALL SELECT l_orderkey, l_partkey, 'l_discount', -0.9 * (x.d - mu.d) FROM x, mu
    UNION ALL SELECT l_orderkey, l_partkey, 'l_tax', 0.6 * (x.t - mu.t) FROM x, mu""",
)
def _(t):
    return explain.contributions(t.lineitem, MODEL, ["l_orderkey", "l_partkey"])


SIG = "100 / (1 + exp(-({})))"


@query(
    "m15_counterfactuals",
    "l_orderkey:l l_partkey:l current_score:d counterfactual_score:d counterfactual_risk_level:s n_changes:l achieved_target:b",
    f"""WITH RECURSIVE {SCALED_SQL}, b AS (SELECT *, row_number() OVER () AS id, 0.3137 + 1.4 * q - 0.9 * d + 0.6 * t AS lg FROM x),
    u AS (SELECT id, unnest([1, 2, 3]) AS i, unnest([1.4, -0.9, 0.6]) AS w, unnest([q, d, t]) AS v FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(w * v) DESC, i) AS rk FROM u),
    f AS (SELECT id, 0 AS rk, lg, {SIG.format('lg')} > 50 AS falling, {SIG.format('lg')} > 25 AND {SIG.format('lg')} <= 50 AS done, 0 AS n FROM b
      UNION ALL SELECT f.id, f.rk + 1, f.lg + r.w * CASE WHEN falling THEN -1 ELSE 1 END * CASE WHEN r.w * r.v > 0 THEN 1 ELSE -1 END * greatest(abs(r.v * 0.1), 0.5), falling,
        CASE WHEN falling THEN {SIG.format('f.lg + r.w * -1 * CASE WHEN r.w * r.v > 0 THEN 1 ELSE -1 END * greatest(abs(r.v * 0.1), 0.5)')} <= 50
          ELSE {SIG.format('f.lg + r.w * CASE WHEN r.w * r.v > 0 THEN 1 ELSE -1 END * greatest(abs(r.v * 0.1), 0.5)')} >= 26 END, n + 1
      FROM f JOIN r ON r.id = f.id AND r.rk = f.rk + 1 WHERE NOT f.done AND f.rk < 2),
    l AS (SELECT id, max_by(lg, rk) AS lg, max(n) AS n FROM f GROUP BY 1), o AS (SELECT b.l_orderkey, b.l_partkey, {SIG.format('b.lg')} AS s0, {SIG.format('l.lg')} AS s, n FROM b JOIN l USING (id))
    SELECT l_orderkey, l_partkey, s0 AS current_score, s AS counterfactual_score, {BAND} AS counterfactual_risk_level, n AS n_changes, {BAND} = 'moderate' AS achieved_target FROM o""",
)
def _(t):
    cf = explain.counterfactuals(t.lineitem, MODEL, ["l_orderkey", "l_partkey"], target="moderate", max_changes=2)
    return cf.withColumn("n_changes", F.size("changes"))


@query("m16_surrogate_rules", "rule_text:s prediction:s confidence:d n_samples:l fidelity:d")
def _(t):
    scored = t.lineitem.withColumn("risk", MODEL.score())
    return explain.surrogate_rules(scored, ["l_quantity", "l_discount", "l_tax"], "risk")


@query(
    "m17_m21_simple_texts",
    f"{LINE_KEYS} counterfactual:s rule:s",
    f"""WITH {PROB_SQL}, q AS (SELECT *, 100 * a AS s, CASE WHEN b > 0.5 THEN 'discount' END AS f FROM p), z AS (SELECT *, {BAND} AS lv FROM q)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lv IN ('high', 'critical') THEN coalesce('Improving ' || f || ' could reduce risk level. Consider interventions targeting this factor.',
      'Multiple factors contribute to elevated risk.') ELSE 'Current risk level is within acceptable range.' END AS counterfactual,
      coalesce('IF ' || f || ' is elevated THEN risk is ' || lv, 'Risk classified as ' || lv) AS rule FROM z""",
)
def _(t):
    from tidemark.functions.common import risk_level

    level = F.upper(risk_level(F.col("a") * 100))
    feature = F.when(F.col("b") > 0.5, "discount")
    return probabilities(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", explain.simple_counterfactual(level, feature).alias("counterfactual"), explain.simple_rule(level, feature).alias("rule")
    )


@query(
    "m21_explanation_bundle",
    "l_orderkey:l l_partkey:l l_linenumber:l l_extendedprice:d current_risk_level:s n_tops:l first_line:s reached:b top_phi:d second_phi:d third_phi:d simple_rule:s",
    f"""WITH {SCALED_SQL}, mu AS (SELECT avg(q) AS mq, avg(d) AS md, avg(t) AS mt FROM x),
    o AS (SELECT *, {SIG.format('0.3137 + 1.4 * q - 0.9 * d + 0.6 * t')} AS s, 1.4 * (q - mq) AS pq, -0.9 * (d - md) AS pd, 0.6 * (t - mt) AS pt,
      list_sort([(-abs(1.4 * (q - mq)), 'l_quantity', 1.4 * (q - mq)), (-abs(-0.9 * (d - md)), 'l_discount', -0.9 * (d - md)), (-abs(0.6 * (t - mt)), 'l_tax', 0.6 * (t - mt))]) AS tops FROM x, mu)
    SELECT o.l_orderkey, o.l_partkey, l_linenumber, o.l_extendedprice, {BAND} AS current_risk_level, 3 AS n_tops, 'Key Contributing Factors:' AS first_line, true AS reached,
      tops[1][3] AS top_phi, tops[2][3] AS second_phi, tops[3][3] AS third_phi, 'IF ' || tops[1][2] || ' is elevated THEN risk is ' || {BAND} AS simple_rule
    FROM o JOIN lineitem l ON l.l_orderkey = o.l_orderkey AND l.l_partkey = o.l_partkey AND l.l_extendedprice = o.l_extendedprice""",
)
def _(t):
    keys = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"]
    out = explain.explanation_bundle(t.lineitem, MODEL, keys)
    # the text closes with the sentence that fits whether the target was reached
    fits = F.when(F.size("changes") == 0, F.contains("summary", F.lit("No changes needed"))).otherwise(
        F.contains("summary", F.lit("successfully move")) == F.col("achieved_target")
    )
    phis = {f"{name}_phi": F.get(F.col("top_features"), F.lit(i))["phi"] for i, name in enumerate(("top", "second", "third"))}
    return out.withColumns({"n_tops": F.size("top_features"), "first_line": F.substring_index("summary", "\n", 1), "reached": fits, **phis})


# -- search and index ------------------------------------------------------------------------


@query(
    "m18_z3_trials",
    "trial:l score:d error:s",
    """SELECT i AS trial, CASE WHEN c > 0 THEN w * (SELECT avg(value) FROM events WHERE value > c) END AS score, CASE WHEN c < 0 THEN 'cut must be positive' END AS error
    FROM (VALUES (0, 10.0, 1), (1, 10.0, 2), (2, 50.0, 1), (3, 50.0, 2), (4, -1.0, 1), (5, -1.0, 2)) v(i, c, w)""",
)
def _(t):
    trials = train.grid_trials({"cut": [10.0, 50.0, -1.0], "weight": [1.0, 2.0]})

    def objective(p):
        if p["cut"] < 0:
            raise ValueError("cut must be positive")
        return p["weight"] * t.events.filter(F.col("value") > p["cut"]).agg(F.avg("value")).first()[0]

    return train.run_trials(t.spark, trials, objective)


@query(
    "m18_random_trials",
    "trial:l cut:d score:d",
    """WITH d AS (SELECT i, CAST('0x' || substr(md5('42|cut|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, CAST('0x' || substr(md5('42|weight|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS v,
      CAST('0x' || substr(md5('42|kind|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS c FROM range(0, 12) r(i)),
    p AS (SELECT i, exp(ln(5.0::DOUBLE) + u * (ln(100.0::DOUBLE) - ln(5.0::DOUBLE))) AS cut, 1 + CAST(floor(v * 3) AS INT) AS w, ['click', 'view', 'error'][1 + CAST(floor(c * 3) AS INT)] AS kind FROM d)
    SELECT i AS trial, cut, w * (SELECT avg(value) FROM events WHERE value > cut AND event_type = kind) AS score FROM p""",
)
def _(t):
    space = {"cut": {"type": "float", "low": 5.0, "high": 100.0, "log": True}, "weight": {"type": "int", "low": 1, "high": 3}, "kind": {"type": "categorical", "choices": ["click", "view", "error"]}}

    def objective(p):
        return p["weight"] * t.events.filter((F.col("value") > p["cut"]) & (F.col("event_type") == p["kind"])).agg(F.avg("value")).first()[0]

    return train.run_trials(t.spark, train.random_trials(space, 12), objective).withColumn("cut", F.col("params")["cut"].cast("double"))


@query(
    "m18_search_advice",
    "advice:s",
    "SELECT unnest(CASE WHEN count(*) < 50 THEN ['run more trials', 'use a guided search'] ELSE ['use a guided search'] END) AS advice FROM events",
)
def _(t):
    trials = t.events.select(F.col("event_id").alias("trial"), F.col("value").alias("score"))
    return train.search_advice(train.trial_statistics(trials), "random")


@query(
    "a32_trial_statistics",
    "n_trials:l mean:d std:d min:d max:d median:d best_trial:l",
    """SELECT count(*) AS n_trials, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median,
      arg_max(event_id, (value, -event_id)) AS best_trial FROM events""",
)
def _(t):
    return train.trial_statistics(t.events.select(F.col("event_id").alias("trial"), F.col("value").alias("score")))


@query(
    "m19_listed_models",
    "model_id:l status:s",
    "SELECT o_orderkey AS model_id, 'active' AS status FROM orders WHERE o_custkey % 5 = 2 AND o_orderstatus <> 'P'",
)
def _(t):
    index = t.orders.select(
        F.col("o_orderkey").alias("model_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("model_type"),
        F.when(F.col("o_orderstatus") == "P", "retired").otherwise("active").alias("status"), F.col("o_orderdate").alias("registered_at"),
    )
    return train.list_models(index, "t2", "active")


@query(
    "m11_weights_from_scores",
    "l_orderkey:l l_linenumber:l l_partkey:l mixed:d",
    f"""WITH {PROB_SQL}, w AS (SELECT avg(a) AS x, avg(b) AS y FROM p) SELECT l_orderkey, l_linenumber, l_partkey, (a * x + b * y) / (x + y) AS mixed FROM p, w""",
)
def _(t):
    p = probabilities(t)
    row = p.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()  # the models' validation scores
    weights = score.weights_from_scores(row.asDict())
    return p.withColumn("mixed", F.col("a") * weights[0] + F.col("b") * weights[1])


@query(
    "m19_active_models",
    "model_type:s model_id:l",
    """SELECT 't' || o_custkey AS model_type, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS model_id FROM orders
    WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""",
)
def _(t):
    index = t.orders.select(
        F.col("o_orderkey").alias("model_id"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("model_type"),
        F.when(F.col("o_orderstatus") == "P", "retired").otherwise("active").alias("status"), F.col("o_orderdate").alias("registered_at"), "o_custkey",
    )
    debtors = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    gone = index.join(debtors, "o_custkey", "left_semi").select("model_id")
    return train.active_models(train.retire_models(index, gone))


# -- screening -------------------------------------------------------------------------------

SCREEN_SQL = f"""{CONSENT_SQL}, f AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) / 1000 AS spend FROM orders GROUP BY 1),
k AS (SELECT r.o_orderkey, r.o_custkey, consent_status, n_orders, spend, o_orderkey % 12 = 0 AS bad FROM r JOIN st USING (o_orderkey) LEFT JOIN f USING (o_custkey)),
g AS (SELECT *, NOT bad AND consent_status = 'valid' AND n_orders IS NOT NULL AS passed, 1 / (1 + exp(-(0.02 * spend - 0.1 * n_orders - 3))) AS p1, 1 / (1 + exp(-(0.03 * spend - 6))) AS p2 FROM k),
h AS (SELECT *, CASE WHEN passed THEN 100 * (0.6 * p1 + 0.4 * p2) END AS s FROM g)"""


@query(
    "g13_batch_screening",
    "request_id:l passed:b n_errors:l risk_score:d risk_level:s requires_human_review:b n_recommendations:l",
    f"""WITH {SCREEN_SQL} SELECT o_orderkey AS request_id, passed, bad::INT + (consent_status <> 'valid')::INT + (n_orders IS NULL)::INT AS n_errors, s AS risk_score,
      CASE WHEN passed THEN {BAND} ELSE 'unknown' END AS risk_level, NOT passed OR s > 75 AS requires_human_review, CASE WHEN passed THEN CASE WHEN s > 75 THEN 4 ELSE 5 END END AS n_recommendations FROM h""",
)
def _(t):
    record = F.to_json(
        F.struct(
            F.concat(F.lit("s-"), F.col("o_orderkey").cast("string")).alias("survey_id"), F.lit("2024-01-01").alias("timestamp"),
            F.struct(F.when(F.col("o_orderkey") % 12 == 0, 99).otherwise(5).alias("mood_score")).alias("responses"),
        )
    )
    both = F.array(F.lit("survey"), F.lit("wearable"))
    requests = t.orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("anonymized_id"), F.lit("survey").alias("source_type"), record.alias("record"),
        F.when(F.col("o_orderstatus") == "F", both).otherwise(F.array(F.lit("survey"))).alias("data_types"),
    )
    feats = t.orders.groupBy(F.col("o_custkey").alias("anonymized_id")).agg(F.count("*").alias("n_orders"), (F.avg("o_totalprice") / 1000).alias("spend"))
    models = [explain.LinearModel({"spend": 0.02, "n_orders": -0.1}, -3.0), explain.LinearModel({"spend": 0.03}, -6.0)]
    out = screening.screen_batch(requests, consents(t), feats, models, [0.6, 0.4], catalog.default_catalog(t.spark), at("1998-01-01"))
    return out.withColumns({"n_errors": F.size("errors"), "n_recommendations": F.size("recommendations")})
