"""Fitted models as tables: their scores replayed in SQL from the weights and nodes alone."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import score, train

FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(600).select(
        F.col("id").alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("x1"), ((F.col("id") * 53) % 89).cast("double").alias("x2"), (F.col("id") % 7).cast("double").alias("x3")
    )
    return df.withColumn("label", ((F.col("x1") + F.col("x3") * 5 + F.pmod(F.xxhash64("k"), F.lit(40))) > 85).cast("int")).cache()


def replayed(rows, nodes, leaf):
    """The leaf of every row and tree, found by a recursive query over the table of nodes."""
    con = duckdb.connect()
    con.register("points", rows[["k", *FEATURES]])
    con.register("nodes", nodes)
    return con.execute(f"""WITH RECURSIVE p AS (SELECT k, unnest(['x1', 'x2', 'x3']) AS f, unnest([x1, x2, x3]) AS v FROM points),
        w AS (SELECT k, tree, node FROM points, (SELECT tree, min(node) AS node FROM nodes GROUP BY 1)
          UNION ALL SELECT w.k, w.tree, CASE WHEN {leaf} THEN n."left" ELSE n."right" END FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN p ON p.k = w.k AND p.f = n.feature)
        SELECT w.k, n.* FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature = ''""").df()


def test_logistic_scores_follow_from_its_weights(data):
    model, params, auc = train.train_logistic(data, FEATURES, "label", ["k"], grid={"C": [1.0], "penalty": ["l2"], "class_weight": [None]}, folds=2)
    terms = train.linear_terms(model)
    rows = score.score_with_model(data, model).toPandas()
    con = duckdb.connect()
    con.register("rows", rows)
    logit = " + ".join(f"({w!r}) * {c}" if c else f"({w!r})" for c, w in terms.items())
    worst = con.execute(f"SELECT max(abs(probability_1 - 1 / (1 + exp(-({logit}))))) FROM rows").fetchone()[0]
    assert worst < 1e-9 and 0.7 < auc <= 1 and params["C"] == 1.0


def test_boosted_scores_follow_from_the_nodes(data):
    fit, val = data.filter("k % 5 > 0"), data.filter("k % 5 = 0")
    model, _, auc = train.train_boosted(fit, val, FEATURES, "label", ["k"], grid={"max_depth": [3], "learning_rate": [0.1]}, folds=2, max_iter=6)
    rows = score.score_with_model(data, model).toPandas()
    leaves = replayed(rows, train.tree_nodes(model), "p.v <= n.threshold")
    margin = (leaves.value * leaves.weight).groupby(leaves.k).sum()
    for k, p in zip(rows.k, rows.probability_1):
        assert p == pytest.approx(1 / (1 + math.exp(-2 * margin[k])), abs=1e-9)
    assert 0.7 < auc <= 1


def test_forest_scores_follow_from_the_nodes(data):
    forest = train.fit_isolation_forest(data, FEATURES, ["k"], n_trees=12, sample_size=64)
    rows = forest.predict(data).toPandas()
    nodes = forest.trees.assign(feature=[FEATURES[f] if f >= 0 else "" for f in forest.trees.feature])
    leaves = replayed(rows, nodes, "p.v < n.threshold")
    depth = leaves.path.groupby(leaves.k).mean()
    want = pd.Series(-(2.0 ** -(depth / train._average_path(64))))
    assert max(abs(want[k] - s) for k, s in zip(rows.k, rows.score)) < 1e-12
    # the cut is the exact tenth percentile of the scores
    assert forest.offset == pytest.approx(rows.score.quantile(0.1)) and (rows.is_anomaly == (rows.score < forest.offset)).all()


def test_logistic_search_equals_cross_validation_with_models(data, monkeypatch):
    """The averages of the search are those of Spark's own cross validation, and no held-out row goes through a fitted model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    from tidemark.operators import split

    base = LogisticRegression(maxIter=100, standardization=False)
    maps = [{base.regParam: 1.0 / (c * 600), base.elasticNetParam: e} for c in (0.001, 1.0) for e in (1.0, 0.0)]
    folded = split.stratified_folds(data, "label", ["k"], 3).withColumn("label", F.col("label").cast("double"))
    flow = Pipeline(stages=[*train._assemble(FEATURES, True), base])
    want = CrossValidator(estimator=flow, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(), numFolds=3, foldCol="fold").fit(folded).avgMetrics

    def refused(self, *_):
        raise AssertionError("a model was sent to the tasks")

    monkeypatch.setattr(LogisticRegressionModel, "transform", refused)
    _, params, auc = train.train_logistic(data, FEATURES, "label", ["k"], grid={"C": [0.001, 1.0], "penalty": ["l1", "l2"], "class_weight": [None]}, folds=3)
    assert auc == pytest.approx(max(want), abs=1e-9)
    assert params == {"C": [0.001, 1.0][want.index(max(want)) // 2], "penalty": ["l1", "l2"][want.index(max(want)) % 2], "class_weight": None}
