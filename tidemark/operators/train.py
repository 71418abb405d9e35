"""Model fitting on Spark ML, isolation forest, and parameter search as a table of trials."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.common import count_if
from tidemark.operators.evaluate import auroc
from tidemark.operators.ordered import attach, exact_quantiles, hash_rank, latest_per_key, top_k_per_key
from tidemark.operators.score import calibrated_score, calibration_bounds
from tidemark.operators.split import class_counts, stratified_folds
from tidemark.session import checkpointed, written

# Default search grids.
LOGISTIC_GRID = {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"], "class_weight": ["balanced", None]}
BOOST_GRID = {"max_depth": [5, 10], "learning_rate": [0.01, 0.05, 0.1]}
CUT_PERCENTILES = [50, 60, 70, 75, 80, 85, 90, 95]
DEFAULT_CUT = 75.0


def _assemble(features: Sequence[str], scaled: bool) -> list:
    if not scaled:
        return [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")]
    return [
        VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="error"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def _balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Add ``_weight``: n / (classes · class size)."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    weight = F.lit(1.0)
    for v, c in counts.items():
        weight = F.when(F.col(label) == F.lit(v), F.lit(n / (len(counts) * c))).otherwise(weight)
    return df.withColumn("_weight", weight)


def train_logistic(
    df: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], grid: dict | None = None, folds: int = 5,
    search: str = "grid", n_random: int = 20, seed: int = 42, parallelism: int = 4,
):
    """Standardize, search C × penalty × class weight by cross-validated AUROC, refit the best.

    Returns ``(model, best_params, best_auc)``. Folds are stratified and repeatable. The rows are
    read once, and every fold is standardized once for all points of the grid. Held-out rows are
    scored by an expression on the fitted weights, so no fitted model travels to the tasks.
    """
    grid = {**LOGISTIC_GRID, **(grid or {})}
    df = written(df.select(*dict.fromkeys([*id_cols, *features, label])), "labelled")
    n = df.count()
    folded = _balanced_weight(stratified_folds(df, label, id_cols, folds, seed), label).withColumn("label", F.col(label).cast("double"))
    data = written(folded.select(*features, "label", "fold", "_weight"), "folds")  # every fit reads it
    k = min(folds, min(class_counts(df, label).values()))
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    rng = random.Random(seed)
    points = []
    for class_weight in grid["class_weight"]:
        combos = list(itertools.product(grid["C"], grid["penalty"]))
        if search == "random":
            combos = rng.sample(combos, min(len(combos), max(1, n_random // len(grid["class_weight"]))))
        points += [{"C": c, "penalty": p, "class_weight": class_weight} for c, p in combos]

    def estimator(params: dict) -> LogisticRegression:
        base = LogisticRegression(
            featuresCol="features", labelCol="label", maxIter=100, standardization=False, regParam=1.0 / (params["C"] * n), elasticNetParam=1.0 if params["penalty"] == "l1" else 0.0
        )
        return base.setWeightCol("_weight") if params["class_weight"] == "balanced" else base

    found = []
    for fold in range(k):
        scale = Pipeline(stages=_assemble(features, True)).fit(data.filter(F.col("fold") != fold))
        # cached as numbers: what the expression reads and what the fits read
        fit = scale.transform(data.filter(F.col("fold") != fold)).select("features", "label", "_weight").persist()
        held_out = scale.transform(data.filter(F.col("fold") == fold)).select(vector_to_array("features").alias("_x"), "label").persist()

        def measure(params: dict) -> float:
            model = estimator(params).fit(fit)
            margin = sum((F.col("_x")[i] * F.lit(float(w)) for i, w in enumerate(model.coefficients.toArray())), F.lit(0.0)) + F.lit(float(model.intercept))
            return evaluator.evaluate(held_out.select(margin.alias("rawPrediction"), "label"))

        with ThreadPool(min(parallelism, len(points))) as pool:
            found.append(pool.map(inheritable_thread_target(df.sparkSession)(measure), points))
        fit.unpersist()
        held_out.unpersist()
    averages = np.mean(found, axis=0)
    best = int(np.argmax(averages))
    model = Pipeline(stages=[*_assemble(features, True), estimator(points[best])]).fit(data)
    return model, points[best], float(averages[best])


def train_boosted(
    train: DataFrame, val: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], grid: dict | None = None,
    folds: int = 5, max_iter: int = 50, seed: int = 42, parallelism: int = 4,
):
    """Boosted trees: depth × learning rate by cross-validated AUROC, final fit stopped early on ``val``."""
    grid = {**BOOST_GRID, **(grid or {})}
    folded = stratified_folds(train, label, id_cols, folds, seed).withColumn("label", F.col(label).cast("double"))
    data = written(folded.select(*features, "label", "fold"), "folds")  # every fit reads it
    k = min(folds, min(class_counts(train, label).values()))
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    base = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, seed=seed)
    maps = ParamGridBuilder().addGrid(base.maxDepth, grid["max_depth"]).addGrid(base.stepSize, grid["learning_rate"]).build()
    cv = CrossValidator(
        estimator=Pipeline(stages=[*_assemble(features, False), base]), estimatorParamMaps=maps, evaluator=evaluator, numFolds=k,
        foldCol="fold", parallelism=parallelism, seed=seed,
    )
    fitted = cv.fit(data)
    i = max(range(len(maps)), key=lambda j: fitted.avgMetrics[j])
    params = {"max_depth": maps[i][base.maxDepth], "learning_rate": maps[i][base.stepSize]}
    both = (
        train.select(*features, F.col(label).cast("double").alias("label"), F.lit(False).alias("_is_val"))
        .unionByName(val.select(*features, F.col(label).cast("double").alias("label"), F.lit(True).alias("_is_val")))
    )
    final = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=max_iter, seed=seed, maxDepth=params["max_depth"], stepSize=params["learning_rate"],
        validationIndicatorCol="_is_val",
    )
    model = Pipeline(stages=[*_assemble(features, False), final]).fit(both)
    return model, params, fitted.avgMetrics[i]


def linear_terms(model) -> dict[str, float]:
    """Weight per raw feature, and ``""`` for the intercept, of a fitted logistic pipeline: the scaler is folded in."""
    assembler, final = model.stages[0], model.stages[-1]
    scaler = next((s for s in model.stages if hasattr(s, "std")), None)
    weights, intercept = final.coefficients.toArray(), float(final.intercept)
    if scaler is not None:
        mean, std = scaler.mean.toArray(), scaler.std.toArray()
        weights = np.where(std > 0, weights / np.where(std > 0, std, 1.0), 0.0)
        intercept -= float(weights @ mean)
    return {**dict(zip(assembler.getInputCols(), map(float, weights))), "": intercept}


def tree_nodes(model) -> pd.DataFrame:
    """The nodes of a fitted boosted-trees pipeline: ``tree, node, feature, threshold, left, right, value, weight``.

    A row goes left if its feature is at most the threshold; ``feature`` is empty in a leaf. The
    probability is that of twice the weighted sum of the leaves' values.
    """
    final, names = model.stages[-1], model.stages[0].getInputCols()
    rows: list[list] = []

    def add(tree: int, node, weight: float) -> int:
        at = len(rows)
        rows.append([tree, at, "", 0.0, -1, -1, float(node.prediction()), weight])
        if node.getClass().getSimpleName() != "LeafNode":
            rows[at][2:4] = [names[node.split().featureIndex()], float(node.split().threshold())]
            rows[at][4:6] = [add(tree, node.leftChild(), weight), add(tree, node.rightChild(), weight)]
        return at

    for i, (tree, weight) in enumerate(zip(final.trees, final.treeWeights)):
        add(i, tree._call_java("rootNode"), float(weight))
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "value", "weight"])


# -- isolation forest ------------------------------------------------------------------------

_TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(pdf: pd.DataFrame, seed: int, columns: list[str]) -> pd.DataFrame:
    """One isolation tree from at most ``sample size`` rows."""
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    points = pdf.sort_values(columns)[columns].to_numpy(dtype=float)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([tree, at, -1, 0.0, -1, -1, depth + _average_path(len(rows))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        mask = rows[:, f] < cut
        if not mask.any() or mask.all():
            return at
        left = add(rows[mask], depth + 1)
        right = add(rows[~mask], depth + 1)
        nodes[at][2:6] = [f, cut, left, right]
        return at

    add(points, 0)
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])


class IsolationForest:
    """Fitted trees (a table bounded by trees × 2 · sample size rows) and the score cut."""

    def __init__(self, features: Sequence[str], trees: pd.DataFrame, sample_size: int, offset: float | None = None):
        self.features, self.trees, self.sample_size, self.offset = list(features), trees, sample_size, offset

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Raw score per row, at most 0; lower is more anomalous."""
        trees = [g.sort_values("node") for _, g in self.trees.groupby("tree")]
        packed = [
            (g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(), g["path"].to_numpy()) for g in trees
        ]
        shared = df.sparkSession.sparkContext.broadcast(packed)
        norm = max(_average_path(self.sample_size), 1e-9)

        @F.pandas_udf("double")
        def raw(x: pd.DataFrame) -> pd.Series:
            points = x.to_numpy(dtype=float)
            total = np.zeros(len(points))
            for feature, cut, left, right, path in shared.value:
                at = np.zeros(len(points), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    rows = np.flatnonzero(inner)
                    here = at[rows]
                    goes_left = points[rows, f[rows]] < cut[here]
                    at[rows] = np.where(goes_left, left[here], right[here])
                total += path[at]
            return pd.Series(-np.power(2.0, -(total / len(shared.value)) / norm))

        inputs = F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])
        return df.withColumn(name, raw(inputs))

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.score(df)
        return scored.withColumn("is_anomaly", F.col("score") < F.lit(self.offset))


def fit_isolation_forest(
    df: DataFrame, features: Sequence[str], id_cols: Sequence[str], n_trees: int = 100, sample_size: int = 256, contamination: float = 0.1, seed: int = 42
) -> IsolationForest:
    """Trees grow in parallel, each from its own hash-chosen sample; the cut is an exact percentile.

    A row joins a tree if a hash of both falls under a share that gives each tree a few times
    ``sample_size`` rows, the algorithm's bound per tree; of these the lowest hashes stay. The
    small list of trees is filtered inside the row, so rows are not copied per tree, and the
    rule is the same for every number of rows.
    """
    features = list(features)
    data = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    size = data.count()
    share = min(1.0, (2 * sample_size + 64) / max(size, 1))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, *id_cols).alias("h")))
    few = F.filter(drawn, lambda x: F.pmod(x["h"], F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    dealt = data.select(*features, F.explode(few).alias("_d")).select(*features, "_d.tree", "_d.h")
    dealt = checkpointed(top_k_per_key(dealt, ["tree"], [F.asc("h")], sample_size, "_r"))
    sample_size = min(sample_size, max(size, 1))
    trees = dealt.select("tree", *features).groupBy("tree").applyInPandas(lambda p: _grow(p, seed, features), _TREE_SCHEMA).toPandas()
    forest = IsolationForest(features, trees, sample_size)
    cut = exact_quantiles(forest.score(data), [], "score", [contamination]).first()["q"][0]
    forest.offset = float(cut)
    return forest


def calibrate(scores: DataFrame, score: str = "score", label: str | None = None) -> DataFrame:
    """Score range, calibrated mean and deviation, and with labels the cut of best F1.

    The eight candidate cuts are percentiles of the calibrated score; each row is counted at
    the cuts it reaches.
    """
    bounds = calibration_bounds(scores, score)
    data = attach(scores, bounds).withColumn("_c", calibrated_score(F.col(score), F.col("score_min"), F.col("score_max")))
    row = data.agg(
        F.first("score_min").alias("score_min"), F.first("score_max").alias("score_max"), F.avg("_c").alias("calibrated_mean"), F.stddev_pop("_c").alias("calibrated_std")
    )
    if label is None:
        return row
    cuts = exact_quantiles(data, [], "_c", [p / 100 for p in CUT_PERCENTILES], name="_cuts")
    reached = attach(data, cuts).withColumn("_k", F.size(F.filter("_cuts", lambda x: x <= F.col("_c"))))
    # a row that reaches k cuts reaches the first k of them, as cuts rise
    cells = reached.groupBy("_k").agg(count_if(F.col(label) == 1).alias("_tp"), count_if(F.col(label) != 1).alias("_fp"))
    totals = cells.agg(F.sum("_tp").alias("_pos"))
    grid = attach(cuts.select(F.posexplode("_cuts").alias("_i", "threshold")), totals)
    per = cells.filter("_k > 0").select(F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_i"), "_tp", "_fp").groupBy("_i").agg(F.sum("_tp").alias("_tp"), F.sum("_fp").alias("_fp"))
    both = 2 * F.col("_tp") + F.col("_fp") + (F.col("_pos") - F.col("_tp"))
    f1 = F.when(both > 0, 2 * F.col("_tp") / F.when(both > 0, both)).otherwise(F.lit(0.0))
    scored = grid.join(per, "_i", "left").fillna(0, ["_tp", "_fp"]).withColumn("_f1", f1)
    best = scored.agg(
        F.coalesce(F.max_by("threshold", F.when(F.col("_f1") > 0, F.struct(F.round("_f1", 12), -F.col("_i")))), F.lit(DEFAULT_CUT)).alias("optimal_threshold"),
        F.max("_f1").alias("optimal_f1"),
    )
    return attach(row, best)


def anomaly_evaluation(scores: DataFrame, label: str, score: str = "score", flagged: str = "is_anomaly") -> DataFrame:
    """AUROC of the inverted score, precision, recall, F1 and rate at the cut, as one row."""
    curve = auroc(scores.withColumn("_s", -F.col(score)), label, "_s").select("auroc")
    y, hit = F.col(label) == 1, F.col(flagged)
    row = scores.agg(count_if(y & hit).alias("tp"), count_if(~y & hit).alias("fp"), count_if(y & ~hit).alias("fn"), F.count("*").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, tp + fn)
    out = attach(row, curve)
    zero = F.lit(0.0)
    return out.select(
        "auroc",
        F.coalesce(precision, zero).alias("precision"),
        F.coalesce(recall, zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1_score"),
        (tp + fp).alias("n_anomalies"),
        ((tp + fp) / F.col("n")).alias("anomaly_rate"),
    )


def permutation_shift(df: DataFrame, features: Sequence[str], id_cols: Sequence[str], score: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """``(feature, importance)``: |mean score − mean score with that column shuffled|.

    All rows are placed once in a repeatable random order. A column's shuffle moves it by an
    offset of its own along that order, in a circle, which pairs every row with another one. So
    each row sends its values to one place per feature, and one join by place brings them all.
    """
    features = list(features)
    data = hash_rank(df.select(*id_cols, *features), [], id_cols, seed, "_at")
    n = data.count()
    steps = [shuffle_offset(seed, i, n) for i in range(len(features))]
    sent = [F.struct(F.pmod(F.col("_at") - 1 - step, F.lit(n)).alias("_to"), F.lit(i).alias("_i"), F.col(f).cast("double").alias("_v")) for i, (f, step) in enumerate(zip(features, steps))]
    moved = data.select(F.inline(F.array(*sent))).groupBy("_to").agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_m{i}") for i in range(len(features))])
    rows = data.withColumn("_to", F.col("_at") - 1).join(moved, "_to")
    # one row per row and shuffled feature, and one as it is, scored in one pass
    forms = [F.struct(F.lit(i).alias("_form"), *[(F.col(f"_m{i}") if i == j else F.col(f).cast("double")).alias(f) for j, f in enumerate(features)]) for i in range(-1, len(features))]
    means = score(rows.select(*id_cols, F.inline(F.array(*forms)))).groupBy("_form").agg(F.avg("score").alias("_mean"))
    base = means.agg(F.max(F.when(F.col("_form") == -1, F.col("_mean"))).alias("_base"))
    names = F.array(*[F.lit(f) for f in features])
    shift = F.abs(F.col("_mean") - F.col("_base")).alias("importance")
    return attach(means.filter("_form >= 0"), base).select(F.element_at(names, F.col("_form") + 1).alias("feature"), shift)


def shuffle_offset(seed: int, place: int, n: int) -> int:
    """How far a column is moved along the order of ``n`` rows: never by a full circle, if there are two rows."""
    return 1 + int(hashlib.md5(f"{seed}|{place}".encode()).hexdigest()[:8], 16) % max(n - 1, 1)


# -- search ----------------------------------------------------------------------------------


def grid_trials(space: dict[str, Sequence]) -> list[dict]:
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*space.values())]


def random_trials(space: dict[str, dict], n: int, seed: int = 42) -> list[dict]:
    """Seeded draws: ``float``/``int`` between ``low`` and ``high`` (optionally log), or ``categorical``.

    A draw is the md5 of seed, name and trial, so that it is the same anywhere.
    """

    def draw(name, p, i):
        u = int(hashlib.md5(f"{seed}|{name}|{i}".encode()).hexdigest()[:8], 16) / 2**32
        if p["type"] == "categorical":
            choices = list(p["choices"])
            return choices[int(u * len(choices))]
        low, high, whole = p["low"], p["high"], p["type"] == "int"
        if p["type"] not in ("float", "int"):
            raise ValueError(f"unknown parameter type: {p['type']}")
        top = high + 1 if whole else high
        value = math.exp(math.log(low) + u * (math.log(top) - math.log(low))) if p.get("log") else low + u * (top - low)
        return min(int(value), high) if whole else value

    return [{name: draw(name, p, i) for name, p in space.items()} for i in range(n)]


def run_trials(
    spark: SparkSession, trials: Sequence[dict], objective: Callable[[dict], float], maximize: bool = True, patience: int | None = None, min_gain: float = 0.001
) -> DataFrame:
    """Run the objective (a Spark fit) per trial; a failed one is kept with a null score."""
    rows, best, idle = [], None, 0
    for i, params in enumerate(trials):
        try:
            value = float(objective(params))
        except Exception as error:
            rows.append((i, {k: str(v) for k, v in params.items()}, None, str(error)))
            continue
        rows.append((i, {k: str(v) for k, v in params.items()}, value, None))
        gain = None if best is None else (value - best if maximize else best - value)
        if best is None or gain > min_gain:
            best, idle = value, 0
        else:
            idle += 1
        if patience is not None and idle >= patience:
            break
    return spark.createDataFrame(rows, "trial INT, params MAP<STRING, STRING>, score DOUBLE, error STRING")


def t_quantile(p: float, dof: int) -> float:
    """Student-t quantile by bisection on the integrated density."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)

    def upper_mass(x, steps=2000):
        h = x / steps
        f = [c * (1 + (i * h) ** 2 / dof) ** (-(dof + 1) / 2) for i in range(steps + 1)]
        return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))

    low, high = 0.0, 700.0
    for _ in range(80):
        mid = (low + high) / 2
        if upper_mass(mid) < p - 0.5:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def trial_statistics(trials: DataFrame, maximize: bool = True, level: float = 0.95) -> DataFrame:
    """Mean, spread, range, median and the t interval of the scores, with the best trial."""
    done = trials.filter("score IS NOT NULL")
    pick = F.max_by if maximize else F.min_by
    row = done.agg(
        F.count("*").alias("n_trials"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"),
        F.max("score").alias("max"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("_sem"),
        pick("trial", F.struct("score", -F.col("trial") if maximize else F.col("trial"))).alias("best_trial"),
    )
    middle = exact_quantiles(done, [], "score", [0.5]).select(F.element_at("q", 1).alias("median"))
    row = attach(row, middle)
    n = done.count()
    t = t_quantile(0.5 + level / 2, n - 1) if n > 1 else None
    half = F.col("_sem") * F.lit(t)
    return row.withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half}).drop("_sem")


def search_advice(stats: DataFrame, strategy: str, converged: bool = False) -> DataFrame:
    """Advice rows that follow from a finished search."""
    rules = [
        (F.lit(converged), "expand the search space"),
        (F.lit(not converged) & (F.col("n_trials") < 50), "run more trials"),
        (F.lit(strategy == "random"), "use a guided search"),
        (F.lit(strategy == "grid"), "all combinations explored"),
    ]
    hits = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in rules]))
    return stats.select(F.explode(hits).alias("advice"))


# -- model index -------------------------------------------------------------------------------


def active_models(index: DataFrame) -> DataFrame:
    """The newest model of each type that is not retired."""
    return latest_per_key(index.filter("status <> 'retired'"), ["model_type"], ["registered_at", "model_id"])


def list_models(index: DataFrame, model_type: str | None = None, status: str | None = None) -> DataFrame:
    out = index
    if model_type is not None:
        out = out.filter(F.col("model_type") == model_type)
    if status is not None:
        out = out.filter(F.col("status") == status)
    return out.orderBy(F.desc("registered_at"), F.desc("model_id"))


def retire_models(index: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("model_id").distinct().withColumn("_gone", F.lit(True))
    j = index.join(gone, "model_id", "left")
    return j.select(*[F.when(F.col("_gone"), "retired").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in index.columns])
