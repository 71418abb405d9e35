"""Explanations of linear scores: contributions, counterfactuals, surrogate rules, texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row, functions as F

from tidemark.functions.common import LEVEL_RANGES, risk_level
from tidemark.operators.ordered import attach, top_k_per_key



@dataclass(frozen=True)
class LinearModel:
    """Weights on scaled features; ``means``/``stds`` give the scaling (absent: none)."""

    weights: dict[str, float]
    intercept: float = 0.0
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)

    def scaled(self, c: str) -> Column:
        return (F.col(c) - self.means.get(c, 0.0)) / self.stds.get(c, 1.0)

    def logit(self) -> Column:
        return sum((self.scaled(c) * w for c, w in self.weights.items()), F.lit(float(self.intercept)))

    def score(self) -> Column:
        return 100.0 / (1.0 + F.exp(-self.logit()))


def contributions(df: DataFrame, model: LinearModel, keys: Sequence[str], background: DataFrame | None = None) -> DataFrame:
    """``(keys, feature, value, phi)`` with phi = w·(x − mean of x over the background)."""
    means = (background if background is not None else df).agg(*[F.avg(model.scaled(c)).alias(f"_m_{c}") for c in model.weights])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (F.lit(w) * (model.scaled(c) - F.col(f"_m_{c}"))).alias("phi"))
            for c, w in model.weights.items()
        ]
    )
    return attach(df, means).select(*keys, F.inline(cells))


def global_importance(phis: DataFrame, k: int = 10) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    out = phis.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
    return out.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def top_contributions(phis: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    return top_k_per_key(phis, keys, [F.desc(F.abs("phi")), F.asc("feature")], k)


def counterfactuals(
    df: DataFrame, model: LinearModel, keys: Sequence[str], target: str = "low", max_changes: int = 5,
    ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Greedy single pass over features by |w·x|, one step each, until the target band is met.

    A row already in the target band gets no change.

    A step is the larger of 10 % of the scaled value and 0.5, against the sign of the
    feature's pull when risk must fall and with it when it must rise. The at most
    ``max_changes`` steps are unrolled into projections. Only a feature's place, its scaled
    and its given value are sorted; weights, scaling and names are looked up by the place, and
    each step's values are columns, so that the generated methods stay small enough for the JVM
    to compile.
    """
    low, high = LEVEL_RANGES[target]
    ranges = ranges or {}
    features = list(model.weights)
    items = []
    for i, (c, w) in enumerate(model.weights.items()):
        x = model.scaled(c).cast("double")
        items.append(F.struct((-F.abs(x * w)).alias("o"), F.lit(i).alias("i"), x.alias("x"), F.col(c).cast("double").alias("original")))
    steps = min(max_changes, len(items))

    def score_of(logit: Column) -> Column:
        return 100.0 / (1.0 + F.exp(-logit))

    def of(n: int, values: Sequence, kind: str) -> Column:
        return F.try_element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(f"_f{n}")["i"] + 1)

    # places are unique, so no two items are equal
    data = df.select(*keys, F.sort_array(F.array(*items)).alias("_items"), model.logit().alias("_logit0"))
    data = data.select(*keys, "_logit0", score_of(F.col("_logit0")).alias("_score"), *[F.try_element_at("_items", F.lit(n + 1)).alias(f"_f{n}") for n in range(steps)])
    data = data.withColumns(
        {
            "_falling": F.col("_score") > high,
            "_done0": risk_level(F.col("_score")) == target,
            **{f"_w{n}": of(n, model.weights.values(), "double") for n in range(steps)},
        }
    )
    data = data.withColumn("_way", F.when(F.col("_falling"), F.lit(-1.0)).otherwise(F.lit(1.0)))
    data = data.withColumns({f"_pull{n}": F.col(f"_w{n}") * F.col(f"_f{n}")["x"] for n in range(steps)})
    moves = {}
    for n in range(steps):
        x = F.col(f"_f{n}")["x"]
        moved = x + F.when(F.col(f"_pull{n}") > 0, F.col("_way")).otherwise(-F.col("_way")) * F.greatest(F.abs(x * 0.1), F.lit(0.5))
        if ranges:
            lo, hi = (of(n, [ranges.get(c, (None, None))[end] for c in features], "double") for end in (0, 1))
            # greatest and least skip a missing bound
            moved = F.least(F.greatest(moved, lo), hi)
        moves[f"_moved{n}"] = moved
    data = data.withColumns(moves)
    for n in range(steps):
        logit, done = F.col(f"_logit{n}"), F.col(f"_done{n}")
        step = F.col(f"_w{n}") * (F.col(f"_moved{n}") - F.col(f"_f{n}")["x"])
        data = data.withColumn(f"_logit{n + 1}", F.when(done, logit).otherwise(logit + step))
        data = data.withColumn(f"_after{n}", score_of(F.col(f"_logit{n + 1}")))
        after = F.col(f"_after{n}")
        data = data.withColumn(f"_done{n + 1}", done | F.when(F.col("_falling"), after <= high).otherwise(after >= low))
    changes = []
    for n in range(steps):
        f = F.col(f"_f{n}")
        std, mean = of(n, [float(model.stds.get(c, 1.0)) for c in features], "double"), of(n, [float(model.means.get(c, 0.0)) for c in features], "double")
        change = F.struct(
            of(n, features, "string").alias("feature"), of(n, [model.names.get(c, c) for c in features], "string").alias("clinical_name"),
            f["original"].alias("original_value"), (F.col(f"_moved{n}") * std + mean).alias("proposed_value"), F.col(f"_pull{n}").alias("importance"),
        )
        changes.append(F.when(~F.col(f"_done{n}"), change))
    final = F.col(f"_after{steps - 1}" if steps else "_score")
    return data.withColumn("_final", final).select(
        *keys,
        F.col("_score").alias("current_score"),
        risk_level(F.col("_score")).alias("current_risk_level"),
        F.lit(target).alias("target_risk_level"),
        F.array_compact(F.array(*changes)).alias("changes"),
        F.col("_final").alias("counterfactual_score"),
        risk_level(F.col("_final")).alias("counterfactual_risk_level"),
        (risk_level(F.col("_final")) == target).alias("achieved_target"),
    )


def fixed(x: Column, digits: int) -> Column:
    """``x`` as ``format_string("%.<digits>f", x)`` writes it.

    A decimal rounds the same digits the same way at a fraction of the formatter's price;
    the formatter writes what a decimal would not: null, NaN, infinities, the sign of a zero.
    """
    size = F.abs(x)
    return F.when((size >= 10.0**-digits) & (size < 1e12), x.cast(f"decimal(18,{digits})").cast("string")).otherwise(F.format_string(f"%.{digits}f", x))


def shown(c: Column) -> Column:
    """A text, or ``null`` as ``format_string`` writes it."""
    return F.coalesce(c, F.lit("null"))


def words(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# fixed values: the sentences
def describe_counterfactual(cf: DataFrame) -> DataFrame:
    """Add ``description``: a header, one line per change and a closing line."""
    reached, level = F.col("achieved_target"), shown(F.col("target_risk_level"))
    head = words(
        F.when(reached, "To reach").otherwise("To move toward"), " ", level, " risk level (from ", fixed(F.col("current_score"), 1), " to ",
        fixed(F.col("counterfactual_score"), 1), "), the following changes would ", F.when(reached, "be needed").otherwise("help"), ":",
    )

    def line(c: Column, i: Column) -> Column:
        way = F.when(c["proposed_value"] > c["original_value"], "Increase").otherwise("Decrease")
        return words(i + 1, ". ", way, " ", shown(c["clinical_name"]), " from ", fixed(c["original_value"], 2), " to ", fixed(c["proposed_value"], 2))

    tail = F.when(reached, words("\nThese ", F.size("changes"), " change(s) would successfully move the individual to ", level, " risk level.")).otherwise(
        words(
            "\nThese ", F.size("changes"), " change(s) would move the risk score to ", fixed(F.col("counterfactual_score"), 1), " (",
            shown(F.col("counterfactual_risk_level")), " risk level), closer to the target of ", level, ".",
        )
    )
    none = words("Already at ", level, " risk level. No changes needed.")
    text = F.concat_ws("\n", head, F.array_join(F.transform("changes", line), "\n"), tail)
    return cf.withColumn("description", F.when(F.size("changes") == 0, none).otherwise(text))


def surrogate_rules(df: DataFrame, features: Sequence[str], score: str, max_depth: int = 3, min_leaf: int = 50, names: dict[str, str] | None = None) -> DataFrame:
    """Rules of a shallow tree that imitates ``score > 50``, with confidence, size and fidelity."""
    names = names or {}
    features = list(features)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in features], (F.col(score) > 50).cast("double").alias("label"))
    )
    tree = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=42).fit(data)
    leaves: list[tuple[list[tuple[int, bool, float]], float]] = []

    def walk(node, path):
        if node.getClass().getSimpleName() == "LeafNode":
            leaves.append((path, float(node.prediction())))
            return
        f, cut = node.split().featureIndex(), float(node.split().threshold())
        walk(node.leftChild(), [*path, (f, True, cut)])
        walk(node.rightChild(), [*path, (f, False, cut)])

    walk(tree._call_java("rootNode"), [])
    leaf_of = F.lit(None).cast("int")
    for i, (path, _) in enumerate(leaves):
        inside = F.lit(True)
        for f, left, cut in path:
            inside = inside & ((F.col(features[f]) <= cut) if left else (F.col(features[f]) > cut))
        leaf_of = F.when(inside, F.lit(i)).otherwise(leaf_of)
    placed = data.withColumn("_leaf", leaf_of).groupBy("_leaf").agg(F.count("*").alias("n_samples"), F.sum("label").alias("_high"))
    texts = [" AND ".join(f"{names.get(features[f], features[f])} {'<=' if left else '>'} {cut:.2f}" for f, left, cut in p) or "Default" for p, _ in leaves]
    rules = df.sparkSession.createDataFrame(
        [Row(_leaf=i, rule_text=texts[i], prediction="high_risk" if pred == 1.0 else "low_risk") for i, (_, pred) in enumerate(leaves)],
        "_leaf INT, rule_text STRING, prediction STRING",
    )
    right = F.when(F.col("prediction") == "high_risk", F.col("_high")).otherwise(F.col("n_samples") - F.col("_high"))
    per = placed.join(F.broadcast(rules), "_leaf").withColumn("_right", right)
    overall = per.agg((F.sum("_right") / F.sum("n_samples")).alias("fidelity"))
    return attach(per, overall).select("rule_text", "prediction", (F.col("_right") / F.col("n_samples")).alias("confidence"), "n_samples", "fidelity")


# fixed values: the sentences
def simple_counterfactual(level: Column, top_feature: Column) -> Column:
    """A sentence from the level (in any case) and the strongest feature."""
    raised = F.lower(level).isin("high", "critical")
    text = F.when(
        top_feature.isNotNull(),
        F.concat(F.lit("Improving "), top_feature, F.lit(" could reduce risk level. Consider interventions targeting this factor.")),
    ).otherwise("Multiple factors contribute to elevated risk.")
    return F.when(raised, text).otherwise("Current risk level is within acceptable range.")


# fixed values: the sentences
def simple_rule(level: Column, top_feature: Column) -> Column:
    return F.when(
        top_feature.isNotNull(), F.concat(F.lit("IF "), top_feature, F.lit(" is elevated THEN risk is "), F.lower(level))
    ).otherwise(F.concat(F.lit("Risk classified as "), F.lower(level)))


def sorted_contributions(model: LinearModel) -> Column:
    """All contributions of a row as ``(o, feature, phi)``, the largest first, sorted inside the row; means are ``_m_<feature>``."""
    phis = []
    for c, w in model.weights.items():
        phi = F.lit(w) * (model.scaled(c) - F.col(f"_m_{c}"))
        phis.append(F.struct(F.coalesce(-F.abs(phi), F.lit(float("inf"))).alias("o"), F.lit(c).alias("feature"), phi.alias("phi")))
    return F.sort_array(F.array(*phis))


def explanation_bundle(df: DataFrame, model: LinearModel, keys: Sequence[str], target: str = "low", top_k: int = 10, max_changes: int = 5) -> DataFrame:
    """One row per row: top contributions, counterfactual and the summary text, all from the row and the features' means."""
    means = df.agg(*[F.avg(model.scaled(c)).alias(f"_m_{c}") for c in model.weights])
    rows = attach(df, means).withColumn("_sorted", sorted_contributions(model))
    ranked = [F.get("_sorted", F.lit(i)) for i in range(min(top_k, len(model.weights)))]
    tops = F.array(*[F.struct(F.lit(i + 1).alias("rank"), x["feature"].alias("feature"), x["phi"].alias("phi")) for i, x in enumerate(ranked)])
    j = describe_counterfactual(counterfactuals(rows.withColumn("top_features", tops), model, [*keys, "top_features"], target, max_changes))
    tops = [F.get("top_features", F.lit(i)) for i in range(min(5, len(ranked)))]
    factors = F.concat_ws("\n", *[words("  ", x["rank"], ". ", x["feature"], " (importance: ", fixed(F.abs(x["phi"]), 3), ")") for x in tops])
    first = F.try_element_at("top_features", F.lit(1))["feature"]
    # fixed values: the headings of the summary
    summary = F.concat_ws("\n", F.lit("Key Contributing Factors:"), factors, F.lit("Actionable Changes:"), F.col("description"))
    return j.withColumns(
        {
            "summary": summary,
            "simple_counterfactual": simple_counterfactual(F.col("current_risk_level"), first),
            "simple_rule": simple_rule(F.col("current_risk_level"), first),
        }
    )
