"""Scoring resources for individuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import top_k_per_key

# Points per rule.
POINTS = {
    "level": 20, "age": 15, "therapy_known": 10, "therapy_new": 5, "medication": 10, "no_support": 15, "online": 20,
    "group": 15, "individual": 10, "condition_tag": 25, "condition_text": 10, "factor_tag": 15, "factor_text": 5,
}


def _points(test: Column, key: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(POINTS[key])).otherwise(F.lit(0))


def _sum_over(array: Column, points) -> Column:
    items = F.coalesce(array, F.array().cast("array<string>"))
    return F.aggregate(items, F.lit(0), lambda acc, x: acc + points(F.lower(x)))


def relevance_score(resource=F.col) -> Column:
    """Score of one profile and one resource; see ``POINTS``.

    Profile columns are read by name, resource fields through ``resource`` (a column of a
    joined row, or a field of an array element).
    """
    kind, tags, text = resource("resource_type"), resource("tags"), F.lower(resource("description"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    age = F.col("age_group").isin("youth", "senior") & F.array_contains(tags, F.col("age_group"))
    tagged = lambda x: F.exists(tags, lambda g: F.contains(g, x))
    parts = [
        resource("priority"),
        _points(F.array_contains(resource("risk_levels"), F.col("risk_level")), "level"),
        _points(age, "age"),
        _points(yes("has_therapy_history") & (kind == "therapy"), "therapy_known"),
        _points(~yes("has_therapy_history") & kind.isin("support_group", "self_help"), "therapy_new"),
        _points(yes("has_medication_history") & (kind == "medication"), "medication"),
        _points(~yes("has_support_system") & kind.isin("support_group", "community"), "no_support"),
        _points(yes("prefers_online") & F.arrays_overlap(tags, F.array(F.lit("online"), F.lit("virtual"), F.lit("app"))), "online"),
        _points(yes("prefers_group") & (kind == "support_group"), "group"),
        _points((F.col("prefers_group") == F.lit(False)) & (kind == "therapy"), "individual"),
        _sum_over(
            F.col("specific_conditions"),
            lambda x: _points(F.array_contains(tags, x), "condition_tag") + _points(F.contains(text, x), "condition_text"),
        ),
        _sum_over(
            F.col("contributing_factors"),
            lambda x: _points(tagged(x), "factor_tag") + _points(F.contains(text, x), "factor_text"),
        ),
    ]
    return sum(parts[1:], parts[0]).cast("double")


def score_resources(profiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every profile with every active resource of its risk level, scored.

    The output is all pairs of a level by its meaning; ``with_recommendations`` ranks inside
    the row instead and keeps the best few only.
    """
    levels = catalog.filter("active").withColumn("risk_level", F.explode("risk_levels"))
    return profiles.join(levels, "risk_level").withColumn("relevance_score", relevance_score())


# What a profile may leave out.
PROFILE_DEFAULTS = {
    "age_group": "CAST(NULL AS STRING)", "has_therapy_history": "false", "has_medication_history": "false", "has_support_system": "false",
    "prefers_online": "false", "prefers_group": "CAST(NULL AS BOOLEAN)", "specific_conditions": "CAST(array() AS array<string>)",
    "contributing_factors": "CAST(array() AS array<string>)",
}


def with_profile_defaults(profiles: DataFrame) -> DataFrame:
    missing = {c: F.expr(e) for c, e in PROFILE_DEFAULTS.items() if c not in profiles.columns}
    return profiles.withColumns(missing) if missing else profiles


def with_recommendations(profiles: DataFrame, catalog: DataFrame, k: int = 5, name: str = "recommendations") -> DataFrame:
    """Add the best ``k`` resources of each row as an array, best first; null for an unknown level.

    The resources of each level travel as one array, a row per level, and are ranked inside
    the profile's row: profiles are joined to a table of a few rows and nothing else. A level's
    resources must fit a row, as a catalog that people read does.
    """
    full = with_profile_defaults(profiles)
    entry = ("position", "resource_id", "resource_type", "description", "urgency", "risk_levels", "tags", "priority")
    levels = catalog.filter("active").withColumn("risk_level", F.explode("risk_levels"))
    packed = levels.groupBy("risk_level").agg(F.collect_list(F.struct(*entry)).alias("_resources"))
    joined = full.join(packed, "risk_level", "left")

    def scored(x: Column) -> Column:
        points = relevance_score(lambda c: x[c])
        return F.struct((-points).alias("o"), x["position"].alias("position"), x["resource_id"].alias("resource_id"), points.alias("relevance_score"), x["resource_type"].alias("resource_type"), x["urgency"].alias("urgency"))

    best = F.slice(F.array_sort(F.transform("_resources", scored)), 1, k)
    shaped = F.transform(
        best,
        lambda x, i: F.struct((i + 1).alias("rank"), x["resource_id"].alias("resource_id"), x["relevance_score"].alias("relevance_score"), x["resource_type"].alias("resource_type"), x["urgency"].alias("urgency")),
    )
    return joined.select(*profiles.columns, shaped.alias(name))


def recommend(profiles: DataFrame, catalog: DataFrame, k: int = 5, immediate_only: bool = False) -> DataFrame:
    """Best ``k`` resources per individual, one row each; equal scores keep the catalog's order."""
    if immediate_only:
        catalog = catalog.filter("urgency = 'immediate'")
    listed = with_recommendations(profiles, catalog, k, "_list")
    return listed.select("anonymized_id", F.inline("_list")).select("anonymized_id", "resource_id", "relevance_score", "rank", "resource_type", "urgency")


def recent_recommendations(recs: DataFrame, catalog: DataFrame, per_person: int = 10) -> DataFrame:
    """A person's newest recommendations with the resource's attributes."""
    newest = top_k_per_key(recs, ["anonymized_id"], [F.desc("recommended_at"), F.desc("recommendation_id")], per_person)
    side = catalog.select("resource_id", "name", "resource_type", "urgency")
    return newest.join(side, "resource_id")


def access_statistics(recs: DataFrame) -> DataFrame:
    """Totals, accessed ones and mean relevance per resource."""
    return recs.groupBy("resource_id").agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("accessed"), 1)).alias("accessed"),
        F.avg("relevance_score").alias("avg_relevance"),
    )
