"""Batch screening as one job: validate, check consent, score, explain, recommend, route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import review_flag
from tidemark.operators import consent, explain, recommend, score, validate

UNKNOWN = "unknown"


def screen_batch(
    requests: DataFrame,
    consents: DataFrame,
    features: DataFrame,
    models: Sequence[explain.LinearModel],
    weights: Sequence[float] | None,
    catalog: DataFrame,
    now: Column,
    top_features: int = 10,
    k: int = 5,
) -> DataFrame:
    """One row per request (``request_id, anonymized_id, source_type, record, data_types``).

    A request that fails validation, has no valid consent or has no features is not an
    error of the job: it comes out with level "unknown", its errors listed, and needs review.
    """
    checked = validate.check_by_source(requests, "record", "source_type")
    gated = consent.consent_status(checked, consents, now)
    known = gated.join(features.withColumn("_has", F.lit(True)), "anonymized_id", "left")
    errors = F.concat(
        F.col("errors"),
        F.array_compact(
            F.array(
                F.when(~F.col("consent_valid"), F.concat(F.lit("consent "), F.col("consent_status"))),
                F.when(F.col("_has").isNull(), F.lit("no features")),
            )
        ),
    )
    judged = known.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)
    names = []
    for i, m in enumerate(models):
        names.append(f"_p{i}")
        judged = judged.withColumn(f"_p{i}", F.when(F.col("passed"), m.score() / 100))
    scored = score.ensemble_scores(judged, names, weights)
    lead = models[0]
    # the strongest |w·x| features of the leading model, inside the row
    pulls = F.array(*[F.struct((-F.abs(lead.scaled(c) * w)).alias("o"), F.lit(c).alias("feature")) for c, w in lead.weights.items()])
    tops = F.when(F.col("passed"), F.transform(F.slice(F.array_sort(pulls), 1, top_features), lambda x: x["feature"]))
    scored = scored.withColumns(
        {
            "risk_level": F.when(F.col("passed"), F.col("risk_level")).otherwise(F.lit(UNKNOWN)),
            "top_features": tops,
            "requires_human_review": ~F.col("passed") | review_flag(F.col("risk_score")),
        }
    )
    first = F.try_element_at("top_features", F.lit(1))
    scored = scored.withColumns(
        {
            "counterfactual": F.when(F.col("passed"), explain.simple_counterfactual(F.col("risk_level"), first)),
            "rule": F.when(F.col("passed"), explain.simple_rule(F.col("risk_level"), first)),
        }
    )
    # ranked inside the row when the catalog is small, so requests are not shuffled again
    people = scored.withColumnRenamed("anonymized_id", "_person").withColumns(
        {"anonymized_id": F.col("request_id"), "contributing_factors": F.col("top_features")}
    )
    listed = recommend.with_recommendations(people, catalog, k)
    return listed.drop("anonymized_id").withColumnRenamed("_person", "anonymized_id").select(
        "request_id", "anonymized_id", "passed", "errors", "warnings", "risk_score", "confidence", "risk_level", F.coalesce("alert", F.lit(False)).alias("alert"),
        "requires_human_review", "top_features", "counterfactual", "rule", "recommendations",
    )
