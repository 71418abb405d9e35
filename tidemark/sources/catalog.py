"""The default resource catalog as a table with real arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = (
    "position INT, resource_id STRING, resource_type STRING, name STRING, description STRING, contact_info STRING, "
    "urgency STRING, eligibility_criteria ARRAY<STRING>, risk_levels ARRAY<STRING>, tags ARRAY<STRING>, priority INT, active BOOLEAN"
)

# Id, type, name, description, contact, urgency, eligibility, risk levels, tags, priority.
DEFAULT_RESOURCES = [
    ("crisis_line_988", "crisis_line", "National Suicide Prevention Lifeline",
     "24/7 crisis support and suicide prevention", "988", "immediate",
     ["Available to all"], ["critical"], ["suicide", "crisis", "24/7"], 100),
    ("emergency_911", "emergency", "Emergency Services",
     "Immediate emergency response", "911", "immediate",
     ["Emergency situations"], ["critical"], ["emergency", "immediate"], 100),
    ("crisis_text_line", "crisis_line", "Crisis Text Line",
     "Text-based crisis support available 24/7", "Text HOME to 741741", "immediate",
     ["Available to all"], ["critical", "high"], ["crisis", "text", "24/7"], 95),
    ("crisis_intervention_therapy", "therapy", "Crisis Intervention Therapy",
     "Immediate therapeutic intervention for acute crisis", "Contact your healthcare provider or local crisis center", "immediate",
     ["High risk individuals", "Acute crisis"], ["critical", "high"], ["therapy", "crisis", "intervention"], 90),
    ("intensive_outpatient", "therapy", "Intensive Outpatient Program (IOP)",
     "Structured daily therapy program for high-risk individuals", "Contact your healthcare provider", "soon",
     ["High risk", "Recent hospitalization"], ["high"], ["therapy", "intensive", "structured"], 85),
    ("cbt_therapy", "therapy", "Cognitive Behavioral Therapy (CBT)",
     "Evidence-based therapy for depression and anxiety", "Contact your healthcare provider", "soon",
     ["Diagnosed mental health condition"], ["moderate", "high"], ["therapy", "cbt", "evidence-based", "depression", "anxiety"], 80),
    ("dbt_therapy", "therapy", "Dialectical Behavior Therapy (DBT)",
     "Therapy focused on emotional regulation and distress tolerance", "Contact your healthcare provider", "soon",
     ["Emotional dysregulation", "Self-harm history"], ["moderate", "high"], ["therapy", "dbt", "emotional-regulation"], 80),
    ("peer_support_group", "support_group", "Peer Support Groups",
     "Group support from others with similar experiences", "Local mental health center", "routine",
     ["Open to all"], ["moderate", "high", "low"], ["support", "peer", "group"], 70),
    ("depression_support_group", "support_group", "Depression Support Group",
     "Support group specifically for individuals with depression", "Local mental health center", "routine",
     ["Depression diagnosis or symptoms"], ["moderate", "high"], ["support", "depression", "group"], 70),
    ("psychiatric_medication", "medication", "Psychiatric Medication Management",
     "Medication evaluation and management by psychiatrist", "Contact your healthcare provider or psychiatrist", "soon",
     ["Moderate to severe symptoms"], ["moderate", "high"], ["medication", "psychiatrist"], 75),
    ("wellness_program", "wellness", "Mental Health Wellness Programs",
     "Preventive mental health and wellness activities", "Community health center", "routine",
     ["Open to all"], ["low"], ["wellness", "prevention", "self-care"], 60),
    ("mindfulness_program", "wellness", "Mindfulness and Meditation Programs",
     "Stress reduction through mindfulness practices", "Community health center or online platforms", "routine",
     ["Open to all"], ["low", "moderate"], ["wellness", "mindfulness", "meditation", "stress"], 60),
    ("self_help_apps", "self_help", "Mental Health Apps",
     "Mobile apps for mood tracking, meditation, and coping skills", "App stores (e.g., Headspace, Calm, Moodpath)", "routine",
     ["Open to all"], ["low", "moderate"], ["self-help", "app", "technology"], 50),
    ("online_therapy", "therapy", "Online Therapy Platforms",
     "Virtual therapy sessions with licensed therapists", "BetterHelp, Talkspace, or similar platforms", "routine",
     ["Internet access", "Mild to moderate symptoms"], ["low", "moderate"], ["therapy", "online", "virtual"], 65),
    ("community_mental_health", "community", "Community Mental Health Center",
     "Local mental health services and resources", "Find your local community mental health center", "routine",
     ["Open to all"], ["low", "moderate", "high"], ["community", "local"], 65),
]


def default_catalog(spark: SparkSession) -> DataFrame:
    """The default resources as literals of the plan, so their size is known to it."""

    def cell(value):
        return F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rows = [F.struct(*[cell(v).alias(n) for n, v in zip(names, (i, *r, True))]) for i, r in enumerate(DEFAULT_RESOURCES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def load_catalog(spark: SparkSession, path: str) -> None:
    default_catalog(spark).write.mode("overwrite").parquet(path)


def search(
    catalog: DataFrame, risk_level: str | None = None, resource_type: str | None = None,
    tags: list[str] | None = None, eligibility: list[str] | None = None,
) -> DataFrame:
    """Active resources by level, type, any tag and any eligibility entry; priority then name."""
    out = catalog.filter("active")
    if risk_level:
        out = out.filter(F.array_contains("risk_levels", risk_level))
    if resource_type:
        out = out.filter(F.col("resource_type") == resource_type)
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    if eligibility:
        out = out.filter(F.arrays_overlap("eligibility_criteria", F.array(*[F.lit(x) for x in eligibility])))
    return catalog_order(out)


def catalog_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("priority"), F.asc("name"))
