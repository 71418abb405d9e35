"""Contract checks on nested ingest records, as Column expressions over parsed JSON.

A contract is a plain dictionary of rules. ``check_records`` parses the raw JSON once to a
variant, reads each ruled field with its strict type, and returns error and warning lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import any_of


ID_PATTERN = "^[a-zA-Z0-9_-]+$"
CODE_PATTERN = "^[A-Z0-9.]+$"


@dataclass(frozen=True)
class Rule:
    """One field's rule. ``items`` holds the rules of an array of objects."""

    kind: str
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None
    enum: tuple[str, ...] = ()
    pattern: str | None = None
    max_length: int | None = None
    fields: dict[str, "Rule"] = field(default_factory=dict)
    closed: bool = False
    item_enum: tuple[str, ...] = ()
    items: dict[str, "Rule"] = field(default_factory=dict)


def text(**kw) -> Rule:
    return Rule("string", **kw)


def whole(low=None, high=None, **kw) -> Rule:
    return Rule("integer", minimum=low, maximum=high, **kw)


def number(low=None, high=None, **kw) -> Rule:
    return Rule("number", minimum=low, maximum=high, **kw)


def flag(**kw) -> Rule:
    return Rule("boolean", **kw)


def obj(fields, closed=False, **kw) -> Rule:
    return Rule("object", fields=fields, closed=closed, **kw)


def objects(items, **kw) -> Rule:
    return Rule("array", items=items, **kw)


# The three ingest contracts (fields, ranges, allowed words).
SURVEY = obj(
    {
        "survey_id": text(required=True, pattern=ID_PATTERN),
        "timestamp": text(required=True),
        "responses": obj(
            {
                "mood_score": whole(1, 10),
                "anxiety_level": whole(0, 21),
                "depression_level": whole(0, 27),
                "stress_level": whole(1, 10),
                "sleep_quality": whole(1, 5),
                "social_support": whole(1, 5),
                "suicidal_ideation": flag(),
                "self_harm": flag(),
                "substance_use": text(enum=("none", "occasional", "frequent", "daily")),
                "medication_adherence": text(enum=("none", "poor", "moderate", "good", "excellent")),
                "therapy_engagement": whole(0, 100),
                "life_events": Rule(
                    "array",
                    item_enum=("loss", "trauma", "relationship_change", "job_change", "health_issue", "financial_stress", "other"),
                ),
                "free_text_response": text(max_length=5000),
            },
            closed=True,
            required=True,
        ),
        "completion_time_seconds": whole(0),
        "device_type": text(enum=("mobile", "tablet", "desktop", "other")),
    },
    closed=True,
)
_DAY = 1440
WEARABLE = obj(
    {
        "device_id": text(required=True, pattern=ID_PATTERN),
        "device_type": text(enum=("smartwatch", "fitness_tracker", "smart_ring", "other")),
        "start_timestamp": text(required=True),
        "end_timestamp": text(required=True),
        "metrics": obj(
            {
                "heart_rate": obj(
                    {
                        "average_bpm": number(30, 220),
                        "resting_bpm": number(30, 120),
                        "max_bpm": number(30, 220),
                        "min_bpm": number(30, 220),
                    }
                ),
                "hrv": obj({"rmssd": number(0, 200), "sdnn": number(0, 300), "lf_hf_ratio": number(0, 10)}),
                "sleep": obj(
                    {
                        "total_minutes": whole(0, _DAY),
                        "deep_sleep_minutes": whole(0, _DAY),
                        "rem_sleep_minutes": whole(0, _DAY),
                        "light_sleep_minutes": whole(0, _DAY),
                        "awake_minutes": whole(0, _DAY),
                        "interruptions": whole(0),
                        "efficiency_percent": number(0, 100),
                        "bedtime": text(),
                        "wake_time": text(),
                    }
                ),
                "activity": obj(
                    {
                        "steps": whole(0, 100000),
                        "distance_meters": number(0),
                        "calories_burned": whole(0),
                        "active_minutes": whole(0, _DAY),
                        "sedentary_minutes": whole(0, _DAY),
                        "intensity_zones": obj(
                            {"light_minutes": whole(0), "moderate_minutes": whole(0), "vigorous_minutes": whole(0)}
                        ),
                    }
                ),
                "stress_score": whole(0, 100),
                "spo2_percent": number(70, 100),
                "skin_temperature_celsius": number(30, 42),
            },
            closed=True,
            required=True,
        ),
        "data_quality": obj({"completeness_percent": number(0, 100), "wear_time_minutes": whole(0, _DAY)}),
    },
    closed=True,
)
RECORD = obj(
    {
        "record_id": text(required=True, pattern=ID_PATTERN),
        "timestamp": text(required=True),
        "record_type": text(required=True, enum=("diagnosis", "medication", "encounter", "lab_result", "assessment")),
        "diagnoses": objects(
            {
                "code": text(required=True, pattern=CODE_PATTERN),
                "description": text(required=True, max_length=500),
                "date_diagnosed": text(),
                "status": text(enum=("active", "resolved", "in_remission", "chronic")),
                "severity": text(enum=("mild", "moderate", "severe")),
            }
        ),
        "medications": objects(
            {
                "name": text(required=True, max_length=200),
                "dosage": text(max_length=100),
                "frequency": text(max_length=100),
                "start_date": text(),
                "end_date": text(),
                "status": text(required=True, enum=("active", "discontinued", "completed", "on_hold")),
                "prescriber": text(max_length=200),
            }
        ),
        "encounters": objects(
            {
                "date": text(required=True),
                "type": text(required=True, enum=("inpatient", "outpatient", "emergency", "telehealth", "therapy_session")),
                "provider_type": text(
                    enum=("psychiatrist", "psychologist", "therapist", "primary_care", "emergency", "other")
                ),
                "duration_minutes": whole(0, _DAY),
                "chief_complaint": text(max_length=500),
                "disposition": text(enum=("discharged", "admitted", "referred", "follow_up_scheduled", "other")),
            }
        ),
        "assessments": objects(
            {
                "date": text(required=True),
                "type": text(required=True, enum=("mental_status", "suicide_risk", "functional", "cognitive", "other")),
                "score": number(),
                "interpretation": text(enum=("normal", "mild", "moderate", "severe", "critical")),
                "notes": text(max_length=2000),
            }
        ),
        "lab_results": objects(
            {
                "test_name": text(required=True, max_length=200),
                "date": text(required=True),
                "value": number(),
                "unit": text(max_length=50),
                "reference_range": text(max_length=100),
                "abnormal_flag": flag(),
            }
        ),
        "hospitalizations": objects(
            {
                "admission_date": text(required=True),
                "discharge_date": text(),
                "reason": text(max_length=500),
                "facility_type": text(enum=("psychiatric", "general_medical", "emergency", "other")),
                "involuntary": flag(),
            }
        ),
        "risk_factors": obj(
            {
                "suicide_attempts": whole(0),
                "self_harm_history": flag(),
                "family_history_mental_illness": flag(),
                "substance_abuse_history": flag(),
                "trauma_history": flag(),
            }
        ),
    },
    closed=True,
)
CONTRACTS = {"survey": SURVEY, "wearable": WEARABLE, "emr": RECORD}
LOW_COMPLETENESS = 70
LOW_WEAR_MINUTES = 720


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is_kind(kind: str, of: str, as_number: str) -> str:
    """Strict JSON type test from a variant's schema text (an integer is also a number; 3.0 is an integer)."""
    if kind == "string":
        return f"{of} = 'STRING'"
    if kind == "boolean":
        return f"{of} = 'BOOLEAN'"
    if kind == "object":
        return f"startswith({of}, 'OBJECT')"
    if kind == "array":
        return f"startswith({of}, 'ARRAY')"
    numeric = f"({of} = 'BIGINT' OR {of} = 'DOUBLE' OR startswith({of}, 'DECIMAL'))"
    if kind == "number":
        return numeric
    return f"({of} = 'BIGINT' OR ({numeric} AND {as_number} = floor({as_number})))"


def _says(label: str, test: str, what: str) -> str:
    """``CASE`` that gives the message when the test holds; ``label`` is SQL for the shown path."""
    return f"CASE WHEN {test} THEN concat('Field \\'', {label}, '\\': ', {what}) END"


@dataclass(frozen=True)
class _Value:
    """SQL of what a field's rules read: the variant, its schema text, number and string forms."""

    variant: str
    kind: str
    number: str
    string: str


def _value_of(v: str) -> _Value:
    return _Value(v, f"schema_of_variant({v})", f"try_variant_get({v}, '$', 'double')", f"try_variant_get({v}, '$', 'string')")


def _field_errors(value: _Value, rule: Rule, label: str) -> list[str]:
    """SQL giving null or a message for each of one field's own rules."""
    right_kind = _is_kind(rule.kind, value.kind, value.number)
    there = f"{value.variant} IS NOT NULL"
    out = [_says(label, f"{there} AND NOT ({right_kind})", _q(f"is not of type '{rule.kind}'"))]

    def broken(test: str, what: str):
        out.append(_says(label, f"{there} AND {right_kind} AND {test}", what))

    if rule.kind in ("number", "integer"):
        if rule.minimum is not None:
            broken(f"{value.number} < {rule.minimum:g}", _q(f"is less than the minimum of {rule.minimum:g}"))
        if rule.maximum is not None:
            broken(f"{value.number} > {rule.maximum:g}", _q(f"is greater than the maximum of {rule.maximum:g}"))
    if rule.kind == "string":
        if rule.enum:
            broken(f"{value.string} NOT IN ({', '.join(map(_q, rule.enum))})", _q(f"is not one of {list(rule.enum)}"))
        if rule.pattern:
            broken(f"NOT rlike({value.string}, {_q(rule.pattern)})", _q(f"does not match '{rule.pattern}'"))
        if rule.max_length is not None:
            broken(f"length({value.string}) > {rule.max_length}", _q("is too long"))
    if rule.kind == "object" and rule.closed:
        keys = f"map_keys(try_variant_get({value.variant}, '$', 'map<string,variant>'))"
        extra = f"array_except({keys}, array({', '.join(map(_q, rule.fields))}))"
        broken(f"size({extra}) > 0", f"concat('additional properties not allowed: ', array_join(array_sort({extra}), ', '))")
    return out


def _walk(rule: Rule, path: str = "") -> list[tuple[str, str, Rule, Rule | None]]:
    """``(path, parent path, rule, parent rule)`` of a contract's objects and fields, parents first."""
    found: list[tuple[str, str, Rule, Rule | None]] = [("", "", rule, None)] if not path else []
    for name, sub in rule.fields.items():
        inner = f"{path}.{name}" if path else name
        found.append((inner, path, sub, rule))
        if sub.fields:
            found += _walk(sub, inner)
    return found


def _item_errors(items: str, rule: Rule, path: str) -> str:
    """SQL of the messages of all items of an ``array<variant>``, as ``array<string>``."""
    label = f"concat('{path}.', i)"
    if rule.item_enum:
        parts = _field_errors(_value_of("x"), Rule("string", enum=rule.item_enum), label)
    else:
        is_object = "startswith(schema_of_variant(x), 'OBJECT')"
        parts = [_says(label, f"NOT {is_object}", _q("is not of type 'object'"))]
        for name, sub in rule.items.items():
            child = f"try_variant_get(x, '$.{name}', 'variant')"
            if sub.required:
                parts.append(_says(label, f"{is_object} AND {child} IS NULL", _q(f"'{name}' is a required property")))
            parts += _field_errors(_value_of(child), sub, f"concat('{path}.', i, '.{name}')")
    body = f"array_compact(array({', '.join(parts)}))"
    return f"coalesce(flatten(transform({items}, (x, i) -> {body})), CAST(array() AS array<string>))"


def quality_warnings(record: Column, source_type: str) -> Column:
    """Findings that do not make a record invalid, as ``array<string>``."""

    def get(path, kind):
        return F.try_variant_get(record, path, kind)

    if source_type == "survey":
        empty = F.coalesce(F.size(F.map_keys(get("$.responses", "map<string,variant>"))), F.lit(0)) <= 0
        parts = [
            F.when(empty, "Survey has no responses"),
            F.when(get("$.responses.suicidal_ideation", "boolean"), "Critical: Suicidal ideation reported"),
            F.when(get("$.responses.self_harm", "boolean"), "Critical: Self-harm reported"),
        ]
    elif source_type == "wearable":
        complete = get("$.data_quality.completeness_percent", "double")
        worn = get("$.data_quality.wear_time_minutes", "double")
        parts = [
            F.when(complete < LOW_COMPLETENESS, F.concat(F.lit("Low data completeness: "), get("$.data_quality.completeness_percent", "string"), F.lit("%"))),
            F.when(worn < LOW_WEAR_MINUTES, F.concat(F.lit("Low wear time: "), get("$.data_quality.wear_time_minutes", "string"), F.lit(" minutes"))),
        ]
    else:
        stays = get("$.hospitalizations", "array<variant>")
        forced = F.exists(stays, lambda h: F.coalesce(F.try_variant_get(h, "$.involuntary", "boolean"), F.lit(False)))
        parts = [
            F.when(get("$.risk_factors.suicide_attempts", "double") > 0, "Critical: History of suicide attempts"),
            F.when(forced, "Critical: History of involuntary hospitalization"),
        ]
    return F.array_compact(F.array(*parts))


def check_records(df: DataFrame, json_column: str, source_type: str, contract: Rule | None = None) -> DataFrame:
    """Add ``is_valid``, ``errors`` and ``warnings`` to rows of one source type.

    The record is parsed once, then every field is read once in its own projection, so the
    rules below only look at columns. The rules are built as SQL text: one parse instead of
    thousands of Column calls.
    """
    if contract is None and source_type not in CONTRACTS:
        raise ValueError(f"unknown source type: {source_type}")
    rule = contract or CONTRACTS[source_type]
    fields = _walk(rule)
    at = {path: i for i, (path, _, _, _) in enumerate(fields)}
    reads, forms = ["*"], ["*"]
    values = {}
    for path, i in at.items():
        sub, v = fields[i][2], f"_v{i}"
        where = f"$.{path}" if path else "$"
        reads.append(f"try_variant_get(_rec, '{where}', 'variant') AS {v}")
        forms.append(f"schema_of_variant({v}) AS _k{i}")
        if sub.kind in ("number", "integer"):
            forms.append(f"try_variant_get({v}, '$', 'double') AS _n{i}")
        if sub.kind == "string" and (sub.enum or sub.pattern or sub.max_length is not None):
            forms.append(f"try_variant_get({v}, '$', 'string') AS _s{i}")
        if sub.kind == "array":
            forms.append(f"try_variant_get({v}, '$', 'array<variant>') AS _a{i}")
        values[i] = _Value(v, f"_k{i}", f"_n{i}", f"_s{i}")
    data = df.withColumn("_rec", F.try_parse_json(json_column)).selectExpr(*reads).selectExpr(*forms)
    flat, nested = [_says("'root'", "_rec IS NULL", _q("is not valid JSON"))], []
    for path, parent_path, sub, parent in fields:
        i = at[path]
        if parent is not None and sub.required:
            j = at[parent_path]
            missing = f"startswith(_k{j}, 'OBJECT') AND _v{i} IS NULL"
            flat.append(_says(_q(parent_path or "root"), missing, _q(f"'{path.rpartition('.')[2]}' is a required property")))
        flat += _field_errors(values[i], sub, _q(path or "root"))
        if sub.kind == "array" and (sub.items or sub.item_enum):
            nested.append(_item_errors(f"_a{i}", sub, path))
    errors = F.expr(f"concat({', '.join([f'array_compact(array({chr(44).join(flat)}))', *nested])})")
    warnings = quality_warnings(F.col("_rec"), source_type) if source_type in CONTRACTS else F.array().cast("array<string>")
    checked = data.select(*df.columns, errors.alias("errors"), warnings.alias("warnings"))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def check_by_source(df: DataFrame, json_column: str, source_column: str) -> DataFrame:
    """Route rows by source type; an unknown type is itself an error."""
    branches = [check_records(df.filter(F.col(source_column) == s), json_column, s) for s in CONTRACTS]
    other = df.filter(~F.coalesce(F.col(source_column).isin(*CONTRACTS), F.lit(False)))
    unknown = F.array(F.concat(F.lit("Unsupported source type: "), F.coalesce(F.col(source_column), F.lit("null"))))
    branches.append(
        other.withColumns({"errors": unknown, "warnings": F.array().cast("array<string>"), "is_valid": F.lit(False)})
    )
    return reduce(lambda a, b: a.unionByName(b), branches)


def require_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Project to the expected columns in order; missing ones fail when the plan is built."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*expected)


def schema_conformity(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Problems of a table against ``column → int|float|string`` (empty list when it fits)."""
    families = {
        "int": ("byte", "short", "integer", "long"),
        "float": ("float", "double", "decimal"),
        "string": ("string",),
    }
    problems = []
    for name, family in expected.items():
        if name not in df.columns:
            problems.append(f"missing column {name}")
        elif df.schema[name].dataType.typeName() not in families.get(family, (family,)):
            problems.append(f"{name} is {df.schema[name].dataType.simpleString()}, not {family}")
    return problems


def completeness(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Add ``null_fraction`` over all columns and ``mostly_missing`` (fraction above threshold)."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    out = df.withColumn("null_fraction", nulls / F.lit(float(len(df.columns))))
    return out.withColumn("mostly_missing", F.col("null_fraction") > threshold)


def constant_columns(df: DataFrame, columns: list[str], empty_too: bool = True) -> DataFrame:
    """``(column_name, is_constant)``: at most one distinct value (or exactly one)."""
    row = df.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in columns])
    cells = []
    for c in columns:
        same = F.col(f"{c}.a") == F.col(f"{c}.b")
        value = F.coalesce(same, F.lit(empty_too))
        cells.append(F.struct(F.lit(c).alias("column_name"), value.alias("is_constant")))
    return row.select(F.inline(F.array(*cells)))


def any_null(df: DataFrame, subset: list[str]) -> Column:
    return any_of([F.col(c).isNull() for c in subset])
