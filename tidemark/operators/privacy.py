"""Hashing of identifiers and redaction of personal data in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.common import all_of, col


# What is redacted, in this order.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "zip_code": r"\b\d{5}(?:-\d{4})?\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
REPLACEMENT = "[REDACTED]"
# Word boundaries, digits and blanks in the Unicode sense.
UNICODE_CLASSES = "(?U)"


def _pattern(name: str) -> Column:
    return F.lit(UNICODE_CLASSES + PII_PATTERNS[name])


def hash_identifier(value: str | Column, salt: str) -> Column:
    """Hex sha-256 of value followed by salt; a null or empty value gives an empty string."""
    v = col(value).cast("string")
    return F.when(v.isNull() | (v == ""), F.lit("")).otherwise(F.sha2(F.concat(v, F.lit(salt)), 256))


def composite_identifier(parts: Sequence[str | Column], salt: str) -> Column:
    """Hash of the non-empty parts joined by a pipe character."""
    kept = [F.when(col(p).cast("string") != "", col(p).cast("string")) for p in parts]
    return hash_identifier(F.concat_ws("|", *kept), salt)


def redact_text(text: str | Column, patterns: Sequence[str] | None = None, replacement: str = REPLACEMENT) -> Column:
    out = col(text)
    for name in patterns or PII_PATTERNS:
        if name in PII_PATTERNS:
            out = F.regexp_replace(out, _pattern(name), F.lit(replacement))
    return out


def redact(
    df: DataFrame, text_column: str, patterns: Sequence[str] | None = None, replacement: str = REPLACEMENT
) -> DataFrame:
    """Replace the text and add ``redaction_count``.

    Each pattern is counted in the text the earlier patterns left, so each step is its own
    column; Spark evaluates every replacement once per row.
    """
    names = [n for n in patterns or PII_PATTERNS if n in PII_PATTERNS]
    out = df
    current = text_column
    for i, n in enumerate(names):
        text, pattern = F.col(current), _pattern(n)
        out = out.withColumn(f"_n{i}", F.regexp_count(text, pattern))
        # most texts hold no match, so the second pass is rarely made
        out = out.withColumn(f"_t{i}", F.when(F.col(f"_n{i}") > 0, F.regexp_replace(text, pattern, F.lit(replacement))).otherwise(text))
        current = f"_t{i}"
    total = sum((F.coalesce(F.col(f"_n{i}"), F.lit(0)) for i in range(len(names))), F.lit(0))
    kept = [F.col(current).alias(c) if c == text_column else F.col(c) for c in df.columns]
    return out.select(*kept, total.alias("redaction_count"))


def anonymize_record(df: DataFrame, fields: Sequence[str], salt: str) -> DataFrame:
    """Hash the listed top-level columns; absent ones are skipped."""
    return df.withColumns({c: hash_identifier(c, salt) for c in fields if c in df.columns})


def _edit(value: Column, schema: T.DataType, path: list[str], change) -> Column | None:
    head, rest = path[0], path[1:]
    if not isinstance(schema, T.StructType) or head not in schema.fieldNames():
        return None
    child = value[head]
    inner = change(child) if not rest else _edit(child, schema[head].dataType, rest, change)
    if inner is None:
        return None
    return F.when(value.isNotNull(), value.withField(head, F.when(child.isNotNull(), inner)))


def anonymize_nested(df: DataFrame, hash_paths: Sequence[str], text_paths: Sequence[str], salt: str) -> DataFrame:
    """Hash or redact by dotted path into structs; a path that is not there changes nothing."""
    out = df
    jobs = [(p, lambda c: hash_identifier(c, salt)) for p in hash_paths] + [(p, redact_text) for p in text_paths]
    for path, change in jobs:
        parts = path.split(".")
        if parts[0] not in out.columns:
            continue
        if len(parts) == 1:
            new = change(F.col(parts[0]))
        else:
            new = _edit(F.col(parts[0]), out.schema[parts[0]].dataType, parts[1:], change)
        if new is not None:
            out = out.withColumn(parts[0], new)
    return out


def looks_hashed(value: str | Column) -> Column:
    return F.coalesce(F.rlike(col(value), F.lit("^[0-9a-fA-F]{64}$")), F.lit(False))


def verify_anonymized(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``is_anonymized``: every listed, non-empty field is 64 hex characters."""
    tests = [F.col(c).isNull() | (F.col(c) == "") | looks_hashed(c) for c in fields if c in df.columns]
    return df.withColumn("is_anonymized", all_of(tests))
