"""Feature store: definitions as SQL expressions, computing, materializing, serving."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordered import latest_per_key
from tidemark.operators.validate import schema_conformity

FEATURE_TYPES = ("numeric", "categorical", "text", "boolean", "embedding")


@dataclass(frozen=True)
class FeatureDefinition:
    """A feature is a SQL expression, a callable ``DataFrame → Column``, or a dict of several."""

    name: str
    feature_type: str
    expression: str | Callable[[DataFrame], Column] | dict[str, str]
    input_schema: dict[str, str] = field(default_factory=dict)
    dependencies: tuple[str, ...] = ()
    version: str = "1.0.0"
    owner: str | None = None
    description: str | None = None

    def outputs(self) -> list[str]:
        return list(self.expression) if isinstance(self.expression, dict) else [self.name]


class FeatureRegistry:
    """Definitions by name. Small metadata: it only orders and builds the plan."""

    def __init__(self) -> None:
        self.definitions: dict[str, FeatureDefinition] = {}

    def register(self, d: FeatureDefinition) -> None:
        if not d.name or not d.expression:
            raise ValueError("a feature needs a name and an expression")
        if d.feature_type not in FEATURE_TYPES:
            raise ValueError(f"unknown feature type: {d.feature_type}")
        if d.name in self.definitions:
            raise ValueError(f"{d.name} exists")
        missing = [x for x in d.dependencies if x not in self.definitions]
        if missing:
            raise ValueError(f"unknown dependencies: {missing}")
        self.definitions[d.name] = d

    def order(self, names: Sequence[str]) -> list[str]:
        """Dependencies first, each once; a cycle is an error."""
        done: list[str] = []
        open_names: set[str] = set()

        def visit(n: str) -> None:
            if n in done:
                return
            if n in open_names:
                raise ValueError(f"dependency cycle at {n}")
            if n not in self.definitions:
                raise ValueError(f"unknown feature: {n}")
            open_names.add(n)
            for x in self.definitions[n].dependencies:
                visit(x)
            open_names.discard(n)
            done.append(n)

        for n in names:
            visit(n)
        return done


def compute_features(registry: FeatureRegistry, names: Sequence[str], df: DataFrame, entity_id: str = "entity_id") -> DataFrame:
    """Id plus the asked features, all in one lazy plan."""
    out = df
    for n in registry.order(names):
        d = registry.definitions[n]
        problems = schema_conformity(out, d.input_schema)
        if problems:
            raise ValueError(f"{n}: {'; '.join(problems)}")
        if isinstance(d.expression, dict):
            out = out.withColumns({k: F.expr(e) for k, e in d.expression.items()})
        elif callable(d.expression):
            out = out.withColumn(n, d.expression(out))
        else:
            out = out.withColumn(n, F.expr(d.expression))
    asked = [c for n in names for c in registry.definitions[n].outputs()]
    return out.select(entity_id, *asked)


def materialize(features: DataFrame, computed_at: Column, entity_id: str = "entity_id", dataset_version: str | None = None) -> DataFrame:
    """Long ``feature_values`` rows, one per non-null cell, ready to append."""
    names = [c for c in features.columns if c != entity_id]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("value")) for n in names])
    return features.select(F.col(entity_id).alias("entity_id"), F.inline(cells)).filter("value IS NOT NULL").withColumns(
        {"computed_at": computed_at, "dataset_version": F.lit(dataset_version).cast("string")}
    )


def append_values(values: DataFrame, path: str) -> None:
    values.write.mode("append").partitionBy("feature").parquet(path)


def latest_values(values: DataFrame) -> DataFrame:
    return latest_per_key(values, ["feature", "entity_id"], ["computed_at", "value"])


def serve(values: DataFrame, ids: DataFrame, names: Sequence[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Latest value of each asked feature per requested id; missing ones are null."""
    kinds = kinds or {}
    wanted = values.filter(F.col("feature").isin(*names)).join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    newest = F.max_by("value", F.struct("computed_at", "value"))
    pairs = wanted.groupBy("entity_id", "feature").agg(newest.alias("value"))
    wide = pairs.groupBy("entity_id").agg(
        *[F.max(F.when(F.col("feature") == n, F.col("value"))).cast(kinds.get(n, "string")).alias(n) for n in names]
    )
    return ids.join(wide, "entity_id", "left")
