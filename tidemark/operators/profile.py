"""Profiling: summaries, quality issues, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.common import count_if, severity
from tidemark.operators.clean import numeric_columns, string_columns, wide_to_long
from tidemark.operators.ordered import attach, column_quantiles, counted_in_ranges, long_values, ranged_quantiles, running_totals, top_k_per_key
from tidemark.session import written

# Severity limits in percent, and what counts as an identifier-like column.
MISSING_STEPS = [(50.0, "critical"), (20.0, "high"), (5.0, "medium")]
OUTLIER_STEPS = [(10.0, "high"), (5.0, "medium")]
DUPLICATE_STEPS = [(10.0, "high"), (5.0, "medium")]
HIGH_CARDINALITY_PCT = 90.0
HIGH_CORRELATION = 0.9
SMALL_DATASET = 100
MANY_NUMERIC = 50


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one; null below three values."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population one; null below four values."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def _moments(c: str) -> Column:
    x = F.col(c).cast("double")
    n = F.count(x).cast("double")
    flat = F.var_pop(x) == 0
    g1 = F.when(flat, F.lit(0.0)).otherwise(F.skewness(x))
    g2 = F.when(flat, F.lit(0.0)).otherwise(F.kurtosis(x))
    return F.struct(
        F.lit(c).alias("column_name"),
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.when(flat & (n > 2), F.lit(0.0)).otherwise(sample_skewness(g1, n)).alias("skewness"),
        F.when(flat & (n > 3), F.lit(0.0)).otherwise(sample_kurtosis(g2, n)).alias("kurtosis"),
    )


class Profile:
    """What summaries, issues and statistics of a table have in common, each part read once.

    ``row`` is one aggregate over the table: rows, nulls, moments and covariances. ``values``
    holds the counted values of text columns, ``numbers`` those of numeric ones, in ranges, from
    which quartiles and outliers follow without another look at the table.
    """

    def __init__(self, df: DataFrame, numeric: Sequence[str] | None = None, text: Sequence[str] | None = None, pairs: bool = False):
        self.df, self.pairs = df, pairs
        self.numeric = list(numeric) if numeric is not None else numeric_columns(df)
        self.text = list(text) if text is not None else string_columns(df)

    @cached_property
    def row(self) -> DataFrame:
        parts = [F.count("*").alias("rows"), F.array(*[F.struct(F.lit(c).alias("column_name"), count_if(F.col(c).isNull()).alias("nulls")) for c in self.df.columns]).alias("nulls")]
        if self.numeric:
            parts.append(F.array(*[_moments(c) for c in self.numeric]).alias("moments"))
        if self.pairs and len(self.numeric) > 1:
            parts.append(F.array(*_pearson_cells(self.numeric)).alias("pairs"))
        return written(self.df.agg(*parts), "profile")

    @cached_property
    def values(self) -> DataFrame:
        return written(value_counts(self.df, self.text), "values")

    @cached_property
    def numbers(self) -> DataFrame:
        return counted_in_ranges(long_values(self.df, self.numeric), ["column_name"], "value")

    @cached_property
    def quartiles(self) -> DataFrame:
        return written(ranged_quantiles(self.numbers, ["column_name"], [0.25, 0.5, 0.75]), "quartiles")

    def numeric_summary(self) -> DataFrame:
        moments = self.row.select(F.inline("moments")).filter(F.col("count") > 0)
        return moments.join(self.quartiles, "column_name").select(
            "column_name", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max", "skewness", "kurtosis",
        )

    def categorical_summary(self) -> DataFrame:
        per = self.values.groupBy("column_name").agg(
            F.sum("n").alias("count"),
            F.count("*").alias("unique"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
            F.max("n").alias("freq"),
        )
        return attach(per, self.row.select("rows")).withColumn("missing", F.col("rows") - F.col("count")).drop("rows")

    def null_counts(self) -> DataFrame:
        return self.row.select(F.inline("nulls"))

    def outlier_counts(self, k: float = 3.0) -> DataFrame:
        """``(column_name, count, outliers)`` beyond k·IQR of the quartiles, from the counted values."""
        # one entry per column, attached as one row: a column may own most values
        fences = self.quartiles.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "q"))).alias("_q"))
        rows = attach(self.numbers, fences).withColumn("_q", F.element_at("_q", F.col("column_name")))
        low, high = F.col("_q")[0], F.col("_q")[2]
        out = (F.col("_v") < low - k * (high - low)) | (F.col("_v") > high + k * (high - low))
        return rows.groupBy("column_name").agg(F.sum("_n").alias("count"), F.coalesce(F.sum(F.when(out, F.col("_n"))), F.lit(0)).alias("outliers"))

    def correlations(self) -> DataFrame:
        return self.row.select(F.inline("pairs"))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column with any value: moments and exact quartiles."""
    return Profile(df, columns).numeric_summary()


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, value, n)`` of the non-null values, all columns in one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Most frequent values per column; ties by value."""
    return top_k_per_key(value_counts(df, columns), ["column_name"], [F.desc("n"), F.asc("value")], k)


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, commonest value with its frequency, and missing cells."""
    return Profile(df, text=columns).categorical_summary()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns) if columns is not None else df.columns
    return wide_to_long(df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols]), cols, "column_name", "nulls")


def compare_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(column_name, place, left_type, right_type, left_nulls, right_nulls)``: columns of one table, the other or both."""
    def described(df, side):
        kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
        nulls = null_counts(df)
        return nulls.select("column_name", F.element_at(kinds, F.col("column_name")).alias(f"{side}_type"), F.col("nulls").alias(f"{side}_nulls"))

    both = described(left, "left").join(described(right, "right"), "column_name", "full_outer")
    place = F.when(F.col("right_type").isNull(), "left").when(F.col("left_type").isNull(), "right").otherwise("both")
    return both.select("column_name", place.alias("place"), "left_type", "right_type", "left_nulls", "right_nulls")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``(rows, duplicates)``: rows beyond the first of each identical set."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return per.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates"))


def outlier_rows(df: DataFrame, columns: Sequence[str], key: Sequence[str], k: float = 3.0, per_column: int | None = None) -> DataFrame:
    """Outlying rows of each column, or the first ``per_column`` of them by key: ``(column_name, key…, value)``."""
    fences = column_quantiles(df, columns, [0.25, 0.75])
    names = [f"_b{i}" for i in range(len(columns))]
    row = fences.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q"))).alias(b) for c, b in zip(columns, names)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"), F.col(b).alias("q")) for c, b in zip(columns, names)
    ])
    # the fences come as one row, so a table of few columns is not dealt by their names
    hits = attach(df.select(*dict.fromkeys([*key, *columns])), row).select(*key, F.inline(cells))
    low, high = F.col("q")[0], F.col("q")[1]
    spread = high - low
    hits = hits.filter((F.col("value") < low - k * spread) | (F.col("value") > high + k * spread))
    if per_column is None:
        return hits.select("column_name", *key, "value")
    return top_k_per_key(hits.drop("q"), ["column_name"], [F.asc(c) for c in key], per_column).drop("rank")


def quality_issues(df: DataFrame) -> DataFrame:
    """``(issue_type, severity, column_name, affected_rows, pct)`` for every defect found."""
    return _issues(Profile(df))


def _issues(p: Profile) -> DataFrame:
    rows = p.row.select(F.col("rows").alias("_rows"))
    parts = []

    def issue(found, kind, level, column, affected):
        return found.select(F.lit(kind).alias("issue_type"), level.alias("severity"), column.alias("column_name"), F.col(affected).alias("affected_rows"), "pct")

    missing = attach(p.null_counts(), rows).filter("nulls > 0").withColumn("pct", F.col("nulls") / F.col("_rows") * 100)
    parts.append(issue(missing, "missing", severity(F.col("pct"), MISSING_STEPS, "low"), F.col("column_name"), "nulls"))
    if p.numeric:
        out = p.outlier_counts().filter("outliers > 0").withColumn("pct", F.col("outliers") / F.col("count") * 100)
        parts.append(issue(out, "outlier", severity(F.col("pct"), OUTLIER_STEPS, "low"), F.col("column_name"), "outliers"))
        constant = attach(p.row.select(F.inline("moments")).filter("min = max"), rows).withColumn("pct", F.lit(100.0))
        parts.append(issue(constant, "inconsistent", F.lit("medium"), F.col("column_name"), "_rows"))
    dup = duplicate_rows(p.df).filter("duplicates > 0").withColumn("pct", F.col("duplicates") / F.col("rows") * 100)
    parts.append(issue(dup, "duplicate", severity(F.col("pct"), DUPLICATE_STEPS, "low"), F.lit(None).cast("string"), "duplicates"))
    if p.text:
        uniques = attach(p.values.groupBy("column_name").agg(F.count("*").alias("u")), rows)
        many = uniques.withColumn("pct", F.col("u") / F.col("_rows") * 100).filter(F.col("pct") >= HIGH_CARDINALITY_PCT)
        parts.append(issue(many, "inconsistent", F.lit("medium"), F.col("column_name"), "_rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _pearson(a: str, b: str) -> Column:
    """Correlation over rows where both are present; null for a constant side."""
    x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
    y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pearson_cells(columns: Sequence[str]) -> list[Column]:
    return [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), _pearson(a, b).alias("r")) for a, b in combinations(columns, 2)]


def correlations(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """``(feature_a, feature_b, r)`` for each pair, over rows where both are present."""
    if method == "pearson":
        return df.agg(F.array(*_pearson_cells(columns)).alias("pairs")).select(F.inline("pairs"))
    if method != "spearman":
        raise ValueError(f"unknown method: {method}")
    return _rank_correlations(df, columns)


def _rank_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman of all pairs in one pass: joint counts of each pair's values, both sides ranked together."""
    pairs = list(combinations(columns, 2))
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")) for i, (a, b) in enumerate(pairs)])
    joint = written(df.select(F.inline(cells)).dropna().groupBy("_i", "_a", "_b").agg(F.count("*").alias("_w")), "joint-counts")
    sides = joint.select("_i", F.inline(F.array(*[F.struct(F.lit(side).alias("_side"), F.col(x).alias("_x"), F.col("_w").alias("_n")) for side, x in ((0, "_a"), (1, "_b"))])))
    run = running_totals(sides.groupBy("_i", "_side", "_x").agg(F.sum("_n").alias("_n")), ["_i", "_side"], "_x", ["_n"])
    ranks = run.select("_i", "_side", "_x", (F.col("cum__n") - (F.col("_n") - 1) / 2.0).alias("_r"))  # ties share their mean rank
    first, second = (ranks.filter(F.col("_side") == side).select("_i", F.col("_x").alias(x), F.col("_r").alias(r)) for side, x, r in ((0, "_a", "_ra"), (1, "_b", "_rb")))
    w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
    sums = joint.join(first, ["_i", "_a"]).join(second, ["_i", "_b"]).groupBy("_i").agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"),
    )
    top = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    bottom = F.sqrt((F.col("sxx") - F.col("sx") ** 2 / F.col("n")) * (F.col("syy") - F.col("sy") ** 2 / F.col("n")))
    found = sums.select("_i", F.when(bottom > 0, top / bottom).alias("r"))
    names = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b")) for i, (a, b) in enumerate(pairs)])
    every = df.sparkSession.range(1).select(F.inline(names))  # a pair without common rows has no coefficient
    return every.join(found, "_i", "left").select("feature_a", "feature_b", "r")


def high_correlations(matrix: DataFrame, limit: float = HIGH_CORRELATION) -> DataFrame:
    return matrix.filter(F.abs("r") > limit)


def dataset_flags(df: DataFrame) -> DataFrame:
    """``(flag, n)`` of the advice rules that apply to a dataset."""
    p = Profile(df, pairs=True)
    issues = _issues(p).groupBy("severity").agg(F.count("*").alias("n"))
    rows = p.row.select(F.col("rows").alias("n"))
    parts = [
        issues.filter("severity = 'critical'").select(F.lit("critical_issues").alias("flag"), "n"),
        issues.filter("severity = 'high'").select(F.lit("high_issues").alias("flag"), "n"),
        rows.filter(F.col("n") < SMALL_DATASET).select(F.lit("small_dataset").alias("flag"), "n"),
    ]
    if len(p.numeric) > MANY_NUMERIC:
        parts.append(rows.filter("n > 0").select(F.lit("many_features").alias("flag"), F.lit(len(p.numeric)).cast("long").alias("n")))
    if len(p.numeric) > 1:
        pairs = high_correlations(p.correlations()).agg(F.count("*").alias("n")).filter("n > 0")
        parts.append(pairs.select(F.lit("correlated_pairs").alias("flag"), "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def full_profile(df: DataFrame) -> DataFrame:
    """Long ``(section, column_name, key, value)`` of summaries, issues and correlations; the table is read four times."""
    p = Profile(df, pairs=True)
    parts = []

    def cells(summary, section, keys):
        long = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys])
        return summary.select(F.lit(section).alias("section"), "column_name", F.inline(long))

    if p.numeric:
        s = p.numeric_summary()
        parts.append(cells(s, "numeric", [c for c in s.columns if c != "column_name"]))
    if p.text:
        parts.append(cells(p.categorical_summary(), "categorical", ("count", "unique", "freq", "missing")))
    issue = F.concat_ws(":", "issue_type", "severity").alias("key")
    parts.append(_issues(p).select(F.lit("issue").alias("section"), "column_name", issue, F.col("affected_rows").cast("double").alias("value")))
    if len(p.numeric) > 1:
        parts.append(p.correlations().select(F.lit("correlation").alias("section"), F.col("feature_a").alias("column_name"), F.col("feature_b").alias("key"), F.col("r").alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def version_statistics(df: DataFrame, top: int = 5) -> DataFrame:
    """Long statistics stored with a dataset version: numeric, categorical with top values, nulls."""
    p = Profile(df)
    parts = []
    nothing = F.lit(None).cast("string")
    if p.numeric:
        keys = ("mean", "std", "min", "max", "median")
        cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])
        parts.append(p.numeric_summary().select("column_name", F.inline(cells)).withColumn("item", nothing))
    if p.text:
        parts.append(
            p.values.groupBy("column_name").agg(F.count("*").cast("double").alias("value")).withColumns({"key": F.lit("unique"), "item": nothing})
        )
        best = top_k_per_key(p.values, ["column_name"], [F.desc("n"), F.asc("value")], top)
        parts.append(best.select("column_name", F.lit("top").alias("key"), F.col("n").cast("double").alias("value"), F.col("value").alias("item")))
    parts.append(p.null_counts().select("column_name", F.lit("nulls").alias("key"), F.col("nulls").cast("double").alias("value"), nothing.alias("item")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def feature_summary(features: DataFrame, id_column: str = "anonymized_id") -> DataFrame:
    """Individuals, feature counts by name family and share of missing cells, as one row."""
    cols = features.columns
    numeric = [c for c in numeric_columns(features)]
    families = {
        "behavioral_features": ("activity", "routine", "social"),
        "sentiment_features": ("sentiment", "crisis"),
        "physiological_features": ("sleep", "hrv", "heart"),
        "adherence_features": ("adherence", "engagement", "missed"),
    }
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in cols])
    row = features.agg(F.count("*").alias("num_individuals"), F.sum(nulls).alias("_nulls"))
    extra = {
        "num_features": F.lit(len(cols) - 1).cast("long"),
        "num_numeric_features": F.lit(len(numeric)).cast("long"),
        "missing_values_pct": F.when(F.col("num_individuals") > 0, F.col("_nulls") / (F.col("num_individuals") * len(cols)) * 100),
    }
    for name, words in families.items():
        extra[name] = F.lit(sum(any(w in c for w in words) for c in cols)).cast("long")
    return row.withColumns(extra).drop("_nulls")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class, and whether it is the smallest one."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"), F.min("n").alias("_least"))
    return attach(counts, total).select(
        label, "n", (F.col("n") / F.col("_total")).alias("share"), (F.col("n") == F.col("_least")).alias("is_minority")
    )
