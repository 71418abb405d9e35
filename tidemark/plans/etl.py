"""Clean → impute → encode → scale as one fitted job, and padded sequences."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidemark.functions.common import count_if
from tidemark.operators import clean, encode, impute, scale
from tidemark.operators.ordered import attach, exact_quantiles, top_k_per_key
from tidemark.session import written


@dataclass
class EtlConfig:
    outlier_columns: list[str] = field(default_factory=list)
    domain_rules: dict[str, tuple] = field(default_factory=dict)
    iqr_k: float = 1.5
    invalid_values: list[str] | None = None
    impute: dict[str, str] = field(default_factory=dict)
    target_column: str | None = None
    target_encode_columns: list[str] = field(default_factory=list)
    one_hot_columns: list[str] = field(default_factory=list)
    ordinal: dict[str, list] = field(default_factory=dict)
    group_scale_columns: list[str] = field(default_factory=list)
    standardize_columns: list[str] = field(default_factory=list)
    min_max_columns: list[str] = field(default_factory=list)
    id_column: str = "anonymized_id"
    timestamp_column: str = "timestamp"
    tiebreak: list[str] = field(default_factory=list)


@dataclass
class FittedEtl:
    """Everything learnt at fit. ``transform`` does not depend on how rows are batched.

    It is lazy, but for fills in time order, whose series are written in ranges first.
    """

    config: EtlConfig
    bounds: dict[str, tuple[float, float]]
    imputer: impute.FittedImputer
    targets: list[encode.TargetEncoding]
    one_hot: encode.OneHotEncoding
    group_scaler: scale.FittedGroupScaler | scale.FittedScaler | None
    scalers: list[scale.FittedScaler]

    def transform(self, df: DataFrame) -> DataFrame:
        c = self.config
        out = _clean(df, c, self.bounds)
        out = _impute(out, c, self.imputer)
        return self.scaled(_encode(out, c, self.targets, self.one_hot))

    def scaled(self, encoded: DataFrame) -> DataFrame:
        out = self.group_scaler.transform(encoded) if self.group_scaler is not None else encoded
        for s in self.scalers:
            out = s.transform(out)
        return out

    def stats(self, df: DataFrame) -> DataFrame:
        """Rows in and out, duplicates dropped and flagged outliers, as one row."""
        c = self.config
        cleaned = _clean(df, c, self.bounds)
        flags = [n for n in cleaned.columns if n.endswith("_outlier")]
        after = cleaned.agg(
            F.count("*").alias("rows_out"), *[count_if(F.col(n)).alias(n.replace("_outlier", "_outliers")) for n in flags]
        )
        before = df.agg(F.count("*").alias("rows_in"))
        return attach(before, after).withColumn("duplicates_removed", F.col("rows_in") - F.col("rows_out"))

    def save(self, path: str) -> None:
        """Scalar parameters as one JSON text file, per-group and per-category ones as parquet."""
        spark = SparkSession.active()
        group = None
        if isinstance(self.group_scaler, scale.FittedGroupScaler):
            group = {"columns": self.group_scaler.columns, "params": None}
        elif self.group_scaler is not None:
            group = {"columns": None, "params": self.group_scaler.params}
        scalar = {
            "config": vars(self.config),
            "bounds": self.bounds,
            "impute": {"strategies": self.imputer.strategies, "values": self.imputer.values},
            "one_hot": self.one_hot.levels,
            "scalers": [s.params for s in self.scalers],
            "group": group,
            "targets": [t.column for t in self.targets],
        }
        text = json.dumps(scalar, default=str)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scalars")
        if isinstance(self.group_scaler, scale.FittedGroupScaler):
            self.group_scaler.params.write.mode("overwrite").parquet(f"{path}/group")
        for t in self.targets:
            t.mapping.write.mode("overwrite").parquet(f"{path}/target_{t.column}")
            t.global_mean.write.mode("overwrite").parquet(f"{path}/target_{t.column}_global")


def load_etl(spark: SparkSession, path: str) -> FittedEtl:
    saved = json.loads(spark.read.text(f"{path}/scalars").first()[0])
    config = EtlConfig(**saved["config"])
    config.domain_rules = {k: tuple(v) for k, v in config.domain_rules.items()}
    group = None
    if saved["group"] is not None:
        if saved["group"]["columns"] is not None:
            group = scale.FittedGroupScaler(saved["group"]["columns"], config.id_column, spark.read.parquet(f"{path}/group"))
        else:
            group = scale.FittedScaler({k: tuple(v) for k, v in saved["group"]["params"].items()})
    targets = [
        encode.TargetEncoding(
            c, spark.read.parquet(f"{path}/target_{c}"), spark.read.parquet(f"{path}/target_{c}_global")
        )
        for c in saved["targets"]
    ]
    return FittedEtl(
        config,
        {k: tuple(v) for k, v in saved["bounds"].items()},
        impute.FittedImputer(**saved["impute"]),
        targets,
        encode.OneHotEncoding(saved["one_hot"]),
        group,
        [scale.FittedScaler({k: tuple(v) for k, v in p.items()}) for p in saved["scalers"]],
    )


def _deduplicate(df: DataFrame, c: EtlConfig) -> DataFrame:
    return clean.remove_duplicates(df, c.id_column, c.timestamp_column, c.tiebreak)


def _flag_and_null(df: DataFrame, c: EtlConfig, bounds) -> DataFrame:
    """Outliers are flagged before infinities are nulled, so an infinite cell is an outlier."""
    return clean.handle_invalid_values(clean.flag_outliers(df, c.outlier_columns, bounds, c.domain_rules), c.invalid_values)


def _clean(df: DataFrame, c: EtlConfig, bounds) -> DataFrame:
    return _flag_and_null(_deduplicate(df, c), c, bounds)


def _impute(df: DataFrame, c: EtlConfig, imputer: impute.FittedImputer) -> DataFrame:
    id_column = c.id_column if c.id_column in df.columns else None
    order = [x for x in [c.timestamp_column, *c.tiebreak] if x in df.columns]
    return imputer.transform(df, id_column, order)


def _encode(df: DataFrame, c: EtlConfig, targets, one_hot) -> DataFrame:
    for t in targets:
        if t.column in df.columns:
            df = t.transform(df)
    df = one_hot.transform(df)
    return encode.ordinal_encode(df, {k: v for k, v in c.ordinal.items() if k in df.columns}) if c.ordinal else df


def _written_observing(df: DataFrame, name: str, aggregates: list[Column]) -> tuple[DataFrame, dict]:
    """The table, written once, and the aggregates over its rows, taken as they pass."""
    if not aggregates:
        return written(df, name), {}
    seen = Observation()
    return written(df.observe(seen, *aggregates), name), seen.get


def _quartiles(df: DataFrame, fences: dict[str, Column], medians: dict[str, Column], k: float) -> tuple[dict, dict]:
    """Outlier fences and medians of all columns, by one pass over their distinct values."""
    cells = [F.struct(F.lit(use).alias("use"), F.lit(x).alias("x"), v.cast("double").alias("v")) for use, of in (("fence", fences), ("median", medians)) for x, v in of.items()]
    if not cells:
        return {}, {}
    found = exact_quantiles(df.select(F.inline(F.array(*cells))), ["use", "x"], "v", [0.25, 0.5, 0.75]).collect()  # one row per column
    spread = {r["x"]: r["q"][2] - r["q"][0] for r in found if r["use"] == "fence"}
    bounds = {r["x"]: (r["q"][0] - k * spread[r["x"]], r["q"][2] + k * spread[r["x"]]) for r in found if r["use"] == "fence"}
    return bounds, {x: None for x in medians} | {r["x"]: r["q"][1] for r in found if r["use"] == "median"}


def fit_etl(df: DataFrame, config: EtlConfig) -> FittedEtl:
    """Fit stage by stage: each stage's parameters come from the output of the stages before."""
    return fit_transform(df, config)[0]


def fit_transform(df: DataFrame, config: EtlConfig) -> tuple[FittedEtl, DataFrame]:
    """The fitted job and its result on the rows that it was fitted on.

    The rows are written twice, without duplicates and filled. What a stage needs is observed
    while they are written, or read in one pass over what was written: the quartiles and
    medians of all columns together, the levels, the groups. Nothing is computed twice.
    """
    c = config
    unique = _deduplicate(df, c)
    fields = {f.name: f for f in unique.schema.fields}
    strategies = impute.known_strategies(c.impute, unique.columns)
    valid = {x: clean.valid_value(fields[x], c.invalid_values) for x in strategies}
    means = [x for x, s in strategies.items() if s == "mean"]
    unique, known = _written_observing(unique, "etl-unique", [F.avg(valid[x]).alias(x) for x in means])
    fences = [x for x in c.outlier_columns if x in fields and x not in c.domain_rules]
    medians = [x for x, s in strategies.items() if s == "median"]
    bounds, middles = _quartiles(unique, {x: F.col(x) for x in fences}, {x: valid[x] for x in medians}, c.iqr_k)
    cleaned = _flag_and_null(unique, c, bounds)
    imputer = impute.fit_imputer(cleaned, c.impute, known=known | middles)
    filled = _impute(cleaned, c, imputer)

    changed = {*c.target_encode_columns, *c.one_hot_columns, *c.ordinal}
    early = lambda cols: [x for x in cols if x in filled.columns and x not in changed]
    observed = scale.scale_statistics(early(c.standardize_columns), early(c.min_max_columns))
    filled, stats = _written_observing(filled, "etl-filled", observed)
    targets = [
        encode.fit_target_encoding(filled, x, c.target_column)
        for x in c.target_encode_columns
        if c.target_column in filled.columns and x in filled.columns
    ]
    one_hot = encode.fit_one_hot(filled, [x for x in c.one_hot_columns if x in filled.columns])
    encoded = _encode(filled, c, targets, one_hot)
    present = lambda cols: [x for x in cols if x in encoded.columns]
    late = [[x for x in present(cols) if x in changed or x not in filled.columns] for cols in (c.standardize_columns, c.min_max_columns)]
    if any(late):
        stats |= encoded.agg(*scale.scale_statistics(*late)).first().asDict()
    group = None
    if present(c.group_scale_columns):
        group = scale.fit_group_standard(encoded, present(c.group_scale_columns), c.id_column)
    scalers = []
    if present(c.standardize_columns):
        scalers.append(scale.standard_scaler(stats, present(c.standardize_columns)))
    if present(c.min_max_columns):
        scalers.append(scale.min_max_scaler(stats, present(c.min_max_columns)))
    fitted = FittedEtl(c, bounds, imputer, targets, one_hot, group, scalers)
    return fitted, fitted.scaled(encoded)


def sequences(
    df: DataFrame,
    id_col: str,
    timestamp_col: str,
    feature_cols: Sequence[str],
    target_col: str,
    seq_length: int = 30,
    padding_value: float = 0.0,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Last ``seq_length`` rows per id in time order, left-padded; the label is the last target.

    Only the last rows of an id leave the map tasks, so the collected list is bounded.
    """
    order = [F.desc(timestamp_col), *[F.desc(c) for c in tiebreak]]
    recent = top_k_per_key(df.filter(F.col(id_col).isNotNull()), [id_col], order, seq_length, rank="_rank")
    step = F.array(*[F.col(c).cast("double") for c in feature_cols])
    grouped = recent.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_rank")).alias("o"), step.alias("x")))).alias("_steps"),
        F.max(F.when(F.col("_rank") == 1, F.col(target_col))).alias("label"),
        F.count("*").alias("n_steps"),
    )
    pad = F.array_repeat(F.array(*[F.lit(float(padding_value))] * len(feature_cols)), (seq_length - F.size("_steps")).cast("int"))
    values = F.transform("_steps", lambda s: s["x"])
    return grouped.select(id_col, F.concat(pad, values).alias("sequence"), F.col("n_steps"), "label")
