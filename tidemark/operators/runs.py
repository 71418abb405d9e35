"""Experiment tables: runs, metrics, parameters, comparison and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.ordered import latest_per_key
from tidemark.operators.tables_schema import RUN_SCHEMAS
from tidemark.sources.batches import append_batch, committed


def latest_runs(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Newest run of each experiment with the experiment's name."""
    last = latest_per_key(runs, ["experiment_id"], ["start_time", "run_id"])
    return last.join(experiments.select("experiment_id", "experiment_name"), "experiment_id")


def search_runs(runs: DataFrame, where: str | None = None, order_by: Sequence[str] = (), limit: int | None = None, status: str | None = None) -> DataFrame:
    """Runs by SQL condition and order (``"column [asc|desc]"``); newest first by default."""
    out = runs
    if status is not None:
        out = out.filter(F.col("status") == status)
    if where:
        out = out.filter(F.expr(where))
    keys = []
    for o in order_by or ["start_time desc", "run_id desc"]:
        name, _, way = o.partition(" ")
        keys.append(F.asc(name) if way.strip().lower() == "asc" or not way.strip() else F.desc(name))
    out = out.orderBy(*keys)
    return out.limit(limit) if limit is not None else out


def run_metrics(metrics: DataFrame, run_id=None, metric: str | None = None) -> DataFrame:
    out = metrics
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if metric is not None:
        out = out.filter(F.col("metric") == metric)
    return out.orderBy("run_id", "metric", F.asc_nulls_last("step"), "ts")


def shown_metric(step: str = "step", ts: str = "ts", value: str = "value") -> Column:
    """The value a comparison shows: of the last step, or the first logged one when no step is set."""
    stepped = F.max_by(value, F.when(F.col(step).isNotNull(), F.struct(step, ts)))
    return F.coalesce(stepped, F.min_by(value, F.struct(ts, value)))


def compare_runs(runs: DataFrame, metrics: DataFrame, metric_names: Sequence[str], param_names: Sequence[str] = ()) -> DataFrame:
    """One wide row per run: ``param_*`` from the parameter map and ``metric_*`` values."""
    asked = metrics.filter(F.col("metric").isin(*metric_names))
    pairs = asked.groupBy("run_id", "metric").agg(shown_metric().alias("_v"))
    wide = pairs.groupBy("run_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("_v"))).alias(f"metric_{m}") for m in metric_names])
    params = [F.col("params")[p].alias(f"param_{p}") for p in param_names]
    base = runs.select(*[c for c in runs.columns if c != "params"], *params)
    return base.join(wide, "run_id", "left")


def merged_params(changes: DataFrame) -> DataFrame:
    """Parameters per run after all updates: the last write of each name wins."""
    flat = changes.select("run_id", "ts", F.explode("params").alias("name", "value"))
    last = latest_per_key(flat, ["run_id", "name"], ["ts", "value"])
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("params"))


class RunLog:
    """Append-only experiment, run, metric, parameter and artifact tables below one path.

    Every append is a batch of its own that counts once it is committed; a call that names its
    batch can be made again. Many rows at once come as a table, by ``append_table``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.active: str | None = None

    def table(self, name: str) -> DataFrame:
        folders = committed(self.spark, f"{self.root}/{name}")
        if not folders:
            return self.spark.createDataFrame([], RUN_SCHEMAS[name])
        return self.spark.read.schema(RUN_SCHEMAS[name]).parquet(*folders)

    def append_table(self, name: str, rows: DataFrame, batch: str | None = None) -> bool:
        """Append a table with the columns of ``name``; false if the batch was there already."""
        columns = [f.name for f in T.StructType.fromDDL(RUN_SCHEMAS[name]).fields]
        return append_batch(rows.select(*columns), f"{self.root}/{name}", lambda df, folder: df.write.mode("overwrite").parquet(folder), batch)

    def append(self, name: str, rows: list[dict], batch: str | None = None) -> bool:
        return self.append_table(name, self.spark.createDataFrame(rows, RUN_SCHEMAS[name]).coalesce(1), batch)

    def _experiments(self, name: str) -> list:
        return self.table("experiments").filter(F.col("experiment_name") == name).limit(1).collect()

    def create_experiment(self, name: str, now, description: str | None = None) -> str:
        if self._experiments(name):
            raise ValueError(f"experiment {name} exists")
        self.append("experiments", [{"experiment_id": f"exp-{name}", "experiment_name": name, "description": description, "created_at": now}])
        return f"exp-{name}"

    def start_run(self, experiment: str, run_id: str, now, run_name: str | None = None) -> str:
        if self.active is not None:
            raise RuntimeError(f"run {self.active} is active")
        found = self._experiments(experiment)
        experiment_id = found[0]["experiment_id"] if found else self.create_experiment(experiment, now)
        self.append("runs", [{"run_id": run_id, "experiment_id": experiment_id, "run_name": run_name, "status": "RUNNING", "start_time": now, "end_time": None, "changed_at": now}])
        self.active = run_id
        return run_id

    def log_metrics(self, values: dict[str, float], now, step: int | None = None) -> None:
        self.append("metrics", [{"run_id": self._run(), "metric": k, "value": float(v), "step": step, "ts": now} for k, v in values.items()])

    def log_params(self, values: dict[str, object], now) -> None:
        self.append("params", [{"run_id": self._run(), "params": {k: str(v) for k, v in values.items()}, "ts": now}])

    def log_artifact(self, path: str, now, kind: str = "file") -> int:
        size = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
        self.append("artifacts", [{"run_id": self._run(), "path": path, "artifact_type": kind, "size_bytes": size, "ts": now}])
        return size

    def end_run(self, now, status: str = "FINISHED") -> None:
        run_id = self._run()
        last = self.runs().filter(F.col("run_id") == run_id).first().asDict()
        self.append("runs", [{**last, "status": status, "end_time": now, "changed_at": now}])
        self.active = None

    def runs(self) -> DataFrame:
        """Current state: the latest row of each run."""
        return latest_per_key(self.table("runs"), ["run_id"], ["changed_at", "status"], oldest=False)

    def _run(self) -> str:
        if self.active is None:
            raise RuntimeError("no active run")
        return self.active
