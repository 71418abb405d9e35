"""Schemas of the experiment tables."""

RUN_SCHEMAS = {
    "experiments": "experiment_id STRING, experiment_name STRING, description STRING, created_at TIMESTAMP_NTZ",
    "runs": "run_id STRING, experiment_id STRING, run_name STRING, status STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, changed_at TIMESTAMP_NTZ",
    "metrics": "run_id STRING, metric STRING, value DOUBLE, step INT, ts TIMESTAMP_NTZ",
    "params": "run_id STRING, params MAP<STRING, STRING>, ts TIMESTAMP_NTZ",
    "artifacts": "run_id STRING, path STRING, artifact_type STRING, size_bytes BIGINT, ts TIMESTAMP_NTZ",
}
