"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.registry import jobs  # noqa: E402
from tidemark.session import session  # noqa: E402

HEADLINE = [
    "a1_activity_features", "a3_routine_consistency", "a4_social_metrics", "a5_sleep_features", "a8_hrv_from_rr", "a12_adherence_rate",
    "a15_missed_sessions", "a16_engagement_score", "a17_sentiment_rollup", "j1_feature_merge", "e11_e12_etl_fit_transform", "w2_keep_first_duplicate",
    "w3_z5_group_z_score", "w4_forward_fill_by_id", "v1_v1b_v1c_v1d_v1f_survey_validation", "v7_iqr_outliers", "f3_redact_text", "f12_batch_sentiment",
    "a24_numeric_summary", "d1_f20_quality_issues", "d3_pearson", "d7_ks_statistic", "d9_kl_divergence", "d11_version_drift", "q1_w10_auroc",
    "q6_group_rates", "m1_chronological_split", "m13_ensemble_score_rows", "m14_contributions", "m15_counterfactuals", "g5_case_states",
    "g8_k1_recommend", "g13_batch_screening", "a22_g14_queue_statistics", "a23_a21_audit_report", "a28_metric_window_summary",
    "x5_j9_j10_serve_latest", "x10_f19_compare_runs", "j4_traverse_lineage", "r1_rate_per_window",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = jobs()
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):  # the first run warms up and is not counted
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "sum of median warm query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus)}
        )
    )


if __name__ == "__main__":
    main()
