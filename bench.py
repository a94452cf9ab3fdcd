"""Times the headline queries and prints one JSON line.

Each query runs once on the smallest tables first, unless BENCH_WARMUP=0.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vulnlake.plans import catalog  # noqa: E402
from vulnlake.session import get_session  # noqa: E402

HEADLINE = [
    "flagship_credentials_by_source", "r1_documents_scan", "r1_code_scan_all_rules", "r1_code_rule_matches", "r2_infra_scan_all_rules",
    "r3_secret_scan", "r9_rules_from_table", "r8_indicator_features", "w5_near_line_merge", "m5_combined_tools", "x8_advisory_hits",
    "x9_merge_tools", "a1_severity_counts", "a6_project_summary", "a11_framework_compliance", "a5_trend_year", "s11_scan_records",
    "s14_w2_sarif_rules", "s17_w8_flat_report", "l5_top_files", "w10_shuffled_split", "u3_distinct_texts", "a21_vocabulary", "z11_encoded",
    "a24_roc_auc", "a34_temperature", "a31_weighted_vote", "a28_line_risk", "w11_t2_request_rates", "w11_t3_admission", "g1_nodes", "g5_control_edges",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", "bench", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.sql.shuffle.partitions": cpus,
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm):  # the JVM compiles what it runs; time the queries, not that
        for name in names:
            catalog.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
