"""Bench: the stages of the study and the headline queries at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line.  Stage times include writing the stage table; query times
include collecting the result.  ``records_per_sec`` compares with the published
throughput of per-curve evaluation (about 142 evaluations per second).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_method_ranking", "e12_full_roster", "f1_error_panel", "f5_pooled_table", "f16_recorded_strata", "g4_best_per_family",
    "h12_head_to_head", "i4_candidate_rules", "i5_selectors", "j6_selector_errors", "f14_selector_summary", "k3_diagnostic_correlation",
    "k7_rejection_rules", "k10_cluster_bootstrap", "l5_selection_cells", "l6_pooled_selection", "w1_cascade_by_mode", "d22_order_ladders")


def main() -> None:
    from tailcast.plans import study as ST
    from tailcast.plans.catalog import load
    from tailcast.session import local_session
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def clock(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    clock("stage_days", lambda: ST.days(spark, sf))
    clock("stage_curves", lambda: ST.curves(spark, sf))
    clock("stage_horizons", lambda: ST.horizons(spark, sf))
    recs = clock("stage_gap_records", lambda: ST.gap_records(spark, sf))
    clock("stage_step_records", lambda: ST.step_records(spark, sf))
    clock("stage_features", lambda: ST.cell_features(spark, sf))
    clock("stage_diagnostics", lambda: ST.diag_records(spark, sf))
    clock("stage_pooled", lambda: ST.pooled(spark, sf))
    queries = load()
    for name in HEADLINE:
        clock(name, lambda: queries[name](spark, sf).collect())
    n = recs.count()
    print(json.dumps({"metric": "study wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")), "records": n, "records_per_sec": round(n / times["stage_gap_records"], 1)}))


if __name__ == "__main__":
    main()
