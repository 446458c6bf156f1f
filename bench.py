"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldrounds.plans import QUERIES  # noqa: E402
from fieldrounds.session import local_session  # noqa: E402

HEADLINE = (
    "cln7_same_day_merge", "cln11_closure_episodes", "wf6_trailing_year", "wf9_no_model_rules", "wf12_month_start_features",
    "wf13_snapshot_features", "j2_asof_backward", "j8_nearest_places", "j9_colocated_pairs", "ag6_usual_intervals", "wl1_monthly_worklist",
    "set2_list_backtest", "rk1_top_fraction_weights", "rk5_slot_reassign", "ml9_auc", "bs1_facility_interval", "bd3_band_table",
    "bd13_monitor_bands", "vw5_flags", "ag14_theme_counts", "rk12_items_shown")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["ag21_yearly_totals"](spark, sf_dir).collect()      # start the JVM before the clock
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
