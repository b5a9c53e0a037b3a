"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from demandloom.plans import QUERIES  # noqa: E402
from demandloom.session import local_session  # noqa: E402

HEADLINE = [
    "A1_monthly_facts", "J1_J2_A2_fact_ratios", "A18_monthly_trend", "A20_pivot_sum", "A22_facet_options", "A13_unit_price_outliers",
    "H1_W7_lifecycle_parts", "J5_monthly_full_outer", "W1_dense_series", "W2_anomalies", "FC6_damped_trend", "FC10_ets_additive",
    "FC13_FC14_model_selection", "FC18_FC19_risk_and_tier", "E2_outer_test", "E3_rolling_folds", "E1_FC27_portfolio_metrics",
    "FC28_hierarchical_model", "H4_plc_allocation", "H5_J10_part_plan", "E7_J11_J12_W5_allocation_accuracy_part", "E8_exceptions",
    "V1_J14_W12_actual_movers", "X1_ranked_context",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(app="demandloom-bench")
    spark.read.parquet(f"{path}/lineitem.parquet").count()          # start the workers before timing
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": path.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
