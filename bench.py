"""Times the headline queries and prints one JSON line. BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS from the environment."""

import json
import os
import time
from statistics import median

from pricelattice.plans import catalog
from pricelattice.session import build_session

HEADLINE = [
    "markup_by_brand_year", "pricing_summary", "scan_pushdown_date_range", "five_way_join", "city_inequality", "olap_cube", "asof_last_signup", "asof_hot_keys",
    "event_study", "interval_join", "nearest_market", "scd2_intervals", "price_change_events", "moving_average", "keep_last_row", "upsert_new_wins", "wide_to_long",
    "lag_correlation", "asymmetric_pass_through", "session_window", "html_card_text", "backcast_prices",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            t = time.perf_counter()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rpartition("sf")[2], "spark": spark.version, "cores": spark.sparkContext.defaultParallelism}))
    spark.stop()


if __name__ == "__main__":
    main()
