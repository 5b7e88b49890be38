"""Headline benchmark: prints one JSON line.

on local[$BENCH_CPUS]; each query is fully computed into Spark's no-op sink
(no collect), median of $BENCH_REPEATS runs (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kiln.plans import registry  # noqa: E402
from kiln.session import local_session  # noqa: E402

HEADLINE = {
    "profile_exact": "profile_columns_exact",        # A2 one-pass exact profile
    "profile_approx": "profile_columns_approx",      # A1 one-pass sketch profile
    "star_fact_orders": "fact_orders",               # B3/B4/J1
    "star_fact_lineitem": "fact_lineitem",           # B4 with three dimensions
    "mart_nation_segment": "mart_revenue_nation_segment",  # A11
    "sat_two_versions": "sat_customer_two_versions",  # B9/W5
    "sat_history": "sat_customer_priority",          # W5 over all orders
    "json_staged_parse": "responses_closed",         # JR1-JR3
    "design_consolidate": "relationships",           # U2/J3/U3 over the fleet
    "layer_assignment": "layer_assignment",          # J2 over the fleet
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="kiln-bench")
    qs = registry.queries()
    times = {}
    for label, name in HEADLINE.items():
        runs = []
        for _ in range(repeats):
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[label] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
