"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs once to warm up and then $BENCH_RUNS times; its figure is the median. All rows are produced and dropped.
q5_mv makes the materialised view and reads it, q5_mv_read only reads it.
"""

import json
import os
import sys
import time
from statistics import median

from foliate.plans.queries import QUERIES
from foliate.session import local_session

HEADLINE = ["q1_fulltext", "q1_fingerprint", "q2_fuzzy_words", "q3_two_hop", "q4_entity_groups", "q5_daily_models", "q5_mv", "q5_mv_read", "q6_json_filter", "json_filter_native", "c1_substring", "profile_columns_lineitem", "reference_check_lineitem", "candidate_keys", "parse_dates", "ingest_accounting"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, int(cpus))
    took = {}
    views = {}

    def read_view(spark, folder):
        if folder not in views:
            views[folder] = QUERIES["q5_mv"](spark, folder)  # made by the warm-up
        return views[folder]

    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            (read_view if name == "q5_mv_read" else QUERIES[name])(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of the headline queries' median times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
