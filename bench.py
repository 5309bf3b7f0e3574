"""Time the headline queries on one scale of the test data; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagewatch.plans.catalog import CATALOG  # noqa: E402
from pagewatch.session import build_session  # noqa: E402

HEADLINE = [
    "x01_node_parse", "x10_items", "x05_text_values", "x16_link_table", "f01_keyword_matches", "d01_item_hash", "d02_incremental_dedup",
    "w01_newest_per_job", "l01_keyset_page", "l02_page_envelope", "w02_price_drops", "w03_failure_streaks", "t03_circuit_breaker",
    "k02_counters", "n01_default_digest", "n03_webhook_payload", "q01_parameterised_sql", "w06_worker_lanes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cores}]", int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        # The waves of a frontier follow one another, so what counts is the time of one wave.
        began = time.perf_counter()
        waves = CATALOG["g01_frontier_waves"].run(spark, folder).agg(F.max("wave")).first()[0]
        took = time.perf_counter() - began
        seconds |= {"g01_frontier_waves": round(took, 3), "g01_seconds_per_wave": round(took / max(waves, 1), 3)}
    total = round(sum(v for k, v in seconds.items() if not k.endswith("per_wave")), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
