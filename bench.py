"""Time the headline queries; prints one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import registry  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = (
    "lifecycle_transitions", "lifecycle_states", "run_health", "snapshots",
    "previous_snapshots", "field_diffs", "field_events", "all_events",
    "import_outcomes", "import_metrics", "dataset_overview", "property_page",
    "property_export", "visible_facts", "merge_candidates", "merged_listings",
    "deduped_discoveries", "discovery_metrics", "collection_outcomes", "market_checksums",
    "search_page_cards", "page_states", "document_hashes", "canonical_urls", "area_table",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    # One untimed query starts the JVM's code paths and the Python side.
    registry.QUERIES["run_health"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf[1]) if sf else folder,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
