"""Wall-clock of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (comma-separated names) choose what runs where.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nichelens.plans import QUERIES  # noqa: E402
from nichelens.plans.document_queries import forget_runs  # noqa: E402
from nichelens.session import build_session, clean_up  # noqa: E402

HEADLINE = (
    "latest_snapshot",
    "assembled_metrics",
    "niche_ranking",
    "compare_platforms",
    "enriched_profiles",
    "niche_benchmarks",
    "niche_dossier",
    "normalize_row",
    "channel_identity",
    "import_outcome",
    "read_export_csv",
    "extract_listing_links",
    "build_signature",
    "store_items",
    "cluster_assignment",
    "topic_score",
    "digest",
    "draft_table",
    "limit_check",
    "slot_filled",
    "slot_action",
    "next_cluster",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(
        "nichelens-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra={
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query loads the JVM's classes.
    QUERIES["platform_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in chosen:
        # No query may profit from clusters an earlier one left behind.
        forget_runs()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clean_up(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
