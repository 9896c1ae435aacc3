"""Times the headline queries once each, after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from emberfield.plans.registry import QUERIES
from emberfield.session import local_session

HEADLINE = (
    "exact_dedup", "brightness_filled", "delta_brightness", "historical_frequency", "co_confirmed",
    "coincident_merge", "landuse_pip", "distance_to_industrial", "category_nrt",
    "features_labeled", "feature_matrix", "label_noise", "stratified_split", "wildfire_alerts",
    "kpi_summary", "zone_top5", "daily_trend7", "classification_report", "whatif_scores",
    "stream_frequency",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    QUERIES["source_breakdown"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
