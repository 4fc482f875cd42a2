"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from punctual.queries import QUERIES  # noqa: E402
from punctual.session import get_session  # noqa: E402

HEADLINE = [
    "text_normalized",
    "flights_cleaned",
    "loader_rows",
    "upsert_rows",
    "ontime_flights",
    "board_page_flights",
    "asof_view_before_purchase",
    "rotation_features",
    "trailing_user_value",
    "feature_frame",
    "price_quantiles",
    "rolling_folds",
    "regression_comparison",
    "classification_report",
    "gate_checks",
    "daily_performance",
    "lineitem_drift",
    "sliding_latency",
    "firing_alerts",
    "association_rules",
    "stream_daily_metrics",
]


def staged(spark, sf_dir: str, files: int) -> str:
    """Tables of one file each as tables of several, as a large table has: else one task reads all of it. Not timed."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            rows = spark.read.parquet(f"{sf_dir}/{name}")
            (rows.repartition(files) if os.path.getsize(f"{sf_dir}/{name}") > 100_000 else rows).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    size = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = staged(spark, sf_dir, int(cpus))
    spark.range(1000).groupBy().count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": size}))
    spark.stop()


if __name__ == "__main__":
    main()
