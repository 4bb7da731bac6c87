"""Time the headline queries on `$BENCH_SF_DIR` and print one JSON line.

Every query runs twice into a sink that discards the rows; `queries` has the second (warm) time, `cold` the first.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from vitrine.plans.queries import QUERIES

HEADLINE = [
    "catalog_with_primary_image", "catalog_full", "catalog_admin_page", "related_products", "orders_with_user",
    "order_products", "order_details", "items_decode", "banners_admin", "banners_client_products", "rating_upsert",
    "order_status_update", "add_product_images", "set_primary_image", "stream_rating_upsert", "order_admission",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: seconds(name) for name in HEADLINE}
    warm = {name: seconds(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
