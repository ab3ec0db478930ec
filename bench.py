"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from terrachron.plans import catalogue

HEADLINE = ["fraction_trends", "transition_matrix", "change_events", "signature_stats", "archetypes", "rare_signatures", "confidence_tiers", "block_features", "hotspots", "product_agreement", "holdout_rates", "benchmark_rows", "flagship"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: catalogue.queries()[n] for n in HEADLINE}
    try:
        from terrachron.llm.queries import QUERIES

        queries |= {n: f for n, f in QUERIES.items() if n != "pipeline"}
    except ImportError:
        pass
    seconds = {}
    catalogue.engine(spark, sf_dir).trends.write.format("noop").mode("overwrite").save()  # the session's first job isn't timed
    for name, f in queries.items():
        began = time.time()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
