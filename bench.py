"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from plumbline.plans import queries

HEADLINE = ("basic_tier_columns", "column_completeness", "numeric_percentiles", "numeric_histogram", "top_values", "numeric_correlations", "duplicate_rows", "quality_checks", "drift_history", "fk_discover", "profile_lineitem", "percentiles_by_group", "kll_percentiles", "heavy_hitters", "exact_size_sample", "fk_discover_all", "incremental_profile")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every, took = queries.queries(), {}

    def run(name: str) -> float:
        began = time.time()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    cold = {n: run(n) for n in HEADLINE[:1]}  # the first query also starts Spark
    for name in HEADLINE:
        took[name] = run(name)
    warm = {n: run(n) for n in ("basic_tier_columns", "profile_lineitem")}
    print(json.dumps({"metric": "profiling_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "cold": cold, "warm": warm, "sf": sf}))


if __name__ == "__main__":
    main()
