"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "treeline_shift", "regrid_any", "forest_edge", "welch_upper", "candidate_cascade", "otsu_threshold", "component_count", "mmu_sequence",
    "pyramid", "mosaic", "geometry_metrics", "rasterize", "compare_pairwise", "diagnosis", "resume_guard", "inventory_errors",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from ecotone import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda q: catalog.QUERIES[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("treeline_shift")  # starts Spark and compiles its readers
    took = {}
    for q in HEADLINE:
        began = time.time()
        run(q)
        took[q] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
