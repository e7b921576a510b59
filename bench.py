"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from helixlake.plans.catalogue import REGISTRY  # noqa: E402

NAMES = ["q_class_sharing", "q_strata_k21", "q_strata_long_k101", "q_small_query", "q_kmer_spectrum_k31", "q_subject_stats", "q_window_pyramid", "q_by_multiplicity", "q_census", "q_segments", "q_array_table", "q_base_composition"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["q_contig_index"](spark, d).write.format("noop").mode("overwrite").save()  # the first job starts the session
    took = {}
    for name in NAMES:
        t = time.time()
        REGISTRY[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
