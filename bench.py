"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

import json
import os
import time

from itemscope.plans import queries
from itemscope.session import build_session

HEADLINE = ["model_performance", "paired_comparisons", "vote_fraction_summary",
            "flattened_metadata", "difficulty_decile_summary", "difficulty_validity_correlations",
            "binary_metrics", "residual_factor_subject", "feature_label_metrics",
            "coldstart_summary", "rasch_fit"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    took = {}
    for name in HEADLINE:
        queries.forget_runs()
        begun = time.perf_counter()
        queries.ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
