"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from catalog import QUERIES
from seston.session import local_session

HEADLINE = [
    "survey_composition",
    "natural_left_join",
    "lookup_join_unique",
    "keyed_corrections",
    "treatment_period_label",
    "replicate_mean_all",
    "occupancy",
    "matrix_fill",
    "first_row_per_key",
    "five_numbers",
    "average_rank",
    "long_to_wide",
    "individuals_per_ml",
    "resolved_taxa",
    "nearest_names",
    "bray_curtis",
    "euclidean_distance",
    "permanova",
    "anosim",
    "correlation_pairwise",
    "masked_outliers",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
