"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores. Each query
runs once to warm up and is then timed as the median of three complete runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from freshet.plans.catalog import QUERIES
from freshet.session import local_session

HEADLINE = [
    "scan_prune_filter", "panel_build", "station_pivot", "discharge_features", "rain_lag_features",
    "lagged_forecast_w3_a3", "resample_w5", "robust_scale_panel", "sweep_scores", "quantile_threshold_best",
    "threshold_fit", "threshold_cv", "event_scores", "event_blocks_trimmed", "flood_count_folds", "sign_test",
    "neighbour_max", "nearest_cell_series", "zonal_stats", "basin_intersects", "upstream_closure",
    "interpolate_linear", "interpolate_spline", "wavelet_swt", "spectrum", "lr_district_cv", "svc_linear",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(os.cpu_count() or 4, 8)))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "sum of median seconds over headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
