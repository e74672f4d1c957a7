"""Headline-query benchmark: runs a fixed set of registered jobs on
$BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS] and
prints one JSON line with per-query wall times (full execution into a
no-op sink, so nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sentiment_by_lang", "tfidf_features", "text_search", "knn_topk", "describe_numeric",
    "correlation_matrix", "topk_per_row_floor", "sequential_id", "threshold_alert",
    "crosstab_pivot", "rowwise_lookup_sum", "classification_report", "json_path_strict",
    "raster_gaussian_blur", "raster_hist_equalize", "raster_otsu", "graph_reachability",
    "box_neighbour_filter", "raster_edges",
]
WARMUP_DIR = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from quarry.plans.catalog import load_all
    from quarry.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus), app_name="quarry-bench",
                          extra={"spark.driver.memory": "16g"})
    reg = load_all()
    # JVM/JIT warm-up on the smoke tables (not timed): the first job of a
    # fresh JVM otherwise pays class loading and code generation.
    if os.path.isdir(WARMUP_DIR):
        reg["sentiment_by_lang"].job(spark, WARMUP_DIR).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for key in HEADLINE:
        if key not in reg:
            continue
        t0 = time.time()
        df = reg[key].job(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
