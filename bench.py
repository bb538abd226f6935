"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose the run.
BENCH_ONLY takes a comma-separated list of query prefixes; ``all`` runs every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "a4_parse_market_file", "b8_solar_position", "b20_structure_payoffs", "c3_asof_last", "c5_interval_overlap", "c7_nearest", "d1_resample_day",
    "d5_median_anomaly", "d9_group_quantiles", "d10_cvar_count", "d13_skill_table", "d28_group_summary", "e1_rolling", "e5_avg_rank", "e12_event_paths",
    "e17_autocorr", "f1_corr_pearson", "f2_corr_spearman", "f4_kendall", "f6_distance_corr", "f8_pairwise_chi", "f13_effective_rank", "f19_hayashi_yoshida",
    "f22_shuffled_fleet_p5", "g1_ols", "g9_cluster_bootstrap", "g12_panel_fe", "g19_variogram", "g24_hedge_backtest", "g33_grid_scores", "h2_patch_stats",
    "h9_connected_components", "h13_cascade_reach", "h19_ring_contrast", "i7_run_checks", "k6_first_n_per_group",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from strandline.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_ONLY")
    names = HEADLINE
    if only:
        names = [n for n in QUERIES if only == "all" or any(n.startswith(p) for p in only.split(","))]
    spark = session()
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().write.format("noop").mode("overwrite").save()  # start the engine
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
