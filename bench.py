"""Time the headline plans; prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS:   local cores (default: all)
BENCH_PLANS:  comma-separated plan names, or ``all``
BENCH_RUNS:   timed runs per plan after one warm run (default 2; the median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from sluice.plans import PLANS
from sluice.semantics import pin_session

HEADLINE = (
    "where let flatten group_by group_on_reject agg_univalued agg_list agg_flatten agg_dict agg_partition_count pick_max"
    " pick_min join join_prefix left_join left_join_where intersection_join left_intersection_join wildcard_lookup_join"
    " asof_lookup asof_lookup_by_key window_membership equivalence_match near_collision_pairs name_order_lookup"
    " grouper_always_include grouper_combinations grouper_crosstab grouper_merge_sets grouper_barcodes greedy_bins"
    " emit_actions emit_alerts crosstab_counts histogram property_summary provenance_join incremental_merge"
    " l_sort l_subsample l_source_split fn_string_hash fn_path_normalize x_regex_bind string_set_source"
).split()


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    run(PLANS[name](spark, folder))
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_PLANS", "")
    names = list(PLANS) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sluice-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sluice-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    pin_session(spark)
    seconds = {}
    for name in names:
        try:
            timed(spark, name, folder)
            seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 4)
        except Exception as e:  # one failing plan must not hide the others
            print(f"{name}: {str(e)[:200]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
