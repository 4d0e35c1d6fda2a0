"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Each query is
built and run to completion without keeping its rows; building counts, since some
operators run small jobs while they plan. The better of two runs is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from stepledger_queries import QUERIES  # noqa: E402

HEADLINE = [
    "pl1_step_flow",
    "pl1_flow_running_interest",
    "r2_property_compare",
    "r3_exact_multiset",
    "r4_value_diff",
    "r5_cell_diff",
    "a8_profile",
    "w1_running_total",
    "w3_by_flags",
    "w4_retain",
    "w5_remerge",
    "w6_lag_lead",
    "w7_row_index",
    "j1_left_join",
    "j3_match_merge",
    "j4_many_to_many",
    "j5_merge_flags",
    "j6_update",
    "j10_as_of_writer",
    "a4_slice_aggregate",
    "u1_stack",
    "u5_multiset_difference",
    "f13_statements",
    "l2_flatten",
    "l3_log_facts",
    "l6_provenance",
    "l7_steps",
    "l8_reads_writes",
    "l9_edges",
    "l10_layers",
    "pl2_stale_steps",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stepledger-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {n: round(min(seconds(spark, sf_dir, n) for _ in range(2)), 3) for n in names}
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
