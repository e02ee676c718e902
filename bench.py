"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS the cores.
BENCH_PAIR_KEYS lists the key spaces of the generated pairs, whose detect and apply
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sediment.operators.apply import apply_scd2
from sediment.operators.diff import compare
from sediment.queries.catalog import QUERIES
from sediment.sources.generate import make_pair

HEADLINE = [
    "scd2_change_report",
    "scd2_change_summary",
    "scd2_field_changes",
    "scd2_apply",
    "scd2_apply_composite",
    "scd2_apply_duplicates",
    "scd2_null_keys",
    "scd2_validation_rules",
    "scd2_validate_overlaps",
    "scd2_confidence",
    "scd2_template_explanations",
    "scd2_batch_prompts",
    "scd2_response_merge",
    "scd2_usage",
    "scd2_changed_wide",
    "scd2_key_scores",
]
PAIR_COLUMNS = (["customer_id"], ["city", "name"])


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sediment-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites for error messages cost more than the rest of building a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def time_pair(spark: SparkSession, keys: int) -> dict[str, float]:
    """Detect and apply over a generated pair that is already in memory, as in the baseline.

    Detect includes the job that finds out whether keys repeat.
    """
    source, target = (side.persist() for side in make_pair(spark, keys))
    source.count(), target.count()
    found = {}

    def detect():
        found["comparison"] = compare(source, target, *PAIR_COLUMNS)
        drain(found["comparison"].changes())

    def apply():
        drain(apply_scd2(found["comparison"], processing_date="2026-06-08"))

    times = {f"pair_{keys}_detect": seconds(detect), f"pair_{keys}_apply": seconds(apply)}
    source.unpersist(), target.unpersist()
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sizes = [int(n) for n in os.environ.get("BENCH_PAIR_KEYS", "100000,1000000").split(",") if n]
    spark = session(cpus)
    times = {}
    for name in HEADLINE:
        drain(QUERIES[name](spark, sf_dir))  # compiles the plan; the second run is timed
        times[name] = seconds(lambda name=name: drain(QUERIES[name](spark, sf_dir)))
    if sizes:
        time_pair(spark, 1000)
    for keys in sizes:
        times.update(time_pair(spark, keys))
    times = {name: round(value, 3) for name, value in times.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
