"""The table of past runs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "timestamp timestamp, source_name string, target_name string, provider string, "
    "new long, changed long, unchanged long, deleted long, "
    "validation_passed boolean, exec_time double"
)


def append_run(
    spark: SparkSession, path: str, *, source_name: str | None, target_name: str | None,
    provider: str, counts: dict[str, int], validation_passed: bool, exec_time: float,
    timestamp: datetime.datetime | None = None,
) -> None:
    """Add one run to the table at ``path``."""
    row = (
        timestamp or datetime.datetime.now(), source_name or "—", target_name or "—", provider,
        counts["new"], counts["changed"], counts["unchanged"], counts["deleted"],
        validation_passed, round(exec_time, 2),
    )
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(path)


def history(runs: DataFrame) -> DataFrame:
    """Runs, newest first, numbered from the oldest.

    Runs are numbered within their day, after those of all earlier days, so that no
    task sorts more than the runs of one day.
    """
    dated = runs.withColumn("day", F.to_date("timestamp"))
    rest = [c for c in runs.columns if c != "timestamp"]
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # One row per day goes through this window.
    before = (
        dated.groupBy("day")
        .agg(F.count(F.lit(1)).alias("day_runs"))
        .select("day", F.coalesce(F.sum("day_runs").over(earlier), F.lit(0)).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("day").orderBy("timestamp", *rest))
    numbered = dated.withColumn("within", within).join(before, "day")
    return (
        numbered.select((F.col("before") + F.col("within")).alias("run"), *runs.columns)
        .orderBy(F.desc("run"))
    )
