"""Synthetic snapshot and history pairs for timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPENED = "2026-06-01"
_BEFORE = "2026-01-01"


def make_pair(
    spark: SparkSession, n: int, kind: str = "split", change_pct: float = 0.1
) -> tuple[DataFrame, DataFrame]:
    """A snapshot and a history table over keys 1 to ``n``.

    ``split``: history holds the first 95% of the keys, the snapshot the last 95%; every
    tenth history key has a closed row; keys ending in 1 changed. ``percent``: all keys
    on both sides, the first ``change_pct`` of them changed, no closed rows.
    ``half_history``: all keys on both sides, even keys have a closed row, keys ending
    in 0 changed.
    """
    k = F.col("id")
    if kind == "split":
        key, first, last = "customer_id", int(n * 0.05) + 1, int(n * 0.95)
        changed = (k <= last) & (k % 10 == 1)
        closed = k % 10 == 1
    elif kind == "percent":
        key, first, last = "id", 1, n
        changed, closed = k <= int(n * change_pct), F.lit(False)
    elif kind == "half_history":
        key, first, last = "id", 1, n
        changed, closed = k % 10 == 0, k % 2 == 0
    else:
        raise ValueError(f"Unknown kind of pair: {kind}")

    def data(name: Column, city: Column) -> list[Column]:
        columns = [k.alias(key), F.concat(name, k.cast("string")).alias("name")]
        if kind == "split":
            columns.append(F.concat(city, k.cast("string")).alias("city"))
        return columns

    source = spark.range(first, n + 1).select(
        *data(F.when(changed, "NewName_").otherwise("Name_"), F.lit("City_"))
    )
    versions = F.when(closed, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    target = (
        spark.range(1, last + 1)
        .withColumn("is_current", F.explode(versions))
        .select(
            *data(
                F.when(F.col("is_current"), "Name_").otherwise("OldName_"),
                F.when(F.col("is_current"), "City_").otherwise("OldCity_"),
            ),
            F.when(F.col("is_current"), _OPENED).otherwise(_BEFORE).cast("date").alias("effective_from"),
            F.when(~F.col("is_current"), _OPENED).cast("date").alias("effective_to"),
            "is_current",
        )
    )
    return source, target
