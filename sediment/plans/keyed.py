"""Joining and reducing by business key, also when keys are null or repeated."""

from __future__ import annotations

import datetime
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = "__key_nulls"
_HASH, _SLICES, _SLICE = "__key_hash", "__key_slices", "__key_slice"


def _zero(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.DateType):
        return F.lit(datetime.date(1970, 1, 1))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(dtype)
    if isinstance(dtype, T.BinaryType):
        return F.lit(bytearray())
    return F.lit(0).cast(dtype)


def match_columns(key: list[str], null_keys: bool = True) -> list[str]:
    """Names of the columns that ``match_key`` makes."""
    return [f"__key_{i}" for i in range(len(key))] + [_MASK] * null_keys


def match_key(
    columns: list[Column], types: list[T.DataType], null_keys: bool = True
) -> list[Column]:
    """Key columns without nulls, plus a mask that says which ones were null.

    Where none are null (``null_keys=False``) the columns themselves are enough, and
    tables bucketed by them stay as they are.

    Two rows have the same key, null equal to null, exactly when all of these are
    equal. Joins, windows and aggregates on them therefore share one partitioning,
    which ``<=>`` would not give (it joins on expressions of its own).
    """
    if not null_keys:
        return [c.alias(f"__key_{i}") for i, c in enumerate(columns)]
    values = [
        F.coalesce(c, _zero(t)).alias(f"__key_{i}")
        for i, (c, t) in enumerate(zip(columns, types, strict=True))
    ]
    mask = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        mask = mask + F.when(c.isNull(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return [*values, mask.alias(_MASK)]


def key_counts(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))


def rows_per_key(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[int, int]:
    """The largest number of rows that one key has, on each side.

    One job over both sides shuffles an eight-byte hash per key. Equal hashes are only
    a suspicion; a side that has some is counted again by the keys themselves.
    """
    hashes = [
        side.select(F.lit(n).alias("side"), F.xxhash64(*on).alias("hash"))
        for n, side in enumerate((left, right))
    ]
    bounds = (
        hashes[0].unionByName(hashes[1])
        .groupBy("side", "hash")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("side")
        .agg(F.max("rows").alias("rows"))
        .collect()  # at most two rows
    )
    most = {row["side"]: row["rows"] for row in bounds}
    for n, side in enumerate((left, right)):
        if most.get(n, 0) > 1:
            most[n] = key_counts(side, on).agg(F.max("__rows")).first()[0]
    return most.get(0, 0), most.get(1, 0)


def last_per_key(df: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; rows that tie in ``order`` are told apart by their values.

    Spark drops all but one row per key before the shuffle as well as after it.
    """
    rest = [c for c in df.columns if c not in on and c not in order]
    newest_first = [F.col(f"`{c}`").desc() for c in [*order, *rest]]
    return (
        df.withColumn("__rn", F.row_number().over(Window.partitionBy(*on).orderBy(*newest_first)))
        .filter("__rn = 1")
        .drop("__rn")
    )


def hot_slices(sides: list[DataFrame], on: list[str]) -> list[dict[int, int]]:
    """Per side, the keys with more rows than an average shuffle partition.

    They are given as hash of the key and number of slices that makes its parts about as
    large as a partition. One job over the key columns finds them by a sketch of frequent
    items, which tasks merge; no key is shuffled. There are no more such keys than
    partitions, so the answer is small whatever the sides hold. A key that the sketch
    misses or takes by mistake costs time and changes no result.
    """
    partitions = int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(partitions, 10_000)
    hashed = [
        side.select(F.lit(n).alias("side"), F.xxhash64(*on).alias("hash"))
        for n, side in enumerate(sides)
    ]
    frequent = F.call_function("approx_top_k", "hash", F.lit(most), F.lit(max(1000, 16 * most)))
    found = (
        reduce(DataFrame.unionByName, hashed)
        .groupBy("side").agg(F.count(F.lit(1)).alias("rows"), frequent.alias("keys"))
        .collect()  # a row per side, an item per hot key
    )
    slices: list[dict[int, int]] = [{} for _ in sides]
    for row in found:
        share = max(row["rows"] / partitions, 1)
        slices[row["side"]] = {
            k["item"]: math.ceil(k["count"] / share) for k in row["keys"] if k["count"] > share
        }
    return slices


def join_sliced(
    left: DataFrame, right: DataFrame, on: list[str], slices: dict[int, int], how: str = "left"
) -> DataFrame:
    """An inner, left or semi join whose hot keys, given as ``slices``, are split over tasks.

    Rows of a hot key on the left are dealt to its slices; the rows it has on the right
    are copied to each of them. All other keys have one slice.
    """
    if not slices:
        return left.join(right, on, how)
    spark = left.sparkSession
    # A row per hot key, of which there are no more than shuffle partitions.
    table = F.broadcast(spark.createDataFrame(list(slices.items()), f"{_HASH} long, {_SLICES} int"))

    def numbered(df):
        number = F.coalesce(F.col(_SLICES), F.lit(1))
        return df.withColumn(_HASH, F.xxhash64(*on)).join(table, _HASH, "left").withColumn(_SLICES, number)

    values = [f"`{f.name}`" for f in left.schema if not isinstance(f.dataType, T.MapType)]
    # Equal rows of different input partitions part, and a task run again deals alike.
    turn = F.xxhash64(*values, F.spark_partition_id())
    dealt = numbered(left).withColumn(_SLICE, F.pmod(turn, F.col(_SLICES)).cast("int"))
    copied = numbered(right).withColumn(
        _SLICE, F.explode(F.sequence(F.lit(0), F.col(_SLICES) - 1))
    )
    working = [_HASH, _SLICES]
    return dealt.drop(*working).join(copied.drop(*working), [*on, _SLICE], how).drop(_SLICE)


def match(
    left: DataFrame, right: DataFrame, on: list[str], slices: dict[int, int] | None = None
) -> DataFrame:
    """What a full outer join gives, to a side with one row per key.

    Rows of ``left`` meet their partners in a left join, split where a key is hot
    (``slices``). Keys that only ``right`` has follow from an anti join with the distinct
    keys of ``left``, of which each task sends a hot one once.
    """
    alone = right.join(left.select(*on).distinct(), on, "left_anti")
    return join_sliced(left, right, on, slices or {}).unionByName(alone, allowMissingColumns=True)
