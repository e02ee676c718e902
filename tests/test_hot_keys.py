"""One key with half of all rows: its rows are spread over tasks, and results stay the same."""

import pytest
from conftest import DAY, rows
from pyspark.sql import functions as F

from sediment.operators.apply import apply_scd2
from sediment.operators.diff import compare
from sediment.plans.keyed import hot_slices, join_sliced, match

META = ["date'2026-01-01' effective_from", "cast(null as date) effective_to", "true is_current"]


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield 16
    for name in settings:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def skewed(spark, n, hot="7"):
    return spark.range(0, n, 1, 8).selectExpr(f"case when id % 2 = 0 then {hot} else id end as k", "id as n")


def test_hot_keys_are_found_with_slices_by_their_share(spark, partitions):
    left, right = skewed(spark, 40_000), spark.range(1000).withColumnRenamed("id", "k")
    found, none = hot_slices([left, right], ["k"])
    key = spark.range(7, 8).select(F.xxhash64(F.col("id"))).first()[0]
    assert list(found) == [key] and partitions // 2 <= found[key] <= partitions // 2 + 1 and none == {}
    assert hot_slices([left.limit(0), right.limit(0)], ["k"]) == [{}, {}]


def test_no_task_of_a_join_gets_the_hot_key_whole(spark, partitions):
    left = skewed(spark, 40_000)
    right = spark.range(0, 40_000, 3).selectExpr("id as k", "id * 2 as m").union(spark.sql("select 7L, 1L"))
    slices = hot_slices([left], ["k"])[0]
    joined = join_sliced(left, right, ["k"], slices)
    share = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    plain = left.join(right, ["k"], "left")
    before = plain.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert before > 20_000 and share < 9_000
    assert rows(joined) == rows(plain)
    whole = left.join(right, ["k"], "full_outer").select("k", "n", "m")
    assert rows(match(left, right, ["k"], slices).select("k", "n", "m")) == rows(whole)


def test_equal_rows_of_a_hot_key_are_split_too(spark, partitions):
    left = spark.range(0, 20_000, 1, 8).selectExpr("1L as k")
    joined = join_sliced(left, spark.sql("select 1L k, 2L m"), ["k"], hot_slices([left], ["k"])[0])
    shares = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 20_000 and max(shares) < 12_000
    assert joined.filter("m = 2").count() == 20_000


@pytest.mark.parametrize("hot", ["7", "cast(null as long)"])
def test_compare_and_apply_with_and_without_slices_agree(spark, partitions, hot):
    source = skewed(spark, 6_000, hot).selectExpr("k", "cast(n % 5 as string) as v", "n")
    target = skewed(spark, 5_000, hot).selectExpr("k", "cast(n % 7 as string) as v", "n", *META)

    def results():
        comparison = compare(
            source, target, ["k"], ["v"], unique=False, order_by=["n"], target_order_by=["n"]
        )
        changes = comparison.changes().select("k", "change_type").groupBy("k", "change_type").count()
        return comparison.hot, rows(changes), rows(apply_scd2(comparison, processing_date=DAY))

    hot_keys, changes, output = results()
    assert len(hot_keys) == 1
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # no key is larger than the only partition
    none, plain_changes, plain_output = results()
    assert none == {} and changes == plain_changes and output == plain_output
