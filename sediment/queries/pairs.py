"""Snapshot and history pairs made of the given tables, in Spark and as SQL text.

Each function returns (snapshot, history); the SQL of the same name defines the views
``src`` and ``tgt`` with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "2026-06-08"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _open_since(day: str):
    return [
        F.lit(day).cast("date").alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.lit(True).alias("is_current"),
    ]


def _closed(start: str, end: str):
    return [
        F.lit(start).cast("date").alias("effective_from"),
        F.lit(end).cast("date").alias("effective_to"),
        F.lit(False).alias("is_current"),
    ]


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers: 5% new, 10% changed, 5% deleted, 10% with a closed row, some padded."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    source = c.filter(k % 20 != 1).withColumn(
        "c_mktsegment",
        F.when(k % 10 == 2, F.concat(segment, F.lit(" X")))
        .when(k % 10 == 4, F.concat(F.lit(" "), segment, F.lit("  ")))
        .otherwise(segment),
    )
    current = c.filter(k % 20 != 0).select("*", *_open_since("2026-06-01"))
    closed = (
        c.filter(k % 10 == 3)
        .withColumn("c_name", F.concat(F.lit("Old "), "c_name"))
        .select("*", *_closed("2026-01-01", "2026-06-01"))
    )
    return source, current.unionByName(closed)


CUSTOMERS_SQL = """
src as (
  select c_custkey, c_name, c_nationkey,
    case when c_custkey % 10 = 2 then concat(c_mktsegment, ' X')
         when c_custkey % 10 = 4 then concat(' ', c_mktsegment, '  ')
         else c_mktsegment end as c_mktsegment
  from customer where c_custkey % 20 <> 1),
tgt as (
  select c_custkey, c_name, c_nationkey, c_mktsegment, date '2026-06-01' as effective_from,
    cast(null as date) as effective_to, true as is_current
  from customer where c_custkey % 20 <> 0
  union all
  select c_custkey, concat('Old ', c_name), c_nationkey, c_mktsegment, date '2026-01-01',
    date '2026-06-01', false
  from customer where c_custkey % 10 = 3)"""


DAYS = ("2026-06-08", "2026-06-09", "2026-06-10")


def daily(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """The snapshot of customers on one of ``DAYS``: others are missing and changed each day."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    segment = F.when(k % 10 == number, F.concat("c_mktsegment", F.lit(f" {number}"))).otherwise(F.col("c_mktsegment"))
    return c.filter(k % 20 != number).withColumn("c_mktsegment", segment)


def before_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of customers before ``DAYS``."""
    return customers(spark, sf_dir)[1].drop("c_nationkey")


def _day_sql(number: int) -> str:
    day, past = DAYS[number - 1], f"h{number - 1}"
    return f"""
s{number} as (
  select c_custkey, c_name, c_mktsegment || case when c_custkey % 10 = {number} then ' {number}' else '' end as c_mktsegment
  from customer where c_custkey % 20 <> {number}),
j{number} as (
  select t.*, s.c_custkey as sk, s.c_mktsegment as seg, coalesce(s.c_mktsegment <> t.c_mktsegment, true) as ends
  from {past} t left join s{number} s on s.c_custkey = t.c_custkey where t.is_current),
h{number} as (
  select * from {past} where not is_current
  union all
  select c_custkey, c_name, c_mktsegment, effective_from, case when ends then date '{day}' end, not ends from j{number}
  union all
  select s.c_custkey, s.c_name, s.c_mktsegment, date '{day}', null, true
  from s{number} s left join j{number} j on s.c_custkey = j.c_custkey where j.c_custkey is null or j.ends)"""


DAYS_SQL = f"""{CUSTOMERS_SQL},
h0 as (select c_custkey, c_name, c_mktsegment, effective_from, effective_to, is_current from tgt),""" + ",".join(
    _day_sql(n) for n in (1, 2, 3)
)


def order_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders counted per (customer, status): a key of two columns."""
    groups = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    k, status = F.col("o_custkey"), F.col("o_orderstatus")
    source = groups.filter(~((k % 20 == 1) & (status == "O")))
    altered = F.col("n_orders") + F.when((k % 10 == 2) & (status == "F"), 1).otherwise(0)
    current = (
        groups.filter(~((k % 20 == 0) & (status == "P")))
        .withColumn("n_orders", altered)
        .select("*", *_open_since("2026-06-01"))
    )
    closed = (
        groups.filter(k % 10 == 3)
        .withColumn("n_orders", F.lit(0).cast("long"))
        .select("*", *_closed("2026-01-01", "2026-06-01"))
    )
    return source, current.unionByName(closed)


ORDER_COUNTS_SQL = """
grp as (select o_custkey, o_orderstatus, count(*) as n_orders from orders group by all),
src as (select * from grp where not (o_custkey % 20 = 1 and o_orderstatus = 'O')),
tgt as (
  select o_custkey, o_orderstatus,
    n_orders + case when o_custkey % 10 = 2 and o_orderstatus = 'F' then 1 else 0 end as n_orders,
    date '2026-06-01' as effective_from, cast(null as date) as effective_to, true as is_current
  from grp where not (o_custkey % 20 = 0 and o_orderstatus = 'P')
  union all
  select o_custkey, o_orderstatus, 0, date '2026-01-01', date '2026-06-01', false
  from grp where o_custkey % 10 = 3)"""


def order_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders keyed by customer: most keys repeat on both sides; the order key says which is last."""
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"
    )
    k = F.col("o_custkey")
    current = o.filter((F.col("o_orderkey") % 3 == 0) & (k % 20 != 0))
    closed = o.filter(F.col("o_orderkey") % 10 == 3)
    target = current.select("*", *_open_since("2026-06-01")).unionByName(
        closed.select("*", *_closed("2026-01-01", "2026-06-01"))
    )
    return o.filter(k % 20 != 1), target


ORDER_LOG_SQL = """
src as (select o_custkey, o_orderkey, o_orderpriority, o_orderstatus from orders
        where o_custkey % 20 <> 1),
tgt as (
  select o_custkey, o_orderkey, o_orderpriority, o_orderstatus, date '2026-06-01' as effective_from,
    cast(null as date) as effective_to, true as is_current
  from orders where o_orderkey % 3 = 0 and o_custkey % 20 <> 0
  union all
  select o_custkey, o_orderkey, o_orderpriority, o_orderstatus, date '2026-01-01',
    date '2026-06-01', false
  from orders where o_orderkey % 10 = 3),
last_t as (
  select * from tgt where is_current
  qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1),
labelled as (
  select s.*, case when t.o_custkey is null then 'new'
    when s.o_orderpriority is distinct from t.o_orderpriority
      or s.o_orderstatus is distinct from t.o_orderstatus then 'changed'
    else 'unchanged' end as change_type
  from src s left join last_t t on s.o_custkey = t.o_custkey)"""


def hot_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The order log, with half of all orders under one customer."""
    source, target = order_log(spark, sf_dir)
    one = F.when(F.col("o_orderkey") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey"))
    return source.withColumn("o_custkey", one), target.withColumn("o_custkey", one)


HOT_LOG_SQL = ORDER_LOG_SQL.replace("src as (", "src0 as (").replace("tgt as (", "tgt0 as (").replace(
    "last_t as (",
    """src as (select * replace (case when o_orderkey % 2 = 0 then -1 else o_custkey end as o_custkey) from src0),
tgt as (select * replace (case when o_orderkey % 2 = 0 then -1 else o_custkey end as o_custkey) from tgt0),
last_t as (""",
)


def unknown_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders counted per (customer, status), where either part of the key may be null."""
    groups = (
        table(spark, sf_dir, "orders")
        .select(
            F.when(F.col("o_custkey") % 10 != 7, F.col("o_custkey")).alias("buyer"),
            F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        )
        .groupBy("buyer", "status")
        .agg(F.count(F.lit(1)).alias("n_orders"))
    )
    known = F.coalesce(F.col("buyer"), F.lit(2)) % 20
    source = groups.filter(known != 1)
    altered = F.col("n_orders") + F.when(known == 2, 1).otherwise(0)
    target = (
        groups.filter(known != 0)
        .withColumn("n_orders", altered)
        .select("*", *_open_since("2026-06-01"))
    )
    return source, target


UNKNOWN_KEYS_SQL = """
grp as (
  select case when o_custkey % 10 <> 7 then o_custkey end as buyer,
    nullif(o_orderstatus, 'P') as status, count(*) as n_orders
  from orders group by all),
src as (select * from grp where coalesce(buyer, 2) % 20 <> 1),
tgt as (
  select buyer, status,
    n_orders + case when coalesce(buyer, 2) % 20 = 2 then 1 else 0 end as n_orders,
    date '2026-06-01' as effective_from, cast(null as date) as effective_to, true as is_current
  from grp where coalesce(buyer, 2) % 20 <> 0)"""


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of customers with every kind of violation, by last digit of the key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    key = F.when(k % 10 != 7, k).alias("c_custkey")

    def version(start, end, current, where=None):
        rows = c if where is None else c.filter(where)
        return rows.select(
            key,
            "c_nationkey",
            F.lit(start).cast("date").alias("effective_from"),
            F.lit(end).cast("date").alias("effective_to"),
            F.lit(current).alias("is_current"),
        )

    parts = [
        version("2026-01-01", None, True),
        version("2025-06-01", "2026-03-01", False, k % 10 == 3),
        version("2026-01-01", None, True, k % 10 == 4),
        version("2025-08-01", "2025-07-01", False, k % 10 == 5),
        version("2025-06-01", "2026-01-01", False, k % 10 == 6),
        version(None, "2025-01-01", False, k % 10 == 8),
        version(None, "2025-01-01", False, k % 20 == 8),
        version("2026-01-01", "2026-02-01", True, k % 10 == 9),
    ]
    history = parts[0]
    for part in parts[1:]:
        history = history.unionByName(part)
    return history


def _broken_part(start, end, current, where):
    start = f"date '{start}'" if start else "cast(null as date)"
    end = f"date '{end}'" if end else "cast(null as date)"
    return f"""
  select case when c_custkey % 10 <> 7 then c_custkey end as c_custkey, c_nationkey,
    {start} as effective_from, {end} as effective_to, {current} as is_current
  from customer where {where}"""


BROKEN_SQL = "\nhistory as (" + " union all ".join(
    [
        _broken_part("2026-01-01", None, "true", "true"),
        _broken_part("2025-06-01", "2026-03-01", "false", "c_custkey % 10 = 3"),
        _broken_part("2026-01-01", None, "true", "c_custkey % 10 = 4"),
        _broken_part("2025-08-01", "2025-07-01", "false", "c_custkey % 10 = 5"),
        _broken_part("2025-06-01", "2026-01-01", "false", "c_custkey % 10 = 6"),
        _broken_part(None, "2025-01-01", "false", "c_custkey % 10 = 8"),
        _broken_part(None, "2025-01-01", "false", "c_custkey % 20 = 8"),
        _broken_part("2026-01-01", "2026-02-01", "true", "c_custkey % 10 = 9"),
    ]
) + ")"

# Every row of a table ``history`` with its next version, and the pairs that overlap.
NEIGHBOURS_SQL = """,
neighbours as (
  select *, lead(true) over w as has_next, lead(effective_from) over w as next_from,
    lead(effective_to) over w as next_to
  from history
  window w as (partition by {by} c_custkey
    order by effective_from asc nulls first, effective_to asc nulls last)),
overlapping as (
  select * from neighbours
  where has_next and (effective_to is null or next_from is null or effective_to > next_from))"""


def neighbours_sql(by: str = "") -> str:
    return NEIGHBOURS_SQL.replace("{by}", f"{by}," if by else "")
