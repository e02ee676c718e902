"""The registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions.text import key_label
from sediment.operators import explain, metrics, validate, views
from sediment.operators.apply import apply_scd2
from sediment.operators.diff import (
    compare,
    current_rows,
    detect_changes,
    exploded_fields,
    summary,
)
from sediment.plans.keyed import last_per_key
from sediment.plans.materialize import working_folder
from sediment.queries import pairs
from sediment.queries.pairs import DAY
from sediment.sources import audit, ingest, schema, sinks, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEY = ["c_custkey"]


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# The joined pair of customers, one row per key, as every SQL below starts with it.
CUSTOMERS = f"""with {pairs.CUSTOMERS_SQL},
j as (
  select s.c_custkey as sk, t.c_custkey as tk, coalesce(s.c_custkey, t.c_custkey) as c_custkey,
    s.c_name as s_name, s.c_nationkey as s_nation, s.c_mktsegment as s_seg,
    t.c_name as t_name, t.c_nationkey as t_nation, t.c_mktsegment as t_seg,
    t.effective_from as t_from
  from src s full outer join (select * from tgt where is_current) t on s.c_custkey = t.c_custkey),
d as (
  select *,
    nullif(trim(s_seg), '') is distinct from nullif(trim(t_seg), '') as seg_differs,
    nullif(trim(s_name), '') is distinct from nullif(trim(t_name), '') as name_differs,
    s_nation is distinct from t_nation as nation_differs
  from j),
ch as (
  select *, case when tk is null then 'new' when sk is null then 'deleted'
    when seg_differs or name_differs or nation_differs then 'changed' else 'unchanged' end as change_type
  from d)"""

TEMPLATE_SQL = """
  case change_type
    when 'new' then 'New record added for c_custkey=' || c_custkey || '.'
    when 'changed' then 'Record c_custkey=' || c_custkey || ' was updated: c_mktsegment changed from '''
      || t_seg || ''' to ''' || s_seg
      || '''. The previous version was closed and a new current record was created.'
    when 'deleted' then 'Record c_custkey=' || c_custkey
      || ' is no longer present in the source. The current record was closed (soft delete).'
    end"""

OUTPUT = "c_custkey, c_mktsegment, c_name, c_nationkey, effective_from, effective_to, is_current"

# The four parts of the next history table; {deleted} says when a deleted key stays open.
APPLY_SQL = f"""
  select {OUTPUT} from tgt where not is_current
  union all
  select c_custkey, t_seg, t_name, t_nation, t_from,
    case when change_type in ({{closing}}) then date '{DAY}' end, change_type not in ({{closing}})
  from ch where change_type <> 'new'
  union all
  select c_custkey, s_seg, s_name, s_nation, date '{DAY}', null, true
  from ch where change_type in ('new', 'changed')"""
SOFT = "'changed', 'deleted'"
APPLIED = f"{CUSTOMERS}, out as ({APPLY_SQL.format(closing=SOFT)})"


def _customers(spark, sf_dir, **options):
    source, target = pairs.customers(spark, sf_dir)
    return compare(source, target, KEY, unique=True, **options)


def _changes(spark, sf_dir):
    return _customers(spark, sf_dir).changes()


def _applied(spark, sf_dir, **options):
    return apply_scd2(_customers(spark, sf_dir), processing_date=DAY, **options)


# ---- Change detection


@query(
    "scd2_change_report",
    f"{CUSTOMERS} select c_custkey, change_type, case when change_type = 'changed' then "
    "seg_differs::int + name_differs::int + nation_differs::int else 0 end as n_fields from ch",
)
def change_report(spark, sf_dir):
    return _changes(spark, sf_dir).select(
        "c_custkey", "change_type", F.size("field_changes").alias("n_fields")
    )


SUMMARY_SQL = """
  count(*) filter (change_type = 'new') as new, count(*) filter (change_type = 'changed') as changed,
  count(*) filter (change_type = 'unchanged') as unchanged,
  count(*) filter (change_type = 'deleted') as deleted, count(*) as total"""


@query("scd2_change_summary", f"{CUSTOMERS} select {SUMMARY_SQL} from ch")
def change_summary(spark, sf_dir):
    return summary(_changes(spark, sf_dir))


@query(
    "scd2_field_changes",
    f"""{CUSTOMERS}
select c_custkey, 'c_mktsegment' as "column", t_seg as old_value, s_seg as new_value
from ch where change_type = 'changed' and seg_differs
union all
select c_custkey, 'c_name', t_name, s_name from ch where change_type = 'changed' and name_differs
union all
select c_custkey, 'c_nationkey', cast(t_nation as varchar), cast(s_nation as varchar)
from ch where change_type = 'changed' and nation_differs""",
)
def field_changes(spark, sf_dir):
    return exploded_fields(_customers(spark, sf_dir).changes("changed"), KEY)


@query(
    "scd2_new",
    f"with {pairs.CUSTOMERS_SQL} select c_custkey from src s where not exists "
    "(select 1 from tgt t where t.is_current and t.c_custkey = s.c_custkey)",
)
def new_keys(spark, sf_dir):
    return views.new_keys(_customers(spark, sf_dir))


@query(
    "scd2_deleted",
    f"with {pairs.CUSTOMERS_SQL} select c_custkey from tgt t where t.is_current and not exists "
    "(select 1 from src s where t.c_custkey = s.c_custkey)",
)
def deleted_keys(spark, sf_dir):
    return views.deleted_keys(_customers(spark, sf_dir))


# Text in the snapshot, numbers in the history; every tenth number is another one.
DRIFT_SQL = f"""with {pairs.CUSTOMERS_SQL},
s as (select c_custkey, ' ' || c_nationkey || ' ' as nation from src),
t as (select c_custkey, c_nationkey + case when c_custkey % 10 = 6 then 1 else 0 end as nation,
    effective_from, effective_to, is_current from tgt),
ch as (
  select coalesce(s.c_custkey, t.c_custkey) as c_custkey, s.nation as s_nation,
    cast(t.nation as varchar) as t_nation, t.effective_from as t_from,
    case when t.c_custkey is null then 'new' when s.c_custkey is null then 'deleted'
      when trim(s.nation) <> cast(t.nation as varchar) then 'changed' else 'unchanged' end as change_type
  from s full outer join (select * from t where is_current) t on s.c_custkey = t.c_custkey)"""


def _drifting(spark, sf_dir):
    source, target = pairs.customers(spark, sf_dir)
    text = F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" "))
    source = source.select("c_custkey", text.alias("c_nationkey"))
    drift = F.when(F.col("c_custkey") % 10 == 6, 1).otherwise(0)
    return source, target.withColumn("c_nationkey", F.col("c_nationkey") + drift)


@query("scd2_type_drift", f"{DRIFT_SQL} select c_custkey, change_type from ch")
def type_drift(spark, sf_dir):
    """Text in the snapshot against numbers in the history: equal if they print alike."""
    changes = detect_changes(*_drifting(spark, sf_dir), KEY, ["c_nationkey"], unique=True)
    return changes.select("c_custkey", "change_type")


@query(
    "scd2_type_drift_apply",
    f"""{DRIFT_SQL}
select c_custkey, cast(nation as varchar) as c_nationkey, effective_from, effective_to, is_current,
  null as again from t where not is_current
union all
select c_custkey, t_nation, t_from, case when change_type in ('changed', 'deleted') then date '{DAY}' end,
  change_type = 'unchanged', case when change_type = 'unchanged' then 'unchanged' end
from ch where change_type <> 'new'
union all
select c_custkey, s_nation, date '{DAY}', null, true, 'unchanged' from ch where change_type in ('new', 'changed')""",
)
def type_drift_applied(spark, sf_dir):
    """The column becomes text, which holds both; a second run (``again``) finds no change."""
    source, target = _drifting(spark, sf_dir)
    output = apply_scd2(source, target, KEY, ["c_nationkey"], DAY, unique=True)
    again = detect_changes(source, output, KEY, ["c_nationkey"], unique=True)
    second = again.select("c_custkey", F.col("change_type").alias("again"), F.lit(True).alias("is_current"))
    return output.join(second, ["c_custkey", "is_current"], "left").select(*output.columns, "again")


@query(
    "scd2_change_report_duplicates",
    f"""with {pairs.ORDER_LOG_SQL}
select o_custkey, change_type, count(*) as records from labelled group by all
union all
select o_custkey, 'deleted', 1 from last_t t
where not exists (select 1 from src s where s.o_custkey = t.o_custkey)""",
)
def change_report_duplicates(spark, sf_dir):
    """One record per snapshot row, counted per key and type."""
    changes = _order_log(spark, sf_dir).changes()
    return changes.groupBy("o_custkey", "change_type").agg(F.count(F.lit(1)).alias("records"))


def _order_log(spark, sf_dir, log=pairs.order_log):
    source, target = log(spark, sf_dir)
    return compare(
        source, target, ["o_custkey"], ["o_orderpriority", "o_orderstatus"], unique=False,
        order_by=["o_orderkey"], target_order_by=["o_orderkey"],
    )


# ---- Apply


@query("scd2_apply", f"{APPLIED} select * from out")
def applied(spark, sf_dir):
    return _applied(spark, sf_dir)


@query(
    "scd2_apply_ignore_deletes",
    "{}, out as ({}) select * from out".format(CUSTOMERS, APPLY_SQL.format(closing="'changed'")),
)
def applied_ignore(spark, sf_dir):
    return _applied(spark, sf_dir, delete_policy="ignore")


@query(
    "scd2_apply_keep_columns",
    f"""with {pairs.CUSTOMERS_SQL},
ch as (
  select t.*, s.c_custkey as sk, s.c_mktsegment as s_seg,
    nullif(trim(s.c_mktsegment), '') is distinct from nullif(trim(t.c_mktsegment), '') as differs
  from tgt t left join src s on s.c_custkey = t.c_custkey where t.is_current)
select {OUTPUT} from tgt where not is_current
union all
select c_custkey, c_mktsegment, c_name, c_nationkey, effective_from,
  case when differs or sk is null then date '{DAY}' end, not (differs or sk is null) from ch
union all
select c_custkey, s_seg, null, null, date '{DAY}', null, true from ch where differs and sk is not null
union all
select c_custkey, c_mktsegment, null, null, date '{DAY}', null, true from src s
where not exists (select 1 from ch where ch.c_custkey = s.c_custkey)""",
)
def applied_keep(spark, sf_dir):
    """A snapshot that lost two columns; the history keeps them."""
    source, target = pairs.customers(spark, sf_dir)
    return apply_scd2(
        source.select("c_custkey", "c_mktsegment"), target, KEY, processing_date=DAY,
        unique=True, removed_columns="keep",
    ).select(*OUTPUT.split(", "))


@query(
    "scd2_apply_removed_column",
    f"""with {pairs.CUSTOMERS_SQL},
ch as (
  select t.*, s.c_custkey as sk, s.c_mktsegment as s_seg,
    nullif(trim(s.c_mktsegment), '') is distinct from nullif(trim(t.c_mktsegment), '') as differs
  from tgt t left join src s on s.c_custkey = t.c_custkey where t.is_current)
select c_custkey, c_mktsegment, effective_from, effective_to, is_current from tgt where not is_current
union all
select c_custkey, c_mktsegment, effective_from,
  case when differs or sk is null then date '{DAY}' end, not (differs or sk is null) from ch
union all
select c_custkey, s_seg, date '{DAY}', null, true from ch where differs and sk is not null
union all
select c_custkey, c_mktsegment, date '{DAY}', null, true from src s
where not exists (select 1 from ch where ch.c_custkey = s.c_custkey)""",
)
def applied_removed_column(spark, sf_dir):
    """A snapshot that lost two columns: they and their history leave the table."""
    source, target = pairs.customers(spark, sf_dir)
    return apply_scd2(
        source.select("c_custkey", "c_mktsegment"), target, KEY, processing_date=DAY, unique=True
    )


@query(
    "scd2_store_days",
    f"with {pairs.DAYS_SQL} select c_custkey, c_mktsegment, c_name, effective_from, effective_to, is_current from h3",
)
def store_days(spark, sf_dir):
    """Three daily runs that write the difference, the second with a wrong snapshot first."""
    folder = f"{working_folder(spark).rstrip('/')}/sediment-{uuid.uuid4().hex}"
    history = store.HistoryStore(spark, folder, KEY)
    days = [datetime.date.fromisoformat(d) for d in pairs.DAYS]
    history.start(pairs.before_days(spark, sf_dir), datetime.date(2026, 6, 7))
    for number, day in ((1, days[0]), (3, days[1]), (2, days[1]), (3, days[2])):
        history.run(pairs.daily(spark, sf_dir, number), day, unique=True)
    return history.read()


@query(
    "scd2_apply_null_flags",
    f"{CUSTOMERS.replace('tgt as (', 'tgt0 as (', 1)}, out as ({APPLY_SQL.format(closing=SOFT)}) select * from out".replace(
        "j as (",
        "tgt as (select * replace (case when c_custkey % 7 <> 5 then is_current end as is_current) from tgt0),\nj as (", 1,
    ),
)
def applied_null_flags(spark, sf_dir):
    """Rows whose flag is null are neither current nor closed: they leave the table."""
    source, target = pairs.customers(spark, sf_dir)
    target = target.withColumn("is_current", F.when(F.col("c_custkey") % 7 != 5, F.col("is_current")))
    return apply_scd2(source, target, KEY, processing_date=DAY, unique=True)


@query(
    "scd2_last_current_rows",
    f"with {pairs.ORDER_LOG_SQL} select o_custkey, o_orderkey, o_orderpriority, o_orderstatus from last_t",
)
def last_current_rows(spark, sf_dir):
    """The last current row of each key, which the snapshot is compared with."""
    _, target = pairs.order_log(spark, sf_dir)
    current = current_rows(target).select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"
    )
    return last_per_key(current, ["o_custkey"], ["o_orderkey"])


GROUPS_SQL = """
ch as (
  select coalesce(s.{a}, t.{a}) as {a}, coalesce(s.{b}, t.{b}) as {b}, s.n_orders as s_n,
    t.n_orders as t_n, t.effective_from as t_from,
    case when t.n_orders is null then 'new' when s.n_orders is null then 'deleted'
      when s.n_orders <> t.n_orders then 'changed' else 'unchanged' end as change_type
  from src s full outer join (select * from tgt where is_current) t on {on})"""
GROUPS_APPLY_SQL = f"""
select {{a}}, {{b}}, n_orders, effective_from, effective_to, is_current from tgt where not is_current
union all
select {{a}}, {{b}}, t_n, t_from, case when change_type in ({SOFT}) then date '{DAY}' end,
  change_type not in ({SOFT}) from ch where change_type <> 'new'
union all
select {{a}}, {{b}}, s_n, date '{DAY}', null, true from ch where change_type in ('new', 'changed')"""
COMPOSITE = {
    "a": "o_custkey", "b": "o_orderstatus",
    "on": "s.o_custkey = t.o_custkey and s.o_orderstatus = t.o_orderstatus",
}
UNKNOWN = {
    "a": "buyer", "b": "status",
    # A condition on expressions, since a full outer join wants equalities.
    "on": "coalesce(s.buyer, -1) = coalesce(t.buyer, -1) "
    "and coalesce(s.status, '?') = coalesce(t.status, '?')",
}


@query(
    "scd2_apply_composite",
    f"with {pairs.ORDER_COUNTS_SQL}, {GROUPS_SQL.format(**COMPOSITE)} "
    f"{GROUPS_APPLY_SQL.format(**COMPOSITE)}",
)
def applied_composite(spark, sf_dir):
    source, target = pairs.order_counts(spark, sf_dir)
    key = ["o_custkey", "o_orderstatus"]
    return apply_scd2(source, target, key, processing_date=DAY, unique=True)


@query(
    "scd2_null_keys",
    f"with {pairs.UNKNOWN_KEYS_SQL}, {GROUPS_SQL.format(**UNKNOWN)} "
    f"{GROUPS_APPLY_SQL.format(**UNKNOWN)}",
)
def applied_null_keys(spark, sf_dir):
    source, target = pairs.unknown_keys(spark, sf_dir)
    return apply_scd2(source, target, ["buyer", "status"], processing_date=DAY, unique=True)


APPLY_LOG_SQL = f"""
flags as (select o_custkey, max(change_type = 'unchanged') as keep,
    max(change_type <> 'unchanged') as opens from labelled group by o_custkey),
last_s as (select * from src
  qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select o_custkey, o_orderpriority, o_orderstatus, effective_from, effective_to, is_current
from tgt where not is_current
union all
select t.o_custkey, o_orderpriority, o_orderstatus, effective_from,
  case when coalesce(keep, false) then effective_to else date '{DAY}' end, coalesce(keep, false)
from tgt t left join flags f on t.o_custkey = f.o_custkey where is_current
union all
select s.o_custkey, o_orderpriority, o_orderstatus, date '{DAY}', null, true
from last_s s join flags f on s.o_custkey = f.o_custkey where opens"""


@query("scd2_apply_duplicates", f"with {pairs.ORDER_LOG_SQL}, {APPLY_LOG_SQL}")
def applied_duplicates(spark, sf_dir):
    return apply_scd2(_order_log(spark, sf_dir), processing_date=DAY)


@query("scd2_apply_hot_key", f"with {pairs.HOT_LOG_SQL}, {APPLY_LOG_SQL}")
def applied_hot_key(spark, sf_dir):
    """Half of all rows have one key; they are split over tasks in both joins."""
    return apply_scd2(_order_log(spark, sf_dir, pairs.hot_log), processing_date=DAY)


@query(
    "scd2_output_keys",
    f"""{APPLIED},
expected as (select c_custkey from src union select c_custkey from tgt where is_current),
found as (select distinct c_custkey from out where effective_from >= date '2026-06-01')
select (select count(*) from expected) as expected_keys, (select count(*) from found) as found_keys,
  (select count(*) from (select * from expected except select * from found)) as missing_keys,
  (select count(*) from (select * from found except select * from expected)) as surplus_keys""",
)
def output_keys(spark, sf_dir):
    """The keys of the output are those of the snapshot and of the open rows, no others."""
    source, target = pairs.customers(spark, sf_dir)
    output = apply_scd2(source, target, KEY, processing_date=DAY, unique=True)

    def flagged(df, expected):
        flags = [F.lit(expected).alias("expected"), F.lit(not expected).alias("found")]
        return df.select("c_custkey", *flags)

    sides = [
        flagged(source, True),
        flagged(target.filter("is_current"), True),
        flagged(output.filter("effective_from >= date '2026-06-01'"), False),
    ]
    per_key = (
        sides[0].unionByName(sides[1]).unionByName(sides[2])
        .groupBy("c_custkey")
        .agg(F.max("expected").alias("expected"), F.max("found").alias("found"))
    )
    return per_key.agg(
        F.count_if("expected").alias("expected_keys"),
        F.count_if("found").alias("found_keys"),
        F.count_if(F.col("expected") & ~F.col("found")).alias("missing_keys"),
        F.count_if(F.col("found") & ~F.col("expected")).alias("surplus_keys"),
    )


@query("scd2_current", f"{APPLIED} select * from out where is_current")
def current_view(spark, sf_dir):
    return views.by_status(_applied(spark, sf_dir), views.CURRENT_ONLY, sort="c_custkey")


@query("scd2_historical", f"{APPLIED} select * from out where not is_current")
def historical_view(spark, sf_dir):
    return views.by_status(_applied(spark, sf_dir), views.HISTORICAL_ONLY, sort="effective_from")


# ---- Validation


BROKEN = f"with {pairs.BROKEN_SQL}{pairs.neighbours_sql()}"
BROKEN_BY = f"with {pairs.BROKEN_SQL}{pairs.neighbours_sql('c_nationkey')}"


@query(
    "scd2_validate_schema",
    "select rule_no, rule, status, message, violation_count from (values "
    "(1, 'schema_completeness', 'fail', 'Missing required SCD2 columns: [''effective_to'', ''is_current'']', 2::bigint),"
    "(2, 'one_current_per_key', 'fail', 'Column ''is_current'' missing.', 0),"
    "(4, 'no_overlapping_dates', 'warn', 'Required date columns missing. Skipping overlap check.', 0),"
    "(5, 'date_consistency', 'warn', 'Date columns missing, cannot validate consistency.', 0)"
    ") t(rule_no, rule, status, message, violation_count) union all "
    f"(with {pairs.BROKEN_SQL} select 3, 'no_null_keys', case when n > 0 then 'fail' else 'pass' end, "
    "case when n > 0 then n || ' row(s) have null business key values.' "
    "else 'No null business keys found.' end, n "
    "from (select count(*) filter (c_custkey is null) as n from history))",
)
def validate_schema(spark, sf_dir):
    history = pairs.broken(spark, sf_dir).drop("effective_to", "is_current")
    return validate.validate_scd2(history, KEY).rules


@query(
    "scd2_validate_one_current",
    f"{BROKEN} select c_custkey, count(*) as current_rows, 'Key c_custkey=' || "
    "coalesce(cast(c_custkey as varchar), 'None') || ' has ' || count(*) || ' current rows' as detail "
    "from history where is_current group by c_custkey having count(*) > 1",
)
def validate_one_current(spark, sf_dir):
    return validate.repeated_current(pairs.broken(spark, sf_dir), KEY)


@query(
    "scd2_validate_null_keys",
    f"{BROKEN} select count(*) as null_rows, 'Row with null key found (row count: ' || count(*) || ')' "
    "as detail from history where c_custkey is null having count(*) > 0",
)
def validate_null_keys(spark, sf_dir):
    return validate.null_key_rows(pairs.broken(spark, sf_dir), KEY)


def _day(column):
    return f"coalesce(cast({column} as varchar), 'NULL')"


OVERLAP_TEXT_SQL = (
    "'Overlap detected for c_custkey=' || coalesce(cast(c_custkey as varchar), 'None') || chr(10) "
    f"|| 'Period A:' || chr(10) || {_day('effective_from')} || ' → ' || {_day('effective_to')} "
    f"|| chr(10) || chr(10) || 'Period B:' || chr(10) || {_day('next_from')} || ' → ' || {_day('next_to')}"
)


@query(
    "scd2_validate_overlaps",
    f"{BROKEN} select c_custkey, effective_from as from_a, effective_to as to_a, next_from as from_b, "
    f"next_to as to_b, count(*) as pairs, {OVERLAP_TEXT_SQL} as detail from overlapping "
    "group by c_custkey, effective_from, effective_to, next_from, next_to",
)
def validate_overlaps(spark, sf_dir):
    found = validate.overlaps(pairs.broken(spark, sf_dir), KEY)
    columns = [c for c in found.columns if c != "pairs"]
    return found.groupBy(*columns).agg(F.sum("pairs").alias("pairs"))


@query(
    "scd2_validate_dates",
    f"{BROKEN} select * from history where effective_to is not null and effective_from > effective_to",
)
def validate_dates(spark, sf_dir):
    return pairs.broken(spark, sf_dir).filter(validate.inverted())


# Counts per segment (or {seg} empty: as a whole) and the rule rows made of them.
RULE_COUNTS_SQL = """,
by_key as (select {seg} c_custkey, count(*) filter (is_current) as n from history group by {seg} c_custkey),
counts as (
  select {seg} count(*) filter (c_custkey is null) as null_rows,
    count(*) filter (effective_from > effective_to) as inverted,
    count(*) filter (is_current and effective_to is not null) as ended
  from history {group}),
repeated as (select {seg} count(*) filter (n > 1) as repeated from by_key {group}),
pairs as (
  select {seg}
    count(*) filter (has_next and (effective_to is null or next_from is null
      or effective_to > next_from)) as n_overlaps,
    count(*) filter (has_next and effective_to is not null
      and effective_to is distinct from next_from) as gaps
  from neighbours {group}),
figures as (select * from counts {join} repeated {using} {join} pairs {using}),
rules as (
  select {seg} 1 as rule_no, 'schema_completeness' as rule, 'pass' as status,
    'All required SCD2 columns present.' as message, 0::bigint as violation_count from figures
  union all
  select {seg} 2, 'one_current_per_key', case when repeated > 0 then 'fail' else 'pass' end,
    case when repeated > 0 then repeated || ' business key(s) have multiple current rows.'
      else 'Each business key has at most one current row.' end, repeated from figures
  union all
  select {seg} 3, 'no_null_keys', case when null_rows > 0 then 'fail' else 'pass' end,
    case when null_rows > 0 then null_rows || ' row(s) have null business key values.'
      else 'No null business keys found.' end, null_rows from figures
  union all
  select {seg} 4, 'no_overlapping_dates', case when n_overlaps > 0 then 'fail' else 'pass' end,
    case when n_overlaps > 0 then 'Overlapping date ranges detected.'
      else 'No overlapping validity periods detected.' end, n_overlaps from figures
  union all
  select {seg} 5, 'date_consistency', case when inverted > 0 then 'fail' else 'pass' end,
    case when inverted > 0 then inverted || ' row(s) have effective_from > effective_to.'
      else 'All date ranges are consistent (effective_from <= effective_to).' end, inverted from figures),
extra as (
  select {seg} 6 as rule_no, 'valid_current_records' as rule,
    case when ended > 0 then 'fail' else 'pass' end as status,
    case when ended > 0 then ended || ' current row(s) have an effective_to.'
      else 'All current rows are open.' end as message, ended as violation_count from figures
  union all
  select {seg} 7, 'no_history_gaps', case when gaps > 0 then 'fail' else 'pass' end,
    case when gaps > 0 then gaps || ' version(s) end on another day than the next one starts.'
      else 'Every version starts on the day the previous one ends.' end, gaps from figures)"""
WHOLE = {"seg": "", "group": "", "join": "cross join", "using": ""}
SEGMENT = {
    "seg": "c_nationkey,", "group": "group by c_nationkey", "join": "join",
    "using": "using (c_nationkey)",
}
RULES = f"{BROKEN}{RULE_COUNTS_SQL.format(**WHOLE)}"
RULES_BY = f"{BROKEN_BY}{RULE_COUNTS_SQL.format(**SEGMENT)}"


@query("scd2_validation_rules", f"{RULES} select * from rules union all select * from extra")
def validation_rules(spark, sf_dir):
    return validate.validate_scd2(pairs.broken(spark, sf_dir), KEY, extras=True).rules


@query("scd2_validation_rules_by_segment", f"{RULES_BY} select * from rules")
def validation_rules_by_segment(spark, sf_dir):
    return _rules_by_nation(spark, sf_dir)


def _rules_by_nation(spark, sf_dir):
    return validate.validate_scd2(pairs.broken(spark, sf_dir), KEY, by=["c_nationkey"]).rules


VERDICT_SQL = """
  count(*) filter (status = 'pass') as pass_count, count(*) filter (status = 'fail') as fail_count,
  count(*) filter (status = 'warn') as warn_count, count(*) as total_count,
  bool_and(status <> 'fail') as passed"""


@query(
    "scd2_validation_summary", f"{RULES_BY} select c_nationkey, {VERDICT_SQL} from rules group by 1"
)
def validation_summary(spark, sf_dir):
    return validate.rule_summary(_rules_by_nation(spark, sf_dir), ["c_nationkey"])


CONFIDENCE_SQL = f"""
verdicts as (select c_nationkey, {VERDICT_SQL} from rules group by 1),
scores as (
  select *, least(pass_count / total_count * 80 + case when c_nationkey % 2 = 0 then 20 else 10 end,
    100.0)::double as score from verdicts)
select c_nationkey, score, case when fail_count > 0 then 'Low' when score >= 90 then 'Very High'
  when score >= 75 then 'High' when warn_count > 0 or score >= 50 then 'Medium' else 'Low' end as label
from scores"""


@query("scd2_confidence", f"{RULES_BY}, {CONFIDENCE_SQL}")
def confidence(spark, sf_dir):
    provider = F.when(F.col("c_nationkey") % 2 == 0, "groq").otherwise("template")
    return metrics.confidence(_rules_by_nation(spark, sf_dir), provider, ["c_nationkey"])


def _sql_quoted(text):
    return "'" + text.replace("'", "''") + "'"


@query(
    "scd2_confidence_text",
    f"{RULES_BY}, labels as (with {CONFIDENCE_SQL.lstrip()}) select c_nationkey, score, label, "
    f"case when label = 'Low' then {_sql_quoted(metrics.SENTENCES[0])} "
    f"when label = 'Very High' then {_sql_quoted(metrics.SENTENCES[1])} "
    f"when label = 'High' then {_sql_quoted(metrics.SENTENCES[2])} "
    f"else {_sql_quoted(metrics.SENTENCES[3])} end as explanation from labels",
)
def confidence_text(spark, sf_dir):
    provider = F.when(F.col("c_nationkey") % 2 == 0, "groq").otherwise("template")
    return metrics.explained_confidence(_rules_by_nation(spark, sf_dir), provider, ["c_nationkey"])


OUTPUT_RULES_BY = f"""{APPLIED},
history as (select c_custkey, c_nationkey, effective_from, effective_to, is_current from out)
{pairs.neighbours_sql('c_nationkey')}{RULE_COUNTS_SQL.format(**SEGMENT)}"""


@query(
    "scd2_confidence_of_output",
    f"{OUTPUT_RULES_BY}, {CONFIDENCE_SQL}".replace("c_nationkey % 2 = 0", "false"),
)
def confidence_of_output(spark, sf_dir):
    """A correct history passes every rule in every segment."""
    output = _applied(spark, sf_dir)
    rules = validate.validate_scd2(output, KEY, by=["c_nationkey"]).rules
    return metrics.confidence(rules, by=["c_nationkey"])


@query(
    "scd2_validation_lines",
    f"""{RULES}
select rule_no, 0 as line_no, '[' || upper(status) || '] ' || rule || ': ' || message as value from rules
union all
select 2, 1, '  → Key c_custkey=' || coalesce(cast(c_custkey as varchar), 'None') || ' has ' || n
  || ' current rows' from by_key where n > 1
union all
select 3, 1, '  → Row with null key found (row count: ' || null_rows || ')' from counts where null_rows > 0
union all
select 4, 1, '  → ' || {OVERLAP_TEXT_SQL} from overlapping""",
)
def validation_lines(spark, sf_dir):
    return sinks.validation_lines(validate.validate_scd2(pairs.broken(spark, sf_dir), KEY))


@query(
    "scd2_gaps",
    f"""{BROKEN} select c_custkey, effective_from as from_a, effective_to as to_a, next_from as from_b,
  next_to as to_b, count(*) as pairs from neighbours
where has_next and effective_to is not null and effective_to is distinct from next_from
group by c_custkey, effective_from, effective_to, next_from, next_to""",
)
def gaps(spark, sf_dir):
    found = validate.gaps(pairs.broken(spark, sf_dir), KEY).drop("pairs", "detail")
    pairs_ = validate.gaps(pairs.broken(spark, sf_dir), KEY).drop("detail")
    return pairs_.groupBy(*found.columns).agg(F.sum("pairs").alias("pairs"))


@query(
    "scd2_point_in_time",
    f"{APPLIED} select * from out where effective_from <= date '2026-06-05' "
    "and (effective_to is null or date '2026-06-05' < effective_to)",
)
def point_in_time(spark, sf_dir):
    return views.as_of(_applied(spark, sf_dir), "2026-06-05")


# ---- Schema and ingestion


@query(
    "scd2_key_scores",
    f"""with {pairs.CUSTOMERS_SQL},
u as (select count(*) as n, count(distinct c_custkey) as k, count(distinct c_name) as nm,
  count(distinct c_nationkey) as na, count(distinct c_mktsegment) as s from src)
select 'c_custkey' as column_name, 30 + case when k = n then 10 else 0 end as score from u
union all select 'c_nationkey', 30 + case when na = n then 10 else 0 end from u
union all select 'c_name', case when nm = n then 10 else 0 end from u
union all select 'c_mktsegment', case when s = n then 10 else 0 end from u""",
)
def key_scores(spark, sf_dir):
    return schema.key_scores(*pairs.customers(spark, sf_dir))


@query(
    "scd2_detected_key",
    f"""with {pairs.CUSTOMERS_SQL},
u as (select count(*) as n, count(distinct c_custkey) as k, count(distinct c_name) as nm,
  count(distinct c_nationkey) as na, count(distinct c_mktsegment) as s from src),
grp as (select o_custkey, o_orderstatus, count(*) as n_orders from orders
  where not (o_custkey % 20 = 1 and o_orderstatus = 'O') group by all),
g as (select count(*) as n, count(distinct o_custkey) as k, count(distinct o_orderstatus) as s,
  count(distinct n_orders) as o from grp),
scores as (
  select 'customers' as pair, 'c_custkey' as column_name, 30 + case when k = n then 10 else 0 end as score from u
  union all select 'customers', 'c_nationkey', 30 + case when na = n then 10 else 0 end from u
  union all select 'customers', 'c_name', case when nm = n then 10 else 0 end from u
  union all select 'customers', 'c_mktsegment', case when s = n then 10 else 0 end from u
  union all select 'order_counts', 'o_custkey', 30 + case when k = n then 10 else 0 end from g
  union all select 'order_counts', 'o_orderstatus', case when s = n then 10 else 0 end from g
  union all select 'order_counts', 'n_orders', case when o = n then 10 else 0 end from g)
select pair, column_name from scores s where score = (select max(score) from scores m where m.pair = s.pair)""",
)
def detected_key(spark, sf_dir):
    """The business keys found in two pairs of tables."""
    found = [
        (name, column)
        for name, pair in (("customers", pairs.customers), ("order_counts", pairs.order_counts))
        for column in schema.detect_business_key(*pair(spark, sf_dir))
    ]
    return spark.createDataFrame(found, "pair string, column_name string")


@query(
    "scd2_normalize",
    r"""with t as (
  select c_custkey as k, chr(9) || ' ' || c_name || chr(160) || chr(8195) as name,
    case when c_custkey % 7 = 0 then '2026-13-01'
         else ' ' || strftime(date '2026-01-01' + (c_custkey % 300)::int, '%Y-%m-%d') || ' ' end as f,
    case c_custkey % 6 when 0 then 'TRUE' when 1 then '1' when 2 then ' Yes ' when 3 then 'no'
      when 4 then '  ' else null end as flag
  from customer)
select k as key, trim(name, chr(9) || ' ' || chr(160) || chr(8195)) as name,
  try_strptime(trim(f), '%Y-%m-%d')::date as effective_from,
  case when trim(flag) = '' then null else lower(trim(flag)) in ('true', '1', 'yes') end as is_current
from t""",
)
def normalize(spark, sf_dir):
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")).cast("string")
    flag = (
        F.when(k % 6 == 0, "TRUE").when(k % 6 == 1, "1").when(k % 6 == 2, " Yes ")
        .when(k % 6 == 3, "no").when(k % 6 == 4, "  ")
    )
    raw = pairs.table(spark, sf_dir, "customer").select(
        k.alias("  KEY"),
        F.concat(F.lit("\t "), "c_name", F.lit("  ")).alias("Name "),
        F.when(k % 7 == 0, "2026-13-01")
        .otherwise(F.concat(F.lit(" "), day, F.lit(" ")))
        .alias("Effective_From"),
        flag.alias("IS_CURRENT"),
    )
    return ingest.coerce_meta(ingest.strip_strings(ingest.normalize_names(raw)))


# ---- Explanations


@query(
    "scd2_template_explanations",
    f"{CUSTOMERS} select c_custkey, change_type, {TEMPLATE_SQL} as text, 'template' as provider "
    "from ch where change_type <> 'unchanged'",
)
def template_explanations(spark, sf_dir):
    return explain.template_explanations(_changes(spark, sf_dir), KEY)


@query(
    "scd2_explanations_by_type",
    f"{CUSTOMERS} select upper(change_type) as change_type, count(*) as explanations "
    "from ch where change_type <> 'unchanged' group by change_type",
)
def explanations_by_type(spark, sf_dir):
    return explain.by_type(explain.template_explanations(_changes(spark, sf_dir), KEY))


@query(
    "scd2_explanation_lines",
    f"{CUSTOMERS} select c_custkey, change_type, '[' || upper(change_type) || '] c_custkey=' || c_custkey "
    f"|| chr(10) || '  ' || {TEMPLATE_SQL} || chr(10) || '  Provider: template' || chr(10) as value "
    "from ch where change_type <> 'unchanged'",
)
def explanation_lines(spark, sf_dir):
    explanations = explain.template_explanations(_changes(spark, sf_dir), KEY)
    return sinks.explanation_lines(explanations, KEY)


@query(
    "scd2_explanation_order",
    f"""{CUSTOMERS}, numbered as (
  select *, row_number() over (order by (change_type = 'deleted')::int,
    case when change_type = 'deleted' then t_seg else s_seg end, c_custkey desc) - 1 as line_no
  from ch where change_type <> 'unchanged')
select line_no, c_custkey, change_type, '[' || upper(change_type) || '] c_custkey=' || c_custkey
  || chr(10) || '  ' || {TEMPLATE_SQL} || chr(10) || '  Provider: template' || chr(10) as value from numbered""",
)
def explanation_order(spark, sf_dir):
    """Lines numbered in the order of the snapshot, here by segment, deletions in the history's."""
    source, target = pairs.customers(spark, sf_dir)
    place = (-F.col("c_custkey")).alias("place")
    source, target = (side.select("*", place) for side in (source, target))
    changes = detect_changes(
        source, target, KEY, ["c_mktsegment", "c_name", "c_nationkey"], unique=True,
        order_by=["c_mktsegment", "place"], target_order_by=["c_mktsegment", "place"],
    )
    return sinks.numbered_lines(explain.template_explanations(changes, KEY), KEY)


FIELD_LINES_SQL = (
    "case when change_type = 'changed' then chr(10) || 'Field changes:' || chr(10) "
    "|| '  - c_mktsegment: ''' || t_seg || ''' → ''' || s_seg || '''' else '' end"
)


def _sql_text(text):
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


@query(
    "scd2_single_prompts",
    f"{CUSTOMERS} select {_sql_text(explain.ROLE + chr(10) + explain.ONE_RECORD_TASK + chr(10) + chr(10) + 'Record: c_custkey=')} "
    f"|| c_custkey || chr(10) || 'Change type: ' || change_type || {FIELD_LINES_SQL} || "
    f"{_sql_text(chr(10) + chr(10) + explain.ONE_RECORD_CLOSE)} as prompt from ch where change_type <> 'unchanged'",
)
def single_prompts(spark, sf_dir):
    return explain.single_prompts(_changes(spark, sf_dir), KEY).select("prompt")


# Buckets of a thousand keys: their number grows with the table, their size does not.
BATCHES = f"""{CUSTOMERS},
numbered as (
  select *, c_custkey // 1000 as bucket,
    row_number() over (partition by c_custkey // 1000 order by
      case change_type when 'new' then 0 when 'changed' then 1 else 2 end, c_custkey) - 1 as pos
  from ch where change_type <> 'unchanged'),
records as (
  select *, pos // 20 as batch, pos % 20 as record_id, {TEMPLATE_SQL} as template from numbered),
prompts as (
  select bucket, batch, count(*) as n,
    {_sql_text(chr(10).join([explain.ROLE, explain.BATCH_TASK, explain.NO_MARKDOWN, "", explain.BATCH_RECORDS, ""]))}
    || string_agg('--- Record ID: ' || record_id || ' ---' || chr(10) || 'Business key: c_custkey='
      || c_custkey || chr(10) || 'Change type: ' || change_type || {FIELD_LINES_SQL} || chr(10),
      chr(10) order by record_id)
    || {_sql_text(explain.REPLY_FORMAT)} as prompt,
    '{{"explanations":[' || coalesce(string_agg('{{"id":' || record_id || ',"explanation":"Reviewed '
      || c_custkey || '"}}', ',' order by record_id) filter (record_id % 3 <> 0), '') || ']}}' as reply
  from records group by bucket, batch),
responses as (
  select bucket, batch, n, prompt, case when batch % 4 <> 3 then reply end as response from prompts)"""


def _batches(spark, sf_dir):
    bucket = F.floor(F.col("c_custkey") / 1000)
    return explain.batch_prompts(_changes(spark, sf_dir), KEY, size=20, buckets=bucket, unique=True)


def _answered(spark, sf_dir):
    """Batches with replies that leave out every third record, and every fourth reply missing."""
    items = F.transform(
        F.filter("records", lambda r: r["record_id"] % 3 != 0),
        lambda r: F.struct(
            r["record_id"].alias("id"),
            F.concat(F.lit("Reviewed "), r["key"]["c_custkey"].cast("string")).alias("explanation"),
        ),
    )
    reply = F.to_json(F.struct(items.alias("explanations")))
    return _batches(spark, sf_dir).withColumn("response", F.when(F.col("batch") % 4 != 3, reply))


@query("scd2_batch_prompts", f"{BATCHES} select bucket, batch, n as records, prompt from prompts")
def batch_prompts(spark, sf_dir):
    return _batches(spark, sf_dir).select(
        "bucket", "batch", F.size("records").cast("long").alias("records"), "prompt"
    )


@query(
    "scd2_parse_responses",
    f"{BATCHES} select r.bucket, r.batch, r.record_id::int as record_id, 'Reviewed ' || r.c_custkey as explanation "
    "from records r where r.record_id % 3 <> 0 and r.batch % 4 <> 3",
)
def parse_responses(spark, sf_dir):
    items = explain.parse_responses(F.col("response"))
    return _answered(spark, sf_dir).select("bucket", "batch", F.inline(items)).withColumnRenamed(
        "id", "record_id"
    )


@query(
    "scd2_response_merge",
    f"{BATCHES} select c_custkey, change_type, "
    "case when record_id % 3 <> 0 and batch % 4 <> 3 then 'Reviewed ' || c_custkey else template end as text, "
    "case when record_id % 3 <> 0 and batch % 4 <> 3 then 'groq' else 'template' end as provider from records",
)
def response_merge(spark, sf_dir):
    return explain.merge(_answered(spark, sf_dir), KEY, "groq")


@query(
    "scd2_response_failed",
    f"{BATCHES} select c_custkey, change_type, template as text, "
    "'template' as provider, 'template' as provider_used, "
    "'⚠️ Gemini API failed: TimeoutError: no reply. Fell back to template.' as warning from records",
)
def response_failed(spark, sf_dir):
    """Every call fails: template texts, the template as provider, and a warning with the error."""
    answers = [F.lit(None).cast("string").alias("response"), F.lit("TimeoutError: no reply").alias("error")]
    failed = _batches(spark, sf_dir).select("*", *answers)
    label = "gemini (flash)"
    result = explain.Explained(explain.merge(failed, KEY, label), failed, "gemini", "flash", label=label)
    warning = F.lit(result.warnings.first()["warning"]).alias("warning")
    return result.explanations.select("*", F.lit(result.provider_used()).alias("provider_used"), warning)


@query(
    "scd2_response_join",
    f"{BATCHES} select c_custkey, change_type, "
    "case when record_id % 3 <> 0 and batch % 2 = 0 then 'Reviewed ' || c_custkey else template end as text, "
    "case when record_id % 3 <> 0 and batch % 2 = 0 then 'groq' else 'template' end as provider from records",
)
def response_join(spark, sf_dir):
    """Responses that come as a table of their own, with some batches missing in it."""
    answered = _answered(spark, sf_dir)
    responses = answered.filter("batch % 2 = 0").select("bucket", "batch", "response")
    return explain.merge(answered.drop("response"), KEY, "groq", responses)


@query(
    "scd2_explain_with_function",
    f"{BATCHES} select c_custkey, change_type, "
    "case when record_id % 3 <> 0 then 'Reviewed ' || c_custkey else template end as text, "
    "case when record_id % 3 <> 0 then 'custom' else 'template' end as provider from records",
)
def explain_with_function(spark, sf_dir):
    def review(prompt: str) -> str:
        """Stands for a remote model: answers all records of a prompt but every third."""
        lines = prompt.split("\n")
        ids = [int(x.split()[3]) for x in lines if x.startswith("--- Record ID: ")]
        keys = [x.split("=")[1] for x in lines if x.startswith("Business key: ")]
        found = [(i, k) for i, k in zip(ids, keys, strict=True) if i % 3]
        items = [{"id": i, "explanation": f"Reviewed {k}"} for i, k in found]
        return json.dumps({"explanations": items})

    return explain.merge(explain.with_callable(_batches(spark, sf_dir), review), KEY, "custom")


USAGE_SQL = """
per_batch as (
  select bucket, response is not null as ok, n,
    case when response is not null then greatest(1, length(prompt) // 4) else 0 end as p,
    case when response is not null then greatest(1, length(response) // 4) else 0 end as c
  from responses),
answers as (select bucket, count(*) as answered from records
  where record_id % 3 <> 0 and batch % 4 <> 3 group by bucket),
used as (
  select b.bucket, count(*) as batches, count(*) filter (not ok) as failed_batches,
    sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens,
    (sum(p) + sum(c))::bigint as total_tokens,
    round((sum(p)::bigint * 0.59::double + sum(c)::bigint * 0.79::double) / 1e6::double, 9) as estimated_cost,
    sum(n)::bigint as changes_explained,
    round((sum(p) + sum(c))::double / sum(n)::double, 6) as avg_tokens_per_change,
    (sum(n) - max(coalesce(answered, 0)))::bigint as fallback_count, bool_or(ok) as is_estimated
  from per_batch b left join answers a on a.bucket = b.bucket group by b.bucket)"""


def _usage(spark, sf_dir):
    used = explain.usage(_answered(spark, sf_dir), "groq", by=["bucket"])
    return used.select(
        "bucket", "batches", "failed_batches", "prompt_tokens", "completion_tokens", "total_tokens",
        F.round("estimated_cost", 9).alias("estimated_cost"), "changes_explained",
        F.round("avg_tokens_per_change", 6).alias("avg_tokens_per_change"), "fallback_count",
        "is_estimated",
    )


@query("scd2_usage", f"{BATCHES}, {USAGE_SQL} select * from used")
def usage(spark, sf_dir):
    return _usage(spark, sf_dir)


@query(
    "scd2_efficiency",
    f"""{BATCHES}, {USAGE_SQL}
select bucket, case when bucket % 3 = 2 then 'Offline' when avg_tokens_per_change <= 150 then 'Excellent'
  when avg_tokens_per_change <= 350 then 'Good' when avg_tokens_per_change <= 750 then 'Moderate'
  else 'Expensive' end as badge from used""",
)
def efficiency(spark, sf_dir):
    provider = F.when(F.col("bucket") % 3 == 2, "template").otherwise("groq")
    badge = metrics.efficiency(F.col("avg_tokens_per_change"), provider)
    return _usage(spark, sf_dir).select("bucket", badge.alias("badge"))


@query(
    "scd2_usage_warnings",
    f"""{BATCHES}, {USAGE_SQL}
select case when failed_batches > 0
  then '⚠️ Groq API failed: ' || failed_batches || ' batch(es). Fell back to template.'
  else '⚠️ Groq API fell back to template for ' || fallback_count
    || ' explanation(s) due to missing items in the response.' end as warning
from used where failed_batches > 0 or fallback_count > 0""",
)
def usage_warnings(spark, sf_dir):
    return explain.warnings(explain.usage(_answered(spark, sf_dir), "groq", by=["bucket"]))


# ---- Views and figures


@query(
    "scd2_changed_wide",
    f"""{CUSTOMERS} select c_custkey,
  case when seg_differs then t_seg end as "c_mktsegment (old)",
  case when seg_differs then s_seg end as "c_mktsegment (new)",
  case when name_differs then t_name end as "c_name (old)",
  case when name_differs then s_name end as "c_name (new)",
  case when nation_differs then t_nation end as "c_nationkey (old)",
  case when nation_differs then s_nation end as "c_nationkey (new)"
from ch where change_type = 'changed'""",
)
def changed_wide(spark, sf_dir):
    return views.changed_wide(_customers(spark, sf_dir))


@query(
    "scd2_key_labels",
    f"with {pairs.UNKNOWN_KEYS_SQL} select 'buyer=' || coalesce(cast(buyer as varchar), 'None') "
    "|| ', status=' || coalesce(status, 'None') as label, n_orders from src",
)
def key_labels(spark, sf_dir):
    source, _ = pairs.unknown_keys(spark, sf_dir)
    return source.select(key_label(["buyer", "status"], source.schema).alias("label"), "n_orders")


@query(
    "scd2_table_profile",
    f"{APPLIED} select count(*) as row_count, 7 as column_count, count(*) filter (is_current) as "
    "current_count, count(*) filter (not is_current) as historical_count from out",
)
def table_profile(spark, sf_dir):
    return metrics.table_profile(_applied(spark, sf_dir))


@query(
    "scd2_impact",
    f"""{CUSTOMERS}, seg as (
  select c.c_nationkey, {SUMMARY_SQL} from ch join customer c using (c_custkey) group by 1)
select c_nationkey, total as total_records, new + changed + deleted as changes,
  unchanged as historical_preserved, 5::bigint as rules_passed, 5::bigint as rules_total from seg""",
)
def impact(spark, sf_dir):
    comparison = _customers(spark, sf_dir)
    nation = F.coalesce("__new_c_nationkey", "__old_c_nationkey").alias("c_nationkey")
    changes = summary(comparison.rows.select(nation, "change_type"), ["c_nationkey"])
    output = apply_scd2(comparison, processing_date=DAY)
    rules = validate.validate_scd2(output, KEY, by=["c_nationkey"]).rules
    return metrics.impact(changes, rules, ["c_nationkey"])


@query(
    "scd2_preview",
    f"{APPLIED} select * from out order by c_custkey nulls first, effective_from nulls first limit 200",
)
def preview(spark, sf_dir):
    return views.preview(views.ordered(_applied(spark, sf_dir), KEY))


@query(
    "scd2_run_history",
    f"""{CUSTOMERS}, runs as (
  select timestamp '2026-01-01 00:00:00' + to_hours((c_custkey // 100)::int * 5) as "timestamp",
    {SUMMARY_SQL.replace(", count(*) as total", "")}, count(*) as total
  from ch group by c_custkey // 100)
select row_number() over (order by "timestamp") as run, "timestamp", new, changed, unchanged, deleted,
  total / 100 as exec_time from runs""",
)
def run_history(spark, sf_dir):
    """Each hundred customers taken as a run of their own."""
    block = F.floor(F.col("c_custkey") / 100)
    runs = summary(_changes(spark, sf_dir).withColumn("block", block), ["block"]).select(
        F.timestamp_add("HOUR", F.col("block").cast("int") * 5, F.lit("2026-01-01").cast("timestamp"))
        .cast("timestamp_ntz")
        .alias("timestamp"),
        "new", "changed", "unchanged", "deleted", (F.col("total") / 100).alias("exec_time"),
    )
    return audit.history(runs)
