"""Awkward column names and key types."""

import pytest
from conftest import DAY, rows
from pyspark.sql import functions as F

from sediment.functions.casts import checked_cast
from sediment.operators.apply import apply_scd2
from sediment.operators.diff import compare, summary
from sediment.operators.explain import explain_changes
from sediment.operators.validate import validate_scd2
from sediment.operators.views import changed_wide
from sediment.plans.keyed import match
from sediment.plans.materialize import materialize, shared_folder

META = "date'2026-01-01' effective_from, cast(null as date) effective_to, true is_current"


@pytest.mark.parametrize("unique", [True, False])
def test_names_with_dots_and_spaces(spark, unique):
    source = spark.sql(
        "select 1 `rows`, 'a' `first name`, 'x' `a.b`, 2 `bucket` union all select 2, 'b', 'y', 3"
    )
    target = spark.sql(f"select 1 `rows`, 'a' `first name`, 'z' `a.b`, 2 `bucket`, {META}")
    key = ["rows", "bucket"]
    comparison = compare(
        source, target, key, unique=unique, order_by=["first name"], target_order_by=["first name"]
    )
    output = apply_scd2(comparison, processing_date=DAY)
    assert rows(output, "rows", "bucket", "a.b", "is_current") == [
        (1, 2, "x", True), (1, 2, "z", False), (2, 3, "y", True),
    ]
    found = validate_scd2(output, key, by=["first name"], extras=True)
    assert found.passed() and found.details().isEmpty()
    assert rows(changed_wide(comparison), "a.b (old)", "a.b (new)") == [("z", "x")]
    explained = explain_changes(comparison.changes(), key, lambda p: "{}").explanations
    assert rows(explained, *key, "change_type") == [(1, 2, "changed"), (2, 3, "new")]


@pytest.mark.parametrize(
    "value",
    ["1.5bd", "date'2026-01-01'", "timestamp'2026-01-01 00:00:00'", "true", "X'01'", "1Y", "2.5d", "''"],
)
def test_key_types(spark, value):
    kind = spark.sql(f"select {value} k").dtypes[0][1]
    source = spark.sql(f"select {value} k, 'a' v union all select cast(null as {kind}), 'b'")
    target = spark.sql(f"select {value} k, 'z' v, {META}")
    comparison = compare(source, target, ["k"])
    assert tuple(summary(comparison.changes()).first()) == (1, 1, 0, 0, 2)
    assert apply_scd2(comparison, processing_date=DAY).dtypes[0] == ("k", kind)


def test_hot_keys_meet_their_partner_in_a_join_that_can_be_split(spark):
    left = spark.range(6000).selectExpr("id % 300 as k", "id as n")
    right = spark.range(200, 400).selectExpr("id as k", "id as m")
    found = match(left, right, ["k"])
    assert found.count() == 6100
    assert found.filter("n is null").count() == 100 and found.filter("m is null").count() == 4000
    plan = found._jdf.queryExecution().toString()
    assert "FullOuter" not in plan and "TakeOrdered" not in plan


def test_kept_results_are_written_where_the_session_says(spark, tmp_path):
    df = spark.range(10)
    kept = materialize(df, str(tmp_path))
    assert rows(kept) == rows(df) and "FileScan parquet" in kept._jdf.queryExecution().toString()
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir", None)


@pytest.mark.parametrize(
    ("kind", "value", "history", "fits"),
    [
        ("double", "100.555", "decimal(10,2)", False), ("double", "100.5", "decimal(10,2)", True),
        ("timestamp", "2026-01-01 10:00:00", "date", False), ("timestamp", "2026-01-01", "date", True),
        ("long", "9007199254740993", "double", False), ("long", "9007199254740992", "double", True),
        ("string", "7.5", "double", True), ("string", "x", "long", False), ("string", " ", "long", True),
    ],
)
def test_values_that_lose_something_stop_the_job(spark, kind, value, history, fits):
    df = spark.createDataFrame([(value,)], "v string").selectExpr(f"cast(v as {kind}) as v")
    target = spark.createDataFrame([], f"v {history}").schema["v"].dataType
    cast = df.select(checked_cast(F.col("v"), "v", df.schema["v"].dataType, target))
    if fits:
        cast.collect()
    else:
        with pytest.raises(Exception, match="does not fit"):
            cast.collect()


@pytest.mark.parametrize(
    ("value", "history", "fits"),
    [
        ("100.555", "decimal(10,2)", False), ("100.55", "decimal(10,2)", True), (" 7 ", "long", True),
        ("2026-01-01 10:00:00", "date", False), ("2026-01-01", "date", True),
        ("9007199254740993", "double", False), ("9007199254740992", "double", True), ("0.1", "float", True),
        ("123456789012345678901234567", "double", False), ("1e300", "double", True), ("NaN", "double", True),
        ("007", "long", True), ("yes", "boolean", True),
    ],
)
def test_text_that_says_more_than_the_key_can_hold_stops_the_job(spark, value, history, fits):
    df = spark.createDataFrame([(value,)], "v string")
    target = spark.createDataFrame([], f"v {history}").schema["v"].dataType
    cast = df.select(checked_cast(F.col("v"), "v", df.schema["v"].dataType, target))
    if fits:
        assert cast.first()[0] is not None
    else:
        with pytest.raises(Exception, match="does not fit"):
            cast.collect()


@pytest.mark.parametrize(
    ("snapshot", "history", "kind", "change"),
    [
        ("'100.555'", "1.00bd", "string", "changed"), ("'2026-01-01 10:00:00'", "date'2026-01-01'", "string", "changed"),
        ("'9007199254740993'", "1d", "string", "changed"), ("9007199254740993L", "1d", "string", "changed"),
        ("'007'", "7L", "string", "changed"), ("' 7'", "7L", "string", "unchanged"), ("'N/A'", "7L", "string", "changed"),
        ("100.555bd", "100.56bd", "decimal(6,3)", "changed"), ("100.50bd", "100.5000bd", "decimal(7,4)", "unchanged"),
        ("5L", "5.00bd", "decimal(22,2)", "unchanged"),
        ("cast(1 as decimal(38,30))", "1L", "string", "changed"),
        ("timestamp'2026-01-01 10:00:00'", "date'2026-01-01'", "timestamp", "changed"),
        ("date'2026-01-01'", "timestamp'2026-01-01 00:00:00'", "timestamp", "unchanged"),
        ("1e16d", "'x'", "string", "changed"), ("true", "'x'", "string", "changed"), ("1.5f", "1.5d", "double", "unchanged"),
        ("null", "5L", "bigint", "changed"), ("5L", "null", "bigint", "changed"),
    ],
)
def test_a_second_run_finds_nothing_changed_and_nothing_is_lost(spark, snapshot, history, kind, change):
    source = spark.sql(f"select 1 k, {snapshot} v")
    target = spark.sql(f"select 1 k, {history} v, {META}")
    comparison = compare(source, target, ["k"], unique=True)
    assert comparison.changes().first()["change_type"] == change
    output = apply_scd2(comparison, processing_date=DAY)
    assert dict(output.dtypes)["v"] == kind
    again = compare(source, output, ["k"], unique=True).changes().collect()
    assert [r["change_type"] for r in again] == ["unchanged"]
