import datetime

from conftest import rows

from pyspark.sql import Observation

from sediment.operators import validate
from sediment.operators.validate import validate_scd2
from sediment.sources import sinks


def status(df, key=("id",), **options):
    return {r.rule: r.status for r in validate_scd2(df, list(key), **options).rules.collect()}


def overlap_count(df):
    found = validate_scd2(df, ["id"])
    counted = found.rules.filter("rule = 'no_overlapping_dates'").first().violation_count
    pairs = sum(r.pairs for r in found.violations["no_overlapping_dates"].collect())
    assert counted == pairs
    return counted


def test_a_sound_table_passes(history):
    df = history((1, "a", "2026-01-01", "2026-02-01", False), (1, "b", "2026-02-01", None, True))
    found = validate_scd2(df, ["id"])
    assert set(status(df).values()) == {"pass"} and found.passed()
    assert tuple(found.summary().first()) == (5, 0, 0, 5, True)
    assert found.details().count() == 0


def test_empty_table_passes(history):
    assert set(status(history(), extras=True).values()) == {"pass"}


def test_boundaries_of_periods(history):
    def count(*periods):
        return overlap_count(history(*[(1, "a", f, t, False) for f, t in periods]))

    assert count(("2026-01-01", "2026-02-01"), ("2026-02-01", None)) == 0  # touching
    assert count(("2026-01-01", "2026-02-01"), ("2026-03-01", None)) == 0  # gap
    assert count(("2026-01-01", "2026-02-02"), ("2026-02-01", None)) == 1  # one day over
    assert count(("2026-01-01", None), ("2026-02-01", None)) == 1  # open before another
    assert count(("2026-02-01", "2026-02-01"), ("2026-02-01", None)) == 0  # zero length first
    assert count(("2026-02-01", None), ("2026-02-01", "2026-02-01")) == 0  # in any input order
    assert count(("2026-03-01", None), ("2026-01-01", "2026-03-01")) == 0  # rows out of order
    assert count(("2026-01-01", "2026-06-01"), ("2026-02-01", "2026-03-01"), ("2026-04-01", None)) == 1
    assert count((None, "2026-01-01"), (None, "2026-02-01")) == 1  # null start after a closed row
    assert count((None, "2026-01-01"), ("2026-02-01", None)) == 0
    assert count(*[("2026-01-01", None)] * 4) == 3  # copies


def test_overlap_text(history):
    df = history((1, "a", "2026-01-01", None, False), (1, "b", "2026-02-01", None, True))
    assert validate.overlaps(df, ["id"]).first().detail == (
        "Overlap detected for id=1\nPeriod A:\n2026-01-01 → NULL\n\nPeriod B:\n2026-02-01 → NULL"
    )


def test_repeated_current_rows(history):
    df = history((1, "a", "2026-01-01", None, True), (1, "b", "2026-02-01", None, True),
                 (None, "c", "2026-01-01", None, True), (None, "d", "2026-02-01", None, True))
    assert rows(validate.repeated_current(df, ["id"]), "detail") == [
        ("Key id=1 has 2 current rows",), ("Key id=None has 2 current rows",),
    ]
    rule = validate_scd2(df, ["id"]).rules.filter("rule_no = 2").first()
    assert rule.message == "2 business key(s) have multiple current rows."


def test_null_keys(history):
    df = history((None, "a", "2026-01-01", None, True), (2, "b", "2026-01-01", None, True))
    rule = validate_scd2(df, ["id"]).rules.filter("rule_no = 3").first()
    assert (rule.status, rule.message) == ("fail", "1 row(s) have null business key values.")
    assert rows(validate.null_key_rows(df, ["id"]), "detail") == [
        ("Row with null key found (row count: 1)",)
    ]


def test_inverted_dates(history):
    df = history((1, "a", "2026-02-01", "2026-01-01", False), (2, "b", None, "2026-01-01", False))
    found = validate_scd2(df, ["id"])
    assert found.rules.filter("rule_no = 5").first().violation_count == 1
    assert rows(found.violations["date_consistency"], "id") == [(1,)]


def test_missing_columns(frame):
    df = frame([(1, "2026-01-01")], "id long, effective_from date")
    assert status(df) == {
        "schema_completeness": "fail", "one_current_per_key": "fail", "no_null_keys": "pass",
        "no_overlapping_dates": "warn", "date_consistency": "warn",
    }
    found = validate_scd2(df, ["id"])
    assert not found.passed()
    assert rows(found.details(), "detail") == [("Missing: effective_to",), ("Missing: is_current",)]
    no_key = frame([("2026-01-01", None, True)], "effective_from date, effective_to date, is_current boolean")
    assert status(no_key)["no_overlapping_dates"] == "warn"
    assert validate_scd2(no_key, ["id"]).details().isEmpty()


def test_warnings_pass(frame):
    df = frame([(1, "2026-01-01")], "id long, effective_from date")
    rules = validate_scd2(df, ["id"]).rules.filter("status <> 'fail'")
    assert validate.rule_summary(rules).first().passed


def test_extra_rules_are_optional(history):
    df = history((1, "a", "2026-01-01", "2026-02-01", False), (1, "b", "2026-03-01", "2026-04-01", True))
    assert set(status(df).values()) == {"pass"}
    extra = status(df, extras=True)
    assert extra["valid_current_records"] == extra["no_history_gaps"] == "fail"
    gap = validate.gaps(df, ["id"]).first()
    assert (gap.to_a, gap.from_b) == (datetime.date(2026, 2, 1), datetime.date(2026, 3, 1))


def test_segments_are_checked_alone(frame):
    schema = "region string, id long, effective_from date, effective_to date, is_current boolean"
    df = frame(
        [("EU", 1, "2026-01-01", None, True), ("US", 1, "2026-01-01", None, True),
         ("US", 1, "2026-01-01", None, True)], schema,
    )
    found = validate_scd2(df, ["id"], by=["region"])
    assert rows(found.summary(), "region", "passed") == [("EU", True), ("US", False)]
    assert set(found.details().select("region").collect()[0]) == {"US"}


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_details_read_the_history_twice_at_most(spark, history, tmp_path):
    table = history(
        (1, "a", "2026-01-01", None, True), (1, "b", "2026-02-01", None, True),
        (None, "c", "2026-02-01", "2026-01-01", False), (2, "d", "2026-01-01", "2026-01-05", False),
        (2, "d", "2026-01-01", "2026-01-05", False), (2, "e", "2026-02-01", None, True),
    )
    table.write.parquet(str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    found = validate.validate_scd2(stored, ["id"], extras=True)
    assert scans(found.rules) == scans(found.violations["no_overlapping_dates"]) == 1
    assert scans(found.violations["no_history_gaps"]) == 1
    assert scans(found.details()) == scans(sinks.validation_lines(found)) == 2
    texts = sorted((r["rule_no"], r["detail"].split("\n")[0], r["copies"]) for r in found.details().collect())
    assert texts == [
        (2, "Key id=1 has 2 current rows", 1),
        (3, "Row with null key found (row count: 1)", 1),
        (4, "Overlap detected for id=1", 1),
        (4, "Overlap detected for id=2", 1),
        (7, "Gap for id=2: 2026-01-05 → 2026-01-01", 1),
        (7, "Gap for id=2: 2026-01-05 → 2026-02-01", 1),
    ]
    per_key = validate.validate_scd2(stored, ["id"], by=["name"], extras=True).details()
    assert per_key.columns == ["name", "rule_no", "rule", "detail", "copies"]


def test_details_where_columns_are_missing(spark, history):
    table = history((1, "a", "2026-01-01", None, True), (None, "b", "2026-01-01", None, True))
    for gone, rules in (
        (["is_current"], [1, 3]), (["effective_to"], [1, 3]), (["id"], []),
        (["effective_from", "effective_to", "is_current"], [1, 1, 1, 3]),
    ):
        found = validate.validate_scd2(table.drop(*gone), ["id"], extras=True)
        assert sorted(r["rule_no"] for r in found.details().collect()) == rules, gone
        assert sinks.validation_lines(found).count() == found.rules.count() + len(rules)


def test_rows_inspected_are_observed(spark, history):
    seen = Observation()
    found = validate.validate_scd2(history((1, "a", "2026-01-01", None, True)), ["id"], observation=seen)
    found.rules.collect()
    assert seen.get == {"rows": 1}
