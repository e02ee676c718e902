import datetime

import pytest
from conftest import DAY, rows

from sediment.operators.apply import apply_scd2
from sediment.operators.diff import compare
from sediment.operators.validate import validate_scd2

OLD = "2026-06-07"
OLD_DAY = datetime.date(2026, 6, 7)


def applied(source, target, key=("id",), tracked=None, **options):
    return apply_scd2(source, target, list(key), tracked, DAY, **options)


def test_every_kind_of_row(snapshot, history):
    source = snapshot((1, "a"), (2, "b"), (3, "new"))
    target = history(
        (1, "a", OLD, None, True), (2, "x", OLD, None, True), (4, "gone", OLD, None, True),
        (2, "w", "2026-01-01", OLD, False),
    )
    output = applied(source, target)
    assert output.columns == ["id", "name", "effective_from", "effective_to", "is_current"]
    assert rows(output) == sorted(
        [
            (1, "a", OLD_DAY, None, True),
            (2, "w", datetime.date(2026, 1, 1), OLD_DAY, False),
            (2, "x", OLD_DAY, DAY, False),
            (2, "b", DAY, None, True),
            (3, "new", DAY, None, True),
            (4, "gone", OLD_DAY, DAY, False),
        ],
        key=repr,
    )
    assert validate_scd2(output, ["id"]).passed()


def test_ignored_deletions_stay_open(snapshot, history):
    target = history((4, "kept", OLD, None, True))
    output = applied(snapshot(), target, delete_policy="ignore")
    assert rows(output) == [(4, "kept", OLD_DAY, None, True)]
    general = applied(
        snapshot(), target, delete_policy="ignore", unique=False, order_by=["name"],
        target_order_by=["name"],
    )
    assert rows(general) == rows(output)


def test_empty_result_keeps_types(snapshot, history):
    output = applied(snapshot(), history())
    assert output.dtypes == [
        ("id", "bigint"), ("name", "string"), ("effective_from", "date"), ("effective_to", "date"),
        ("is_current", "boolean"),
    ]
    assert output.count() == 0 and validate_scd2(output, ["id"]).passed()


def test_rows_without_flag_vanish_or_stop_the_job(snapshot, history):
    target = history((1, "a", OLD, None, None), (2, "b", OLD, None, True))
    assert [r[0] for r in rows(applied(snapshot((2, "b")), target))] == [2]
    with pytest.raises(Exception, match="is_current is null"):
        applied(snapshot((2, "b")), target, null_flags="error").collect()


def test_removed_columns(frame):
    source = frame([(1, "b"), (2, "n")], "id long, name string")
    target = frame(
        [(1, "a", "Rome", OLD, None, True)],
        "id long, name string, city string, effective_from date, effective_to date, is_current boolean",
    )
    assert "city" not in applied(source, target).columns
    kept = applied(source, target, removed_columns="keep")
    assert rows(kept, "id", "name", "city", "is_current") == sorted(
        [(1, "a", "Rome", False), (1, "b", None, True), (2, "n", None, True)], key=repr
    )


def test_repeated_key_that_is_changed_and_unchanged_ends_with_two_open_rows(frame, history):
    source = frame([(1, "a", 1), (1, "b", 2)], "id long, name string, n long")
    output = applied(
        source, history((1, "a", OLD, None, True)), tracked=["name"], order_by=["n"],
        target_order_by=["name"],
    )
    assert rows(output, "id", "name", "is_current") == [(1, "a", True), (1, "b", True)]
    rules = {r.rule: r.status for r in validate_scd2(output, ["id"]).rules.collect()}
    assert rules["one_current_per_key"] == rules["no_overlapping_dates"] == "fail"


def test_repeated_current_rows_are_closed_together(frame, history):
    target = history((1, "a", OLD, None, True), (1, "b", OLD, None, True), (2, "c", OLD, None, True))
    output = applied(
        frame([(1, "z")], "id long, name string"), target, unique=False, order_by=["name"],
        target_order_by=["name"],
    )
    assert rows(output, "id", "name", "is_current") == [
        (1, "a", False), (1, "b", False), (1, "z", True), (2, "c", False),
    ]


def test_backdated_run_is_reported(snapshot, history):
    target = history((1, "a", "2026-06-20", None, True))
    rules = validate_scd2(applied(snapshot((1, "b")), target), ["id"]).rules
    assert "date_consistency" in [r.rule for r in rules.filter("status = 'fail'").collect()]


def test_runs_repeat_and_chain(snapshot, history):
    target = history((1, "a", "2026-06-01", None, True))
    first = applied(snapshot((1, "b")), target)
    assert rows(first) == rows(applied(snapshot((1, "b")), target))
    second = apply_scd2(snapshot((1, "c")), first, ["id"], None, "2026-06-09")
    assert second.count() == 3 and validate_scd2(second, ["id"], extras=True).passed()
    again = apply_scd2(snapshot((1, "c")), second, ["id"], None, "2026-06-10")
    assert rows(again) == rows(second)


def test_three_part_key(frame):
    source = frame(
        [(1, "EU", "crm", "a"), (1, "EU", "erp", "b"), (1, "US", "crm", "n")],
        "id long, region string, source_system string, name string",
    )
    target = frame(
        [(1, "EU", "crm", "a", OLD, None, True), (1, "EU", "erp", "x", OLD, None, True),
         (2, "EU", "crm", "g", OLD, None, True)],
        "id long, region string, source_system string, name string,"
        " effective_from date, effective_to date, is_current boolean",
    )
    output = applied(source, target, ["id", "region", "source_system"])
    assert output.count() == 5 and output.filter("is_current").count() == 3


def test_kept_comparison_gives_the_same(snapshot, history, tmp_path):
    source = snapshot((1, "a"), (2, "b"))
    target = history((1, "z", OLD, None, True), (3, "c", OLD, None, True))
    comparison = compare(source, target, ["id"])
    for kept in (comparison.materialized(), comparison.materialized(str(tmp_path))):
        assert rows(apply_scd2(kept, processing_date=DAY)) == rows(
            apply_scd2(comparison, processing_date=DAY)
        )
    assert list(tmp_path.iterdir())


def test_arguments_are_checked(snapshot, history):
    for options in ({"delete_policy": "hard"}, {"null_flags": "?"}, {"removed_columns": "?"},
                    {"duplicates": "?"}):
        with pytest.raises(ValueError):
            applied(snapshot(), history(), **options)
    with pytest.raises(ValueError, match="processing_date"):
        apply_scd2(snapshot(), history(), ["id"])
