import pytest
from conftest import rows

from sediment.operators.diff import compare, detect_changes, exploded_fields, summary

OLD = "2026-06-07"


def counts(changes):
    return tuple(summary(changes).first())


def current(*data):
    return [(*d, OLD, None, True) for d in data]


def test_the_four_types(snapshot, history):
    source = snapshot((1, "a"), (2, "b"), (3, "new"))
    target = history(*current((1, "a"), (2, "x"), (4, "gone")))
    changes = detect_changes(source, target, ["id"])
    assert rows(changes, "id", "change_type") == [
        (1, "unchanged"), (2, "changed"), (3, "new"), (4, "deleted"),
    ]
    assert rows(exploded_fields(changes, ["id"])) == [(2, "name", "x", "b")]
    assert counts(changes) == (1, 1, 1, 1, 4)


def test_closed_rows_take_no_part(snapshot, history):
    target = history((1, "b", "2026-01-01", "2026-02-01", False), (1, "a", "2026-02-01", None, True))
    assert counts(detect_changes(snapshot((1, "b")), target, ["id"])) == (0, 1, 0, 0, 1)


def test_empty_sides(snapshot, history):
    some, full = snapshot((1, "a"), (2, "b")), history(*current((1, "a"), (2, "b")))
    assert counts(detect_changes(snapshot(), full, ["id"])) == (0, 0, 0, 2, 2)
    assert counts(detect_changes(some, history(), ["id"])) == (2, 0, 0, 0, 2)
    assert counts(detect_changes(snapshot(), history(), ["id"])) == (0, 0, 0, 0, 0)


def test_only_closed_rows_means_new(snapshot, history):
    target = history((1, "a", "2026-01-01", "2026-02-01", False))
    assert counts(detect_changes(snapshot((1, "a")), target, ["id"])) == (1, 0, 0, 0, 1)


def test_empty_text_is_null_and_spaces_do_not_matter(snapshot, history):
    source = snapshot((1, ""), (2, None), (3, "  "), (4, " a "), (5, "A"), (6, None), (7, "x"))
    target = history(*current((1, None), (2, ""), (3, None), (4, "a"), (5, "a"), (6, "x"), (7, None)))
    changes = detect_changes(source, target, ["id"])
    assert [r[0] for r in rows(changes.filter("change_type = 'changed'"))] == [5, 6, 7]


def test_reported_values_are_raw(snapshot, history):
    changes = detect_changes(snapshot((1, " b ")), history(*current((1, None))), ["id"])
    assert rows(exploded_fields(changes, ["id"])) == [(1, "name", None, " b ")]


def test_null_keys_match_each_other(frame):
    source = frame([(None, "x", "a"), (1, None, "a"), (None, None, "b")], "k long, r string, v string")
    target = frame(
        [(None, "x", "a", OLD, None, True), (1, None, "z", OLD, None, True), (0, "", "q", OLD, None, True)],
        "k long, r string, v string, effective_from date, effective_to date, is_current boolean",
    )
    for unique in (True, False):
        changes = detect_changes(
            source, target, ["k", "r"], unique=unique, order_by=["v"], target_order_by=["v"]
        )
        assert rows(changes, "k", "r", "change_type") == sorted(
            [(None, "x", "unchanged"), (1, None, "changed"), (None, None, "new"), (0, "", "deleted")],
            key=repr,
        )


def test_one_record_per_repeated_row(spark, history):
    source = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "c", 4)], "id long, name string, n int"
    )
    target = history(*current((1, "a"), (3, "gone")))
    changes = detect_changes(
        source, target, ["id"], ["name"], unique=False, order_by=["n"],
        target_order_by=["name"],
    )
    assert rows(changes, "id", "change_type") == [
        (1, "changed"), (1, "unchanged"), (1, "unchanged"), (2, "new"), (3, "deleted"),
    ]


def test_last_current_row_counts(history, snapshot):
    target = history(*current((1, "a"), (1, "b")))
    options = {"order_by": ["name"], "target_order_by": ["name"]}
    assert counts(detect_changes(snapshot((1, "b")), target, ["id"], **options)) == (0, 0, 1, 0, 1)
    assert counts(detect_changes(snapshot((1, "a")), target, ["id"], **options)) == (0, 1, 0, 0, 1)


def test_repeated_keys_need_an_order(snapshot, history):
    source, target = snapshot((1, "a"), (1, "b")), history(*current((1, "a")))
    with pytest.raises(ValueError, match="no order"):
        compare(source, target, ["id"])
    with pytest.raises(ValueError, match="duplicate business keys"):
        compare(source, target, ["id"], duplicates="error")
    with pytest.raises(ValueError, match="several current rows"):
        compare(snapshot((1, "a")), history(*current((1, "a"), (1, "b"))), ["id"], duplicates="error")


@pytest.mark.parametrize("unique", [None, True, False])
def test_repeated_keys_are_rejected_whatever_was_promised(snapshot, history, unique):
    with pytest.raises(ValueError, match="duplicate business keys"):
        compare(
            snapshot((1, "a"), (1, "b")), history(*current((1, "a"))), ["id"], unique=unique,
            duplicates="error", order_by=["name"], target_order_by=["name"],
        )


def test_uniqueness_is_found_out(snapshot, history):
    assert compare(snapshot((1, "a"), (None, "b")), history(*current((1, "a"))), ["id"]).unique
    repeated = compare(
        snapshot((None, "a"), (None, "b")), history(), ["id"], order_by=["name"], target_order_by=["name"]
    )
    assert not repeated.unique


def test_text_and_number_of_one_value_agree(frame):
    source = frame([(1, "100"), (2, "7")], "id long, value string")
    target = frame(
        [(1, 100, OLD, None, True), (2, 8, OLD, None, True)],
        "id long, value long, effective_from date, effective_to date, is_current boolean",
    )
    assert rows(detect_changes(source, target, ["id"]), "id", "change_type") == [
        (1, "unchanged"), (2, "changed"),
    ]


def test_keys_of_other_types_are_cast_or_rejected(frame, history):
    target = history(*current((1, "a")))
    good = frame([("1", "a")], "id string, name string")
    assert counts(detect_changes(good, target, ["id"], unique=True)) == (0, 0, 1, 0, 1)
    bad = frame([("one", "a")], "id string, name string")
    with pytest.raises(Exception, match="value 'one' of the snapshot does not fit"):
        detect_changes(bad, target, ["id"], unique=True).collect()


def test_missing_columns_read_as_null(frame, snapshot):
    source = frame([(1, "a", None), (2, "b", "x")], "id long, name string, city string")
    target = frame(
        [(1, "a", OLD, None, True), (2, "b", OLD, None, True)],
        "id long, name string, effective_from date, effective_to date, is_current boolean",
    )
    changes = detect_changes(source, target, ["id"], ["city", "name"])
    assert rows(changes, "id", "change_type") == [(1, "unchanged"), (2, "changed")]


def test_without_flag_all_rows_are_current(frame, snapshot):
    target = frame([(1, "a")], "id long, name string")
    assert counts(detect_changes(snapshot((1, "a"), (2, "b")), target, ["id"])) == (1, 0, 1, 0, 2)


def test_fields_are_listed_in_column_order(frame):
    source = frame([(1, "n", "c", "t")], "id long, name string, city string, tier string")
    target = frame(
        [(1, "x", "y", "t", OLD, None, True)],
        "id long, name string, city string, tier string,"
        " effective_from date, effective_to date, is_current boolean",
    )
    changes = detect_changes(source, target, ["id"]).first()
    assert [f.column for f in changes.field_changes] == ["city", "name"]


def test_no_tracked_columns(frame):
    source = frame([(1,), (2,)], "id long")
    target = frame(
        [(1, OLD, None, True)],
        "id long, effective_from date, effective_to date, is_current boolean",
    )
    assert counts(detect_changes(source, target, ["id"])) == (1, 0, 1, 0, 2)


def test_segments(snapshot, history):
    source, target = snapshot((1, "a"), (2, "b")), history(*current((1, "z")))
    by_id = summary(detect_changes(source, target, ["id"]), ["id"])
    assert rows(by_id) == [(1, 0, 1, 0, 0, 1), (2, 1, 0, 0, 0, 1)]
