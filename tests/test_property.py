"""Random inputs against the plain-Python model; many small cases share one Spark job."""

import datetime
import random

import pytest
from conftest import DAY, rows

import model
from sediment.functions.columns import CHANGE_TYPES
from sediment.operators import validate
from sediment.operators.apply import apply_scd2
from sediment.operators.diff import compare

KEY = ["case", "id", "part"]
TRACKED = ["city", "name"]
SOURCE = "case long, id long, part string, city string, name string, n long"
TARGET = SOURCE + ", effective_from date, effective_to date, is_current boolean"
START = datetime.date(2026, 1, 1)
CASES = 150


def build(seed, repeats):
    """Cases with nulls in keys and values; with ``repeats`` keys occur several times."""
    rng = random.Random(seed)
    source, target, n = [], [], 0

    def values():
        return {
            "city": rng.choice(["Rome", " Rome", "rome", "", None, "Oslo"]),
            "name": rng.choice(["Ann", "Ann\u2003", "Bob", None]),
        }

    for case in range(CASES):
        keys = [(i, p) for i in [None, 0, 1, 2] for p in [None, "", "x"]]
        rng.shuffle(keys)
        for side in ("source", "target"):
            for i, p in keys[: rng.randint(0, 8)]:
                for _ in range(rng.choice([1, 1, 2, 4]) if repeats else 1):
                    n += 1
                    row = {"case": case, "id": i, "part": p, **values(), "n": n}
                    if side == "source":
                        source.append(row)
                        continue
                    opened = START + datetime.timedelta(days=rng.randint(10, 40))
                    target.append({**row, "effective_from": opened, "effective_to": None, "is_current": True})
                if side == "target" and rng.random() < 0.3:
                    n += 1
                    target.append({
                        "case": case, "id": i, "part": p, **values(), "n": n, "effective_from": START,
                        "effective_to": START + datetime.timedelta(days=10),
                        "is_current": rng.choice([False, False, None]),
                    })
            rng.shuffle(keys)
    return source, target


def frames(frame, source, target):
    s = [tuple(r.values()) for r in source]
    t = [tuple(str(v) if isinstance(v, datetime.date) else v for v in r.values()) for r in target]
    return frame(s, SOURCE), frame(t, TARGET)


def expected_changes(source, target):
    found, deleted = model.labels(source, target, KEY, TRACKED)
    out = [(*model.key_of(r, KEY), kind, tuple(fields)) for r, kind, fields in found]
    return sorted(out + [(*k, "deleted", ()) for k in deleted], key=repr)


def found_changes(comparison):
    return sorted(
        (
            (r["case"], r["id"], r["part"], r["change_type"], tuple(f.column for f in r["field_changes"]))
            for r in comparison.changes().collect()
        ),
        key=repr,
    )


def expected_output(source, target):
    columns = [*KEY, *TRACKED, "effective_from", "effective_to", "is_current"]
    out = model.apply(source, target, KEY, TRACKED, DAY)
    return sorted((tuple(r[c] for c in columns) for r in out), key=repr)


@pytest.mark.parametrize("unique", [True, False])
def test_unique_keys_by_both_paths(frame, unique):
    source, target = build(42, repeats=False)
    s, t = frames(frame, source, target)
    comparison = compare(
        s, t, KEY, TRACKED, unique=unique, order_by=["n"], target_order_by=["n"]
    )
    assert found_changes(comparison) == expected_changes(source, target)
    output = apply_scd2(comparison, processing_date=DAY)
    assert rows(output) == expected_output(source, target)

    verdicts = validate.validate_scd2(output, ["id", "part"], by=["case"]).rules
    assert verdicts.filter("status = 'fail' and rule <> 'no_null_keys'").isEmpty()
    current = output.filter("is_current").groupBy(*KEY).count()
    assert current.filter("count > 1").isEmpty()
    wanted = {model.key_of(r, KEY) for r in source}
    wanted |= {model.key_of(r, KEY) for r in target if r["is_current"] is not None}
    assert {tuple(r) for r in output.select(*KEY).distinct().collect()} == wanted


def test_repeated_keys_with_and_without_hot_ones(frame):
    source, target = build(7, repeats=True)
    s, t = frames(frame, source, target)
    comparison = compare(
        s, t, KEY, TRACKED, order_by=["n"], target_order_by=["n"]
    )
    assert not comparison.unique
    for kind in CHANGE_TYPES:
        picked = comparison.changes(kind).groupBy("change_type").count().collect()
        everything = [r for r in expected_changes(source, target) if r[3] == kind]
        assert [tuple(r) for r in picked] == [(kind, len(everything))]
    assert found_changes(comparison) == expected_changes(source, target)
    assert rows(apply_scd2(comparison, processing_date=DAY)) == expected_output(source, target)


def test_rules_on_random_histories(frame):
    rng = random.Random(3)
    days = [None, *[START + datetime.timedelta(days=d) for d in range(6)]]
    table = [
        {
            "case": case, "id": rng.choice([None, 1, 2]), "effective_from": rng.choice(days),
            "effective_to": rng.choice([None, *days]), "is_current": rng.choice([True, False, None]),
        }
        for case in range(200)
        for _ in range(rng.randint(1, 12))
    ]
    text = [tuple(str(v) if isinstance(v, datetime.date) else v for v in r.values()) for r in table]
    df = frame(text, "case long, id long, effective_from date, effective_to date, is_current boolean")

    found = validate.validate_scd2(df, ["id"], by=["case"], extras=True)
    counts = {}
    for r in found.rules.collect():
        counts.setdefault(r["case"], {})[r["rule"]] = r["violation_count"]
    for case in range(200):
        wanted = model.verdicts([r for r in table if r["case"] == case], ["id"])
        assert {k: counts[case][k] for k in wanted} == wanted, case

    for frame_, expected in (
        (found.violations["no_overlapping_dates"], model.overlaps),
        (found.violations["no_history_gaps"], model.gaps),
    ):
        pairs = sorted(
            (
                ((r["case"], r["id"]), r["from_a"], r["to_a"], r["from_b"], r["to_b"])
                for r in frame_.collect()
                for _ in range(r["pairs"])
            ),
            key=repr,
        )
        assert pairs == sorted(expected(table, ["case", "id"]), key=repr)
