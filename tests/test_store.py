"""Daily runs that write the difference, against whole tables by apply_scd2."""

import datetime
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sediment.operators.apply import apply_scd2
from sediment.sources.store import HistoryStore

DAYS = [datetime.date(2026, 6, d) for d in range(7, 13)]
COLUMNS = ["id", "name", "effective_from", "effective_to", "is_current"]


def snapshot_of(spark, number, n=60):
    k = F.col("id")
    name = F.when(k % 7 == number, F.concat(F.lit(f"v{number} "), k.cast("string"))).otherwise(k.cast("string"))
    return spark.range(n).filter(k % 11 != number).select("id", name.alias("name"), (k * 10 + number).alias("n"))


def begin(spark, folder, history, **options):
    store = HistoryStore(spark, str(folder), ["id"])
    table = history(
        *[(i, str(i), "2026-01-01" if i % 3 else "2026-02-01", None, True) for i in range(40)],
        (1, "w", "2025-01-01", "2026-01-01", False), (2, "lost", "2025-01-01", None, None), (50, "n", None, None, True),
    )
    store.start(table, DAYS[0])
    return store, table.filter("is_current is not null")


@pytest.mark.parametrize("unique", [True, False])
def test_days_one_repeated_read_back_as_applied(spark, tmp_path, history, unique):
    store, table = begin(spark, tmp_path / "store", history)
    assert rows(store.read(), *COLUMNS) == rows(table, *COLUMNS)
    states = {DAYS[0]: rows(table, *COLUMNS)}
    for number in (1, 2, 3):
        source = snapshot_of(spark, number)
        order = {} if unique else {"order_by": ["n"], "target_order_by": ["name"]}
        options = {"unique": unique, "tracked": ["name"], **order}
        if number == 2:
            store.run(snapshot_of(spark, 4), DAYS[number], **options)
        store.run(source, DAYS[number], **options)
        table = apply_scd2(source, table, ["id"], processing_date=DAYS[number], **options)
        table = spark.createDataFrame(table.collect(), table.schema)
        states[DAYS[number]] = rows(table, *COLUMNS)
        assert rows(store.read(), *COLUMNS) == states[DAYS[number]]
    assert store.dates() == DAYS[:4]
    for day, state in states.items():
        assert rows(store.read(as_of=day), *COLUMNS) == state
    with pytest.raises(ValueError, match="last date"):
        store.run(snapshot_of(spark, 1), DAYS[2])
    with pytest.raises(ValueError, match="already"):
        store.start(table, DAYS[5])


def written(folder, run):
    return {
        os.path.relpath(root, folder)
        for root, _, names in os.walk(folder)
        if any(n.endswith(".parquet") for n in names) and f"run_date={run}" in root
    }


def test_only_days_that_lost_or_got_a_row_are_written(spark, tmp_path, history):
    store, table = begin(spark, tmp_path, history)
    changed = table.filter("is_current").withColumn("name", F.when(F.col("id") == 4, "new").otherwise(F.col("name")))
    store.run(changed.select("id", "name"), DAYS[1], unique=True)
    assert {p.split("/")[1] for p in written(tmp_path, DAYS[1]) if p.startswith("open/")} == {
        "opened_on=2026-01-01", f"opened_on={DAYS[1]}",
    }
    # Nothing that an earlier commit names was changed.
    assert rows(store.read(as_of=DAYS[0]), *COLUMNS) == rows(table, *COLUMNS)
    unchanged = store.read().filter("is_current").select("id", "name")
    store.run(unchanged, DAYS[2], unique=True)
    assert not [p for p in written(tmp_path, DAYS[2]) if p.startswith("open/")]


def test_a_run_without_a_commit_is_not_read_and_is_repeated(spark, tmp_path, history, monkeypatch):
    store, table = begin(spark, tmp_path, history)
    source = snapshot_of(spark, 1)
    write = store._commit

    def fails(*args):
        write(*args)
        os.remove(tmp_path / f"commits/run_date={DAYS[1]}/_SUCCESS")

    monkeypatch.setattr(store, "_commit", fails)
    store.run(source, DAYS[1], unique=True, tracked=["name"])
    monkeypatch.undo()
    assert store.dates() == DAYS[:1] and rows(store.read(), *COLUMNS) == rows(table, *COLUMNS)
    store.run(snapshot_of(spark, 2), DAYS[1], unique=True, tracked=["name"])
    expected = apply_scd2(snapshot_of(spark, 2), table, ["id"], ["name"], DAYS[1], unique=True)
    assert rows(store.read(), *COLUMNS) == rows(expected, *COLUMNS)


def test_types_and_columns_that_change_between_runs(spark, tmp_path, history):
    store, table = begin(spark, tmp_path, history)
    source = spark.range(45).select("id", F.lit(1.5).alias("name"))
    store.run(source, DAYS[1], unique=True)
    found = store.read()
    assert dict(found.dtypes)["name"] == "string" and found.filter("name = '1.5'").count() == 45
    expected = apply_scd2(source, table, ["id"], processing_date=DAYS[1], unique=True)
    assert rows(found, *COLUMNS) == rows(expected, *COLUMNS)
