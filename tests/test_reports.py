import datetime

import pytest
from conftest import DAY, rows

from sediment.operators import metrics, views
from sediment.operators.apply import apply_scd2
from sediment.operators.diff import compare, detect_changes, in_report_order, summary
from sediment.operators.explain import template_explanations
from sediment.operators.validate import validate_scd2
from sediment.sources import audit, sinks
from sediment.sources.generate import make_pair
from sediment.sources.ingest import load_snapshot

OLD = "2026-06-07"


@pytest.fixture
def pair(snapshot, history):
    target = history((1, "x", OLD, None, True), (3, "g", OLD, None, True),
                     (1, "w", "2026-01-01", OLD, False))
    return snapshot((1, "a"), (2, "b")), target


def test_status_views(pair):
    output = apply_scd2(*pair, ["id"], processing_date=DAY)
    assert views.by_status(output).count() == 5
    assert views.by_status(output, views.CURRENT_ONLY).count() == 2
    assert views.by_status(output, views.HISTORICAL_ONLY).count() == 3
    starts = [r.effective_from for r in views.by_status(output, sort="effective_from").collect()]
    assert starts == sorted(starts)
    assert views.by_status(pair[0], views.CURRENT_ONLY).count() == 2  # no flag: no filter
    with pytest.raises(ValueError):
        views.by_status(output, "Open")


def test_output_order_and_preview(spark, pair):
    output = views.ordered(apply_scd2(*pair, ["id"], processing_date=DAY), ["id"]).collect()
    order = [(r.id, r.effective_from) for r in output]
    assert order == sorted(order)
    assert views.preview(spark.range(500)).count() == 200


def test_report_order(spark, history):
    source = spark.createDataFrame([(9, "a", 1), (2, "b", 2), (5, "c", 3)], "id long, name string, n int")
    target = history((7, "g", OLD, None, True), (2, "b", OLD, None, True))
    changes = detect_changes(
        source, target, ["id"], ["name"], unique=False, order_by=["n"], target_order_by=["name"]
    )
    assert [r.id for r in in_report_order(changes, ["id"]).collect()] == [9, 2, 5, 7]


def test_changed_wide(pair):
    wide = views.changed_wide(compare(*pair, ["id"]))
    assert wide.columns == ["id", "name (old)", "name (new)"]
    assert rows(wide) == [(1, "x", "a")]
    assert rows(views.deleted_keys(compare(*pair, ["id"]))) == [(3,)]
    assert rows(views.new_keys(compare(*pair, ["id"]))) == [(2,)]


def test_as_of(pair):
    output = apply_scd2(*pair, ["id"], processing_date=DAY)
    assert rows(views.as_of(output, "2026-03-01"), "id", "name") == [(1, "w")]
    assert rows(views.as_of(output, OLD), "id", "name") == [(1, "x"), (3, "g")]
    assert rows(views.as_of(output, DAY), "id", "name") == [(1, "a"), (2, "b")]


def test_profile_and_impact(pair):
    output = apply_scd2(*pair, ["id"], processing_date=DAY)
    assert tuple(metrics.table_profile(output).first()) == (5, 5, 2, 3)
    assert tuple(metrics.table_profile(pair[0]).first()) == (2, 2, 0, 0)
    changes = summary(compare(*pair, ["id"]).changes())
    assert tuple(metrics.impact(changes, validate_scd2(output, ["id"]).rules).first()) == (3, 3, 0, 5, 5)


def test_confidence(spark, history):
    def score(statuses, provider="template"):
        rules = spark.createDataFrame([(s,) for s in statuses], "status string")
        return tuple(metrics.confidence(rules, provider).first())

    assert score(["pass"] * 5) == (90.0, "Very High")
    assert score(["pass"] * 5, "groq") == (100.0, "Very High")
    assert score(["pass"] * 4 + ["warn"]) == (74.0, "Medium")
    assert score(["pass"] * 4 + ["warn"], "gemini") == (84.0, "High")
    assert score(["pass"] * 4 + ["fail"], "groq") == (84.0, "Low")
    assert score(["warn"] * 5) == (10.0, "Medium")
    assert score([]) == (10.0, "Low")


def test_tables_are_written(spark, pair, tmp_path):
    output = apply_scd2(*pair, ["id"], processing_date=DAY)
    sinks.write_scd2(output, str(tmp_path / "p"))
    back = load_snapshot(spark, str(tmp_path / "p"), format="parquet")
    assert rows(back, *output.columns) == rows(output)
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {
        "is_current=true", "is_current=false",
    }
    plan = back.filter("is_current")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan
    sinks.write_scd2(output, str(tmp_path / "c"), format="csv", sort_key=["id"])
    text = spark.read.csv(str(tmp_path / "c"), header=True, schema=output.schema)
    assert rows(text) == rows(output)


def test_validation_report(spark, history, tmp_path):
    df = history((1, "a", "2026-01-01", None, True), (1, "a", "2026-01-01", None, True),
                 (1, "a", "2026-01-01", None, True))
    sinks.write_validation(validate_scd2(df, ["id"]), str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    detail = ["  → Overlap detected for id=1", "Period A:", "2026-01-01 → NULL", "", "Period B:",
              "2026-01-01 → NULL"]
    assert lines == [
        "[PASS] schema_completeness: All required SCD2 columns present.",
        "[FAIL] one_current_per_key: 1 business key(s) have multiple current rows.",
        "  → Key id=1 has 3 current rows",
        "[PASS] no_null_keys: No null business keys found.",
        "[FAIL] no_overlapping_dates: Overlapping date ranges detected.",
        *detail,
        *detail,
        "[PASS] date_consistency: All date ranges are consistent (effective_from <= effective_to).",
    ]


def test_many_copies_become_many_lines(spark, frame):
    df = spark.range(25_000).selectExpr(
        "cast(1 as long) id", "date'2026-01-01' effective_from", "cast(null as date) effective_to",
        "false is_current",
    )
    lines = sinks.validation_lines(validate_scd2(df, ["id"]))
    assert lines.filter("rule_no = 4 and line_no = 1").count() == 24_999


def test_explanation_report(spark, pair, tmp_path):
    explanations = template_explanations(compare(*pair, ["id"]).changes(), ["id"])
    sinks.write_explanations(explanations, ["id"], str(tmp_path / "e"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert lines[:4] == ["[NEW] id=2", "  New record added for id=2.", "  Provider: template", ""]
    assert [x for x in lines if x.startswith("[")] == ["[NEW] id=2", "[CHANGED] id=1", "[DELETED] id=3"]
    sinks.write_explanations(explanations.limit(0), ["id"], str(tmp_path / "none"))
    assert [r.value for r in spark.read.text(str(tmp_path / "none")).collect()] == [
        "No changes to explain."
    ]


def test_reports_follow_the_order_of_both_sides(spark, history, tmp_path):
    source = spark.createDataFrame([(9, "a", 1), (2, "b", 2), (5, "c", 3)], "id long, name string, n int")
    target = history(*[(i, n, OLD, None, True) for i, n in [(7, "q"), (2, "x"), (3, "p"), (8, "r")]])
    for unique in (True, False):
        changes = detect_changes(
            source, target, ["id"], ["name"], unique=unique, order_by=["n"], target_order_by=["name"]
        )
        wanted = [9, 2, 5, 3, 7, 8]
        assert [r.id for r in in_report_order(changes, ["id"]).collect()] == wanted
        explanations = template_explanations(changes, ["id"])
        sinks.write_explanations(explanations, ["id"], str(tmp_path / f"o{unique}"))
        lines = [r.value for r in spark.read.text(str(tmp_path / f"o{unique}")).collect()]
        assert [int(x.split("=")[1]) for x in lines if x.startswith("[")] == wanted
        numbered = sinks.numbered_lines(explanations, ["id"]).orderBy("line_no").collect()
        assert [(r.line_no, r.id) for r in numbered] == list(enumerate(wanted))


def test_a_bucketed_history_is_not_shuffled(spark, snapshot, history):
    table = history((1, "x", OLD, None, True), (3, "g", OLD, None, True), (1, "w", "2026-01-01", OLD, False))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sinks.save_bucketed(table, "bucketed_history", ["id"], 4)
        stored = spark.table("bucketed_history").select(*table.columns)
        source = snapshot((1, "a"), (2, "b"))
        comparison = compare(source, stored, ["id"], unique=True, null_keys=False)
        plan = comparison.changes()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        output = apply_scd2(comparison, processing_date=DAY)
        assert output._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert rows(output) == rows(apply_scd2(source, table, ["id"], processing_date=DAY))
        repeated = apply_scd2(
            source, stored, ["id"], processing_date=DAY, unique=False, null_keys=False,
            order_by=["name"], target_order_by=["name"],
        )
        assert rows(repeated) == rows(output)
        with pytest.raises(Exception, match="against the promise"):
            compare(snapshot((None, "a")), stored, ["id"], unique=True, null_keys=False).changes().collect()
    finally:
        spark.sql("drop table if exists bucketed_history")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sentences_go_with_the_confidence(spark):
    for statuses, provider, start in (
        (["pass"] * 4 + ["fail"], "groq", "One or more"), (["pass"] * 5, "groq", "All 5"),
        (["pass"] * 4 + ["warn"], "gemini", "All deterministic"), (["pass"] * 4 + ["warn"], "template", "SCD2"),
        ([], "template", "Validation integrity"),
    ):
        rules = spark.createDataFrame([(s,) for s in statuses], "status string")
        assert metrics.explained_confidence(rules, provider).first().explanation.startswith(start)


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert (tmp_path / "audit").exists() is False
    for n, when in enumerate([(6, 9), (6, 8), (7, 1), (6, 9)]):
        audit.append_run(
            spark, path, source_name=f"s{n}", target_name=None, provider="template",
            counts={"new": n, "changed": 0, "unchanged": 0, "deleted": 0}, validation_passed=True,
            exec_time=1.234, timestamp=datetime.datetime(2026, *when, n),
        )
    found = audit.history(spark.read.parquet(path)).collect()
    assert [(r.run, r.source_name) for r in found] == [(4, "s2"), (3, "s3"), (2, "s0"), (1, "s1")]
    assert found[0].target_name == "—" and found[0].exec_time == 1.23


def test_generated_pairs(spark):
    source, target = make_pair(spark, 1000)
    assert (source.count(), target.count()) == (950, 1045)
    counts = summary(detect_changes(source, target, ["customer_id"])).first()
    assert (counts.new, counts.changed, counts.unchanged, counts.deleted) == (50, 90, 810, 50)
    output = apply_scd2(source, target, ["customer_id"], processing_date=DAY)
    assert output.count() == 1045 + 90 + 50 and validate_scd2(output, ["customer_id"]).passed()
    for kind, wanted in (("percent", (0, 100, 900, 0)), ("half_history", (0, 100, 900, 0))):
        source, target = make_pair(spark, 1000, kind)
        assert tuple(summary(detect_changes(source, target, ["id"])).first())[:4] == wanted
    with pytest.raises(ValueError):
        make_pair(spark, 10, "other")
