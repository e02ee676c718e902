import glob
import json
import os
import time
import uuid

import pytest
from conftest import rows

from sediment.operators import explain, metrics
from sediment.operators.diff import detect_changes
from sediment.operators.explain import explain_changes

KEY = ["id"]
OLD = "2026-06-07"
SENTENCES = [
    (1, "changed", "Record id=1 was updated: name changed from 'x' to 'a'. The previous version was"
     " closed and a new current record was created."),
    (2, "new", "New record added for id=2."),
    (3, "deleted", "Record id=3 is no longer present in the source. The current record was closed"
     " (soft delete)."),
    (5, "changed", "Record id=5 was updated: name changed from 'y' to 'None'. The previous version"
     " was closed and a new current record was created."),
]


@pytest.fixture
def changes(snapshot, history):
    target = history(*[(i, n, OLD, None, True) for i, n in [(1, "x"), (3, "g"), (4, "s"), (5, "y")]])
    return detect_changes(snapshot((1, "a"), (2, "b"), (4, "s"), (5, None)), target, KEY, unique=True)


def reply(*items):
    return json.dumps({"explanations": [{"id": i, "explanation": t} for i, t in items]})


def test_template(changes):
    found = explain_changes(changes, KEY)
    assert rows(found.explanations, "id", "change_type", "text") == SENTENCES
    used = found.usage.first()
    assert (used.provider, used.model, used.total_tokens, used.estimated_cost, used.fallback_count) == (
        "template", "local-templates", 0, 0.0, 0,
    )
    assert used.changes_explained == 4 and not used.is_estimated and found.warnings.isEmpty()


def test_unchanged_is_never_explained(snapshot, history):
    same = detect_changes(snapshot((1, "a")), history((1, "a", OLD, None, True)), KEY, unique=True)
    assert explain_changes(same, KEY).explanations.isEmpty()
    found = explain_changes(same, KEY, lambda p: reply((0, "x")), provider="groq")
    assert found.explanations.isEmpty() and found.usage.first().batches == 0


def test_groups_by_type(changes):
    groups = explain.by_type(explain.template_explanations(changes, KEY)).collect()
    assert [tuple(g) for g in groups] == [("NEW", 1), ("CHANGED", 2), ("DELETED", 1)]


def test_batch_prompt(changes):
    prompt = explain.batch_prompts(changes, KEY, reply_format=False).first().prompt
    head, *records = prompt.split("--- Record ID: ")
    assert head == "\n".join(
        [explain.ROLE, explain.BATCH_TASK, explain.NO_MARKDOWN, "", explain.BATCH_RECORDS, ""]
    )
    assert records == [
        "0 ---\nBusiness key: id=2\nChange type: new\n\n",
        "1 ---\nBusiness key: id=1\nChange type: changed\nField changes:\n  - name: 'x' → 'a'\n\n",
        "2 ---\nBusiness key: id=5\nChange type: changed\nField changes:\n  - name: 'y' → 'None'\n\n",
        "3 ---\nBusiness key: id=3\nChange type: deleted\n",
    ]


def test_batches_have_a_size(changes):
    batches = explain.batch_prompts(changes, KEY, size=3)
    sizes = [[r.record_id for r in b.records] for b in batches.orderBy("batch").collect()]
    assert sizes == [[0, 1, 2], [0]]


def test_single_prompt(changes):
    prompts = {r.prompt for r in explain.single_prompts(changes, KEY).collect()}
    assert (
        f"{explain.ROLE}\n{explain.ONE_RECORD_TASK}\n\nRecord: id=1\nChange type: changed\n"
        f"Field changes:\n  - name: 'x' → 'a'\n\n{explain.ONE_RECORD_CLOSE}"
    ) in prompts
    short = {r.prompt for r in explain.single_prompts(changes, KEY, short=True).collect()}
    assert f"Record: id=2\nChange type: new\n\n{explain.ONE_RECORD_SHORT_CLOSE}" in short


def test_function_with_gaps(changes, tmp_path):
    log = tmp_path / "calls"

    def answer(prompt):
        with open(log, "a") as f:
            f.write("call\n")
        return reply((0, "first"), (1, ""), (2, "old"), (2, "last"), (99, "nobody"))

    found = explain_changes(changes, KEY, answer, provider="groq")
    assert rows(found.explanations, "id", "text", "provider") == sorted(
        [(2, "first", "groq"), (1, SENTENCES[0][2], "template"), (5, "last", "groq"),
         (3, SENTENCES[2][2], "template")]
    )
    used = found.usage.first()
    prompt = explain.batch_prompts(changes, KEY).first().prompt
    tokens = len(prompt) // 4, len(answer("")) // 4
    assert (used.prompt_tokens, used.completion_tokens) == tokens and used.is_estimated
    assert used.estimated_cost == pytest.approx((tokens[0] * 0.59 + tokens[1] * 0.79) / 1e6)
    assert used.avg_tokens_per_change == sum(tokens) / 4 and used.fallback_count == 2
    assert found.warnings.first().warning == (
        "⚠️ Groq API fell back to template for 2 explanation(s) due to missing items in the response."
    )
    assert log.read_text().count("call") == 2  # one batch, called once, plus the call above


def test_failed_function(changes):
    def fail(prompt):
        raise RuntimeError("down")

    found = explain_changes(changes, KEY, fail, provider="gemini")
    assert rows(found.explanations, "id", "change_type", "text") == SENTENCES
    assert {r.provider for r in found.explanations.collect()} == {"template"}
    used = found.usage.first()
    assert (used.failed_batches, used.total_tokens, used.estimated_cost) == (1, 0, 0.0)
    assert found.batches.first().error == "RuntimeError: down"
    assert found.warnings.first().warning == (
        "⚠️ Gemini API failed: RuntimeError: down. Fell back to template."
    )
    assert found.provider_used() == "template"


def test_some_failed_calls_are_counted_with_an_error(changes):
    def fail_new(prompt):
        if "Change type: new" in prompt:
            raise RuntimeError("down")
        return reply((0, "fine"))

    found = explain_changes(changes, KEY, fail_new, provider="groq", model="m1", size=1)
    assert found.warnings.first().warning == (
        "⚠️ Groq API failed: RuntimeError: down (1 batch(es)). Fell back to template."
    )
    assert found.provider_used() == "groq" and found.usage.first().model == "m1"
    assert {(r.id, r.provider) for r in found.explanations.collect()} == {
        (1, "groq (m1)"), (2, "template"), (3, "groq (m1)"), (5, "groq (m1)")
    }
    own = explain_changes(changes, KEY, lambda p: reply((0, "x")), provider="groq", label="desk", size=1)
    assert {r.provider for r in own.explanations.collect()} == {"desk"}
    used = own.usage.first()
    assert used.estimated_cost > 0  # the price goes by provider, whatever the label


def calls_of(folder):
    return sorted(f.read_text() for f in folder.iterdir())


def test_answers_are_asked_for_once_over_runs_that_fail(spark, history, tmp_path):
    """A worker dies on its first call for one key; the next run resumes from what was stored."""
    source = spark.range(12).selectExpr("id", "'n' name")
    changes = detect_changes(source, history(), KEY, unique=True)
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()

    def answer(prompt):
        key = prompt.split("Business key: id=")[1].split("\n")[0]
        (calls / uuid.uuid4().hex).write_text(key)
        if key == "7" and calls_of(calls).count("7") == 1:
            for _ in range(600):  # until other tasks have stored their answers
                if len(glob.glob(f"{answers}/*.parquet")) >= 3:
                    break
                time.sleep(0.1)
            os._exit(1)
        return reply((0, f"told {key}"))

    options = {"size": 1, "unique": True, "answers": answers, "calls_per_task": 1, "provider": "groq"}
    with pytest.raises(Exception, match="crashed|worker"):
        explain_changes(changes, KEY, answer, **options).explanations.collect()
    stored = spark.read.parquet(answers).count()
    before = calls_of(calls)
    assert stored > 0
    found = explain_changes(changes, KEY, answer, **options)
    assert {(r.id, r.text) for r in found.explanations.collect()} == {(i, f"told {i}") for i in range(12)}
    again = calls_of(calls)
    assert len(again) - len(before) == 12 - stored
    explain_changes(changes, KEY, answer, **options).explanations.collect()
    assert calls_of(calls) == again
    # Another model is another question, and calls that raised are asked again.
    explain_changes(changes, KEY, answer, model="m2", **options)
    assert len(calls_of(calls)) == len(again) + 12


def test_failed_calls_are_asked_again_and_equal_prompts_once(spark, tmp_path):
    batches = spark.range(6).selectExpr("0 bucket", "id batch", "concat('p', id % 2) prompt", "array(id) records")
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()

    def answer(prompt):
        (calls / uuid.uuid4().hex).write_text(prompt)
        if prompt == "p1" and calls_of(calls).count("p1") == 1:
            raise RuntimeError("busy")
        return prompt.upper()

    found = explain.ask_once(batches, answer, answers)
    assert rows(found, "batch", "response", "error")[:2] == [(0, "P0", None), (1, None, "RuntimeError: busy")]
    again = explain.ask_once(batches, answer, answers)
    assert rows(again, "batch", "response") == [(i, f"P{i % 2}") for i in range(6)]
    assert calls_of(calls) == ["p0", "p1", "p1"]
    assert explain.ask_once(batches.limit(0), answer, str(tmp_path / "none")).collect() == []


def test_responses_that_are_not_as_asked(changes):
    for text in ("not json", "", "{}", '{"explanations": [{"explanation": "no id"}]}',
                 '{"explanations": "x"}', "[]"):
        found = explain_changes(changes, KEY, lambda p, text=text: text, provider="groq")
        assert rows(found.explanations, "id", "change_type", "text") == SENTENCES, text


def test_exact_token_counts(changes):
    found = explain_changes(changes, KEY, lambda p: (reply((0, "x")), 1000, 500), provider="gemini")
    used = found.usage.first()
    assert (used.prompt_tokens, used.completion_tokens, used.is_estimated) == (1000, 500, False)
    assert used.estimated_cost == pytest.approx((1000 * 0.075 + 500 * 0.30) / 1e6)


def test_one_call_per_record(changes):
    found = explain_changes(changes, KEY, lambda p: p.split("Record: ")[1].split("\n")[0], single=True)
    assert rows(found.explanations, "id", "text") == [(i, f"id={i}") for i in (1, 2, 3, 5)]
    assert found.usage.first().batches == 4


@pytest.mark.parametrize("buckets", [None, 1, 4])
def test_copies_of_a_record_are_all_explained(spark, history, buckets):
    source = spark.range(2500).selectExpr("cast(1 as long) id", "'n' name", "1 as n").unionByName(
        spark.range(5).selectExpr("id + 10 as id", "'m' name", "1 as n")
    )
    changes = detect_changes(
        source, history(), KEY, ["name"], unique=False, order_by=["n"], target_order_by=["name"]
    )
    batches = explain.batch_prompts(changes, KEY, size=100, buckets=buckets)
    merged = explain.merge(batches.selectExpr("*", "cast(null as string) response"), KEY, "groq")
    assert rows(merged.groupBy("id").count()) == [(1, 2500), *[(i, 1) for i in range(10, 15)]]
    assert max(len(b.records) for b in batches.collect()) <= 100
    if buckets == 4:
        assert batches.select("bucket").distinct().count() > 1


def test_records_are_numbered_through_reports_of_any_size(spark):
    source = spark.range(0, 12_000, numPartitions=5).selectExpr("(id * 7919) % 12000 as id", "'n' name")
    changes = detect_changes(source, source.limit(0).selectExpr(
        "id", "name", "true is_current", "current_date() effective_from", "current_date() effective_to"
    ), KEY, ["name"], unique=True)
    for size, unique in [(50, True), (50, False), (70, True)]:
        batches = explain.batch_prompts(changes, KEY, size=size, unique=unique)
        found = batches.selectExpr("bucket", "batch", "posexplode(records) as (at, r)").collect()
        assert {r.bucket for r in found} == {0}
        assert sorted(r.r.key.id for r in found) == list(range(12_000))
        assert all(r.r.key.id == r.batch * size + r.at and r.r.record_id == r.at for r in found)


def test_calls_can_be_spread(changes):
    batches = explain.batch_prompts(changes, KEY, size=1)
    called = explain.with_callable(batches, lambda p: reply((0, "x")), tasks=3)
    assert called.rdd.getNumPartitions() == 3 and called.count() == 4


def test_efficiency_badges(spark):
    df = spark.sql(
        "select * from values (10d,'template'),(150d,'groq'),(151d,'groq'),(350d,'groq'),(750d,'groq'),"
        "(751d,'groq') as t(avg, provider)"
    )
    badges = [r[0] for r in df.select(metrics.efficiency(df.avg, df.provider)).collect()]
    assert badges == ["Offline", "Excellent", "Good", "Good", "Moderate", "Expensive"]
