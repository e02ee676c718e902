"""A whole run: read, check, compare, apply, validate, explain."""

from __future__ import annotations

import datetime
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from sediment.functions.columns import IS_CURRENT
from sediment.operators.apply import apply_scd2
from sediment.operators.diff import Comparison, compare, summary
from sediment.operators.explain import Explained, explain_changes
from sediment.operators.validate import RULES, Validation, validate_scd2
from sediment.plans.materialize import Kept
from sediment.sources.audit import append_run
from sediment.sources.ingest import align_empty, load_snapshot
from sediment.sources.schema import detect_business_key, detect_tracked, require_compatible
from sediment.sources.sinks import write_scd2
from sediment.sources.store import HistoryStore


@dataclass(frozen=True)
class RunResult:
    """What a run gave: frames stay lazy, ``counts`` and ``verdicts`` are a few numbers.

    Frames read tables that the run kept. ``close`` removes those once no frame is needed
    any more; what was written to the paths given stays.
    """

    key: list[str]
    tracked: list[str]
    processing_date: datetime.date
    comparison: Comparison
    changes: DataFrame
    output: DataFrame
    validation: Validation
    explained: Explained
    counts: dict[str, int]
    verdicts: dict[str, str]
    passed: bool
    dropped_rows: int
    rows_inspected: int
    overlaps_found: int
    provider_used: str
    seconds: float
    kept: Kept

    def close(self) -> None:
        self.kept.close()

    def __enter__(self) -> RunResult:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def run_scd2(
    spark: SparkSession,
    source: str | DataFrame,
    target: str | DataFrame | HistoryStore,
    processing_date: datetime.date | None = None,
    key: list[str] | None = None,
    *,
    output_path: str | None = None,
    audit_path: str | None = None,
    explain: Callable | None = None,
    provider: str = "custom",
    model: str | None = None,
    prices: tuple[float, float] | None = None,
    answers: str | None = None,
    batch_size: int = 50,
    extras: bool = False,
    folder: str | None = None,
    format: str = "csv",
    source_schema: T.StructType | str | None = None,
    target_schema: T.StructType | str | None = None,
    multi_line: bool = True,
    delete_policy: str = "soft_delete",
    null_flags: str = "drop",
    **options,
) -> RunResult:
    """Run all steps on two files or frames. A failed rule does not stop the run.

    The comparison is computed once and kept (see ``Kept``); the summary, the new table and
    the explanations are read off it without a second join. With ``output_path`` the table
    is written there and validated as written. A ``HistoryStore`` as target is read as it
    was before the processing date, and gets the difference. Row counts are observed in the
    jobs that write and validate. ``answers`` names the table of a function's answers, which
    a repeated run does not ask for again. Schemas and ``multi_line`` are those of
    ``load_snapshot``.
    """
    start = time.perf_counter()
    day = processing_date or datetime.date.today()
    names = [os.path.basename(p) if isinstance(p, str) else None for p in (source, target)]
    store = target if isinstance(target, HistoryStore) else None
    if store:
        target = store.before(day)

    def loaded(side, schema):
        if not isinstance(side, str):
            return side
        return load_snapshot(
            spark, side, schema, format=format, keep_order=True, multi_line=multi_line
        )

    source, target = loaded(source, source_schema), loaded(target, target_schema)
    require_compatible(source, target)
    source, target = align_empty(source, target)
    key = list(key) if key else store.key if store else detect_business_key(source, target)
    tracked = detect_tracked(source, key)

    kept = Kept()
    comparison = compare(source, target, key, tracked, **options).materialized(folder, kept)
    changes = comparison.changes()
    counts = summary(changes).first().asDict()
    dropped, inspected = Observation(), Observation()
    # Rows without a flag never enter a store.
    counted = null_flags == "drop" and IS_CURRENT in target.columns and not store
    if store:
        store.write(comparison, day, delete_policy, folder)
        output = store.read()
    else:
        output = apply_scd2(
            comparison, processing_date=day, delete_policy=delete_policy, null_flags=null_flags,
            observation=dropped if counted else None,
        )
    if output_path:
        write_scd2(output, output_path)
        output = spark.read.schema(output.schema).parquet(output_path)
    validation = validate_scd2(output, key, extras=extras, observation=inspected)
    verdict_rows = validation.rules.collect()  # one row per rule
    verdicts = {r["rule"]: r["status"] for r in verdict_rows}
    overlaps = next(r["violation_count"] for r in verdict_rows if r["rule"] == RULES[3])

    explained = explain_changes(
        changes, key, explain, provider=provider, model=model, prices=prices, size=batch_size,
        answers=answers, unique=comparison.unique, folder=folder, kept=kept,
    )
    used = explained.provider_used()
    passed = "fail" not in verdicts.values()
    seconds = time.perf_counter() - start
    if audit_path:
        append_run(
            spark, audit_path, source_name=names[0], target_name=names[1],
            provider=used, counts=counts, validation_passed=passed, exec_time=seconds,
        )
    return RunResult(
        key, tracked, day, comparison, changes, output, validation, explained, counts, verdicts,
        passed, dropped.get["dropped"] if counted else 0, inspected.get["rows"], overlaps, used,
        seconds, kept,
    )
