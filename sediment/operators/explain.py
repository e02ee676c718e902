"""Sentences about changes: from a template, or from a user's function over prompts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.columns import CHANGED, DELETED, NEW, ORDERS, ROW_ORDER, UNCHANGED
from sediment.functions.text import key_label
from sediment.plans.materialize import Kept, exists, materialize, working_folder

TEMPLATE = "template"

# Prices in dollars per million tokens (prompt, completion).
PRICES = {"gemini": (0.075, 0.30), "groq": (0.59, 0.79)}

# The wording of prompts.
ROLE = (
    "You are a data engineering assistant explaining SCD2 "
    "(Slowly Changing Dimension Type 2) changes."
)
ONE_RECORD_TASK = "Explain the following change in one or two clear sentences for a business user."
ONE_RECORD_CLOSE = "Write a clear, concise explanation. Do not use markdown."
ONE_RECORD_SHORT_CLOSE = "Explain this SCD2 change in one or two clear sentences."
BATCH_TASK = (
    "For each of the input records, generate a clear, concise explanation of the SCD2 "
    "changes in one or two sentences for a business user."
)
NO_MARKDOWN = "Do not use markdown."
BATCH_RECORDS = "Input records to explain:"
REPLY_FORMAT = (
    "\n\nReturn the output ONLY as a JSON object containing a key 'explanations' which is a "
    "list of objects. Each object must have 'id' (the integer Record ID) and 'explanation' "
    "(the clear, concise 1-2 sentence explanation of the changes). Example format:\n"
    '{\n  "explanations": [\n    {"id": 0, "explanation": "..."}\n  ]\n}'
)


def to_explain(changes: DataFrame) -> DataFrame:
    """All records but the unchanged ones."""
    return changes.filter(F.col("change_type") != UNCHANGED)


def _section() -> Column:
    kind = F.col("change_type")
    return F.when(kind == NEW, 0).when(kind == CHANGED, 1).when(kind == DELETED, 2).otherwise(3)


def _or_none(col: Column) -> Column:
    return F.coalesce(col, F.lit("None"))


def template_text(key: list[str], schema: T.StructType) -> Column:
    """One sentence about a change record."""
    label = key_label(key, schema)
    fields = F.array_join(
        F.transform(
            "field_changes",
            lambda f: F.concat(
                f["column"], F.lit(" changed from '"), _or_none(f["old_value"]),
                F.lit("' to '"), _or_none(f["new_value"]), F.lit("'"),
            ),
        ),
        "; ",
    )
    kind = F.col("change_type")
    # The wording of the sentences.
    return (
        F.when(kind == NEW, F.concat(F.lit("New record added for "), label, F.lit(".")))
        .when(
            kind == CHANGED,
            F.concat(
                F.lit("Record "), label, F.lit(" was updated: "), fields,
                F.lit(". The previous version was closed and a new current record was created."),
            ),
        )
        .when(
            kind == DELETED,
            F.concat(
                F.lit("Record "), label,
                F.lit(" is no longer present in the source. "
                      "The current record was closed (soft delete)."),
            ),
        )
        .otherwise(
            F.concat(F.lit("Record "), label, F.lit(" has no changes. Carried forward as-is."))
        )
    )


def template_explanations(changes: DataFrame, key: list[str]) -> DataFrame:
    """Key, ``change_type``, ``text``, ``provider`` for every record to explain.

    Records that carry their position in the report keep it.
    """
    return to_explain(changes).select(
        *[f"`{k}`" for k in key],
        "change_type",
        template_text(key, changes.schema).alias("text"),
        F.lit(TEMPLATE).alias("provider"),
        *_positions(changes.schema),
    )


def _positions(schema: T.StructType) -> list[str]:
    return [c for c in ORDERS if c in schema.names]


def by_type(explanations: DataFrame) -> DataFrame:
    """Number of explanations per change type, in report order."""
    return (
        explanations.groupBy("change_type")
        .agg(F.count(F.lit(1)).alias("explanations"))
        .orderBy(_section())
        .select(F.upper("change_type").alias("change_type"), "explanations")
    )


def _field_lines() -> Column:
    """The lines about changed fields, each after a line break; empty for other records."""
    lines = F.array_join(
        F.transform(
            "field_changes",
            lambda f: F.concat(
                F.lit("  - "), f["column"], F.lit(": '"), _or_none(f["old_value"]),
                F.lit("' → '"), _or_none(f["new_value"]), F.lit("'"),
            ),
        ),
        "\n",
    )
    has_fields = (F.col("change_type") == CHANGED) & (F.size("field_changes") > 0)
    return F.when(has_fields, F.concat(F.lit("\nField changes:\n"), lines)).otherwise("")


def prompt(key: list[str], schema: T.StructType, short: bool = False) -> Column:
    """Prompt about one record; the short form leaves out the role."""
    start = "" if short else f"{ROLE}\n{ONE_RECORD_TASK}\n\n"
    close = ONE_RECORD_SHORT_CLOSE if short else ONE_RECORD_CLOSE
    return F.concat(
        F.lit(f"{start}Record: "), key_label(key, schema),
        F.lit("\nChange type: "), "change_type", _field_lines(), F.lit(f"\n\n{close}"),
    )


def _record(key: list[str], schema: T.StructType, record_id: Column) -> Column:
    return F.struct(
        record_id.cast("int").alias("record_id"),
        F.struct(*[F.col(f"`{k}`") for k in key]).alias("key"),
        F.col("change_type"),
        template_text(key, schema).alias("template"),
        *_positions(schema),
    )


def _chunks_of_copies(records: DataFrame) -> DataFrame:
    """Equal records as one row per thousand copies: ``__chunk`` and ``__copies`` in it."""
    chunk = 1000
    counted = records.groupBy(*[f"`{c}`" for c in records.columns]).agg(
        F.count(F.lit(1)).alias("__n")
    )
    last = F.floor((F.col("__n") - 1) / chunk)
    return counted.withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))
    ).withColumn("__copies", F.least(F.col("__n") - F.col("__chunk") * chunk, F.lit(chunk)))


def through_report(
    records: DataFrame, order: list[Column], unique: bool = True, folder: str | None = None,
    kept: Kept | None = None,
) -> DataFrame:
    """``__position`` of each record in the order of all of them.

    Each range of the order is numbered by itself, from where the ranges before it end.
    """
    if unique:
        records = records.withColumn("__copies", F.lit(1).cast("long"))
    else:
        distinct = F.xxhash64(*[f"`{c}`" for c in records.columns])
        records, order = _chunks_of_copies(records), [*order, distinct, F.col("__chunk")]
    dealt = materialize(
        records.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), folder, kept
    )
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = (
        dealt.groupBy("__range").agg(F.sum("__copies").alias("__size"))
        .select("__range", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    )
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__copies").over(within), F.lit(0)) + F.col("__start")
    copies = F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)
    return (
        dealt.join(starts, "__range").withColumn("__first", first)
        .withColumn("__copy", F.explode(copies))
        .withColumn("__position", F.col("__first") + F.col("__copy"))
    )


def _within_buckets(
    records: DataFrame, order: list[Column], buckets: int | Column, spread: list[str], unique: bool
) -> DataFrame:
    """``__bucket`` and, from 0 in each, ``__position``."""
    if isinstance(buckets, int):
        spread = [f"`{c}`" for c in dict.fromkeys(spread)]
        if not unique and buckets > 1:
            records = _chunks_of_copies(records)
            spread.append("__chunk")
        buckets = F.pmod(F.xxhash64(*spread), F.lit(buckets)) if buckets > 1 else F.lit(0)
    records = records.select("*", buckets.alias("__bucket"))
    if "__chunk" in records.columns:
        records = records.withColumn(
            "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
        )
    return records.withColumn(
        "__position", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    )


def single_prompts(changes: DataFrame, key: list[str], short: bool = False) -> DataFrame:
    """One prompt per record, in the layout of ``batch_prompts``.

    ``bucket`` and ``batch`` are two hashes of the record.
    """
    schema = changes.schema
    order = [ROW_ORDER] if ROW_ORDER in changes.columns else []
    record = [*[f"`{k}`" for k in key], "change_type", *order]
    return to_explain(changes).select(
        F.xxhash64(F.lit("bucket"), *record).alias("bucket"),
        F.xxhash64(*record).alias("batch"),
        prompt(key, schema, short).alias("prompt"),
        F.array(_record(key, schema, F.lit(0))).alias("records"),
    )


def batch_prompts(
    changes: DataFrame,
    key: list[str],
    size: int = 50,
    buckets: int | Column | None = None,
    order_by: list[str] | None = None,
    reply_format: bool = True,
    unique: bool = False,
    folder: str | None = None,
    kept: Kept | None = None,
) -> DataFrame:
    """Prompts of at most ``size`` records: ``bucket``, ``batch``, ``prompt``, ``records``.

    Records are numbered through the whole report, whatever its size; they are dealt by
    ranges of its order for that and kept (in ``folder``, or the session's). With
    ``buckets``, the number of buckets (by hash of the record) or an expression, each
    bucket is numbered by itself instead, and one task sorts it. ``unique`` says that no
    key has two records; otherwise equal records are counted first, so that copies spread
    too, at the cost of one more shuffle.
    """
    schema = changes.schema
    records = to_explain(changes)
    order = order_by or ([ROW_ORDER] if ROW_ORDER in changes.columns else key)
    in_order = [_section(), *[F.col(f"`{c}`") for c in dict.fromkeys([*order, *key])]]
    if buckets is None:
        numbered = through_report(records, in_order, unique, folder, kept).withColumn("__bucket", F.lit(0))
    else:
        numbered = _within_buckets(records, in_order, buckets, [*key, "change_type", *order], unique)
    record_id = F.col("__position") % size
    line = F.concat(
        F.lit("--- Record ID: "), record_id.cast("string"), F.lit(" ---\nBusiness key: "),
        key_label(key, schema), F.lit("\nChange type: "), "change_type", _field_lines(), F.lit("\n"),
    )
    batches = (
        numbered.select(
            F.col("__bucket").alias("bucket"),
            F.floor(F.col("__position") / size).alias("batch"),
            F.struct(
                record_id.alias("record_id"),
                line.alias("line"),
                _record(key, schema, record_id).alias("record"),
            ).alias("item"),
        )
        .groupBy("bucket", "batch")
        .agg(F.collect_list("item").alias("items"))
    )
    # Keys may be of a type without an order, record ids are not: sort by id alone.
    ordered = F.array_sort(
        "items", lambda a, b: a["record_id"].cast("int") - b["record_id"].cast("int")
    )
    header = "\n".join([ROLE, BATCH_TASK, NO_MARKDOWN, "", BATCH_RECORDS, ""])
    return batches.withColumn("items", ordered).select(
        "bucket",
        "batch",
        F.concat(
            F.lit(header),
            F.array_join(F.transform("items", lambda i: i["line"]), "\n"),
            F.lit(REPLY_FORMAT if reply_format else ""),
        ).alias("prompt"),
        F.transform("items", lambda i: i["record"]).alias("records"),
    )


_ANSWER = "response string, error string, prompt_tokens long, completion_tokens long, seconds double"


def with_callable(batches: DataFrame, explain: Callable, tasks: int | None = None) -> DataFrame:
    """Call ``explain(prompt)`` once per prompt, on the executors.

    It returns the response, or ``(response, prompt tokens, completion tokens)``. A call
    that raises leaves a null ``response`` and the error. Prompts alone go to Python.
    The calls of a task follow each other; ``tasks`` spreads slow ones over that many.
    The result is not kept: ``materialize`` it before using it twice.
    """
    if tasks:
        batches = batches.repartition(tasks, "bucket", "batch")

    def answer(text):
        start = time.perf_counter()
        try:
            reply = explain(text)
            if not isinstance(reply, tuple):
                reply = (reply, None, None)
            return (reply[0], None, reply[1], reply[2], time.perf_counter() - start)
        except Exception as e:
            return (None, f"{type(e).__name__}: {e}", None, None, time.perf_counter() - start)

    @F.pandas_udf(_ANSWER)
    def call(prompts: pd.Series) -> pd.DataFrame:
        columns = ["response", "error", "prompt_tokens", "completion_tokens", "seconds"]
        answers = pd.DataFrame([answer(p) for p in prompts], columns=columns)
        tokens = {"prompt_tokens": "Int64", "completion_tokens": "Int64"}
        return answers.astype({**tokens, "seconds": "float64"})

    called = call.asNondeterministic()(F.col("prompt"))
    return batches.withColumn("answer", called).select(*batches.columns, "answer.*")


_ASKED = f"digest string, {_ANSWER}"


def ask_once(
    batches: DataFrame, explain: Callable, answers: str, *, label: str = "", calls_per_task: int = 10,
    kept: Kept | None = None,
) -> DataFrame:
    """``with_callable``, with answers that are stored under ``answers`` and not asked for again.

    Answers are found by a digest of ``label`` (say, the model) and the prompt. Only prompts
    without a stored response are asked, equal ones once. Each task asks ``calls_per_task``
    prompts and stores its answers when it ends, whatever becomes of the job: a task that
    fails repeats its own calls, and a job run again those of tasks that had not ended.
    Calls that raised are asked again by the next run.
    """
    spark = batches.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{label}\n"), F.col("prompt")), 256)
    asked = batches.withColumn("digest", digest)
    wanted = asked.select("digest", "prompt").dropDuplicates(["digest"])
    if exists(spark, answers):
        stored = spark.read.schema(_ASKED).parquet(answers).filter("response is not null")
        wanted = wanted.join(stored.select("digest"), "digest", "left_anti")
    wanted = materialize(wanted, working_folder(spark), kept)
    tasks = -(-wanted.count() // calls_per_task)
    if tasks:
        calls = wanted.repartitionByRange(tasks, "digest").select("digest", "prompt")
        found = with_callable(calls, explain).drop("prompt")
        # The second algorithm leaves the files of a task that has ended, also if the job fails.
        found.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(answers)
    stored = spark.read.schema(_ASKED).parquet(answers) if exists(spark, answers) else spark.createDataFrame([], _ASKED)
    fields = [c for c in stored.columns if c != "digest"]
    best = F.max_by(F.struct(*fields), F.struct(F.col("response").isNotNull(), F.xxhash64(*fields)))
    known = stored.groupBy("digest").agg(best.alias("answer"))
    return asked.join(known, "digest", "left").select(*batches.columns, "answer.*")


def parse_responses(response: Column) -> Column:
    """Items of ``{"explanations": [{"id", "explanation"}]}``; null if it is not JSON."""
    reply = F.from_json(
        response, "struct<explanations:array<struct<id:int,explanation:string>>>"
    )
    items = F.coalesce(
        reply["explanations"], F.array().cast("array<struct<id:int,explanation:string>>")
    )
    return F.when(F.get_json_object(response, "$").isNotNull(), items)


def merge(
    batches: DataFrame, key: list[str], provider: str, responses: DataFrame | None = None,
    json: bool = True,
) -> DataFrame:
    """Explanations of all records; those without a text in the response get the template.

    ``batches`` carries a ``response`` column, or ``responses`` gives it per ``bucket``
    and ``batch``; a batch without one failed. ``provider`` is what explanations are
    labelled with. Of several texts for a record the last counts. ``json=False`` takes a response as the text of a single record.
    """
    if responses is not None:
        responses = responses.dropDuplicates(["bucket", "batch"])
        batches = batches.join(responses, ["bucket", "batch"], "left")
    items = parse_responses(F.col("response"))
    if not json:
        items = F.when(
            F.col("response").isNotNull(),
            F.array(F.struct(F.lit(0).alias("id"), F.col("response").alias("explanation"))),
        )
    records = batches.select(items.alias("items"), F.explode("records").alias("r"))
    mine = F.filter("items", lambda i: i["id"] == F.col("r.record_id"))
    text = F.get(mine, F.size(mine) - 1)["explanation"]
    found = records.select("r", F.when(text != "", text).alias("text"))
    positions = _positions(found.schema["r"].dataType)
    return found.select(
        *[F.col("r.key")[k].alias(k) for k in key],
        "r.change_type",
        F.coalesce("text", "r.template").alias("text"),
        F.when(F.col("text").isNull(), TEMPLATE).otherwise(provider).alias("provider"),
        *[f"r.{c}" for c in positions],
    )


def usage(
    batches: DataFrame, provider: str, model: str | None = None,
    prices: tuple[float, float] | None = None, by: list[str] | None = None, json: bool = True,
) -> DataFrame:
    """Tokens, cost and fallbacks over all batches, or per segment of them.

    Token counts that the response did not give are estimated at four characters a
    token. Failed batches cost nothing. The template costs nothing at all. ``provider``
    also names the price unless ``prices`` are given; ``error`` is one of the errors.
    """
    prompt_price, completion_price = prices or PRICES.get(provider, (0.0, 0.0))
    records = F.size("records")
    if provider == TEMPLATE:
        ok, answered, tokens_in, tokens_out, estimated = (
            F.lit(True), records, F.lit(0), F.lit(0), F.lit(False),
        )
    else:
        items = parse_responses(F.col("response"))
        ok = items.isNotNull() if json else F.col("response").isNotNull()
        answered = F.when(F.col("response") != "", 1).otherwise(0)
        if json:
            ids = F.transform(
                F.filter(items, lambda i: i["explanation"] != ""), lambda i: i["id"]
            )
            asked = F.transform("records", lambda r: r["record_id"])
            answered = F.coalesce(F.size(F.array_intersect(asked, ids)), F.lit(0))
            answered = F.when(ok, answered).otherwise(0)

        def tokens(given, text):
            guess = F.greatest(F.lit(1), F.floor(F.length(text) / 4))
            return F.coalesce(F.col(given), guess) if given in batches.columns else guess

        tokens_in = tokens("prompt_tokens", "prompt")
        tokens_out = tokens("completion_tokens", "response")
        estimated = F.lit(True)
        if "prompt_tokens" in batches.columns:
            estimated = F.col("prompt_tokens").isNull()
    per_batch = batches.select(
        *(by or []),
        ok.alias("ok"),
        F.when(ok, tokens_in).otherwise(0).cast("long").alias("tokens_in"),
        F.when(ok, tokens_out).otherwise(0).cast("long").alias("tokens_out"),
        (ok & estimated).alias("estimated"),
        records.cast("long").alias("records"),
        answered.cast("long").alias("answered"),
        (F.col("seconds") if "seconds" in batches.columns else F.lit(0.0)).alias("seconds"),
        (F.col("error") if "error" in batches.columns else F.lit(None).cast("string")).alias("error"),
    )

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0).cast("long"))

    counted = per_batch.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("batches"),
        F.count_if(~F.col("ok")).alias("failed_batches"),
        total("tokens_in").alias("prompt_tokens"),
        total("tokens_out").alias("completion_tokens"),
        total("records").alias("changes_explained"),
        (total("records") - total("answered")).alias("fallback_count"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("request_seconds"),
        F.coalesce(F.max("estimated"), F.lit(False)).alias("is_estimated"),
        F.min(F.when(~F.col("ok"), F.col("error"))).alias("error"),
    )
    spent = F.col("prompt_tokens") + F.col("completion_tokens")
    return counted.select(
        *(by or []),
        F.lit(provider).alias("provider"),
        F.lit(model or ("local-templates" if provider == TEMPLATE else "")).alias("model"),
        "batches",
        "failed_batches",
        "prompt_tokens",
        "completion_tokens",
        spent.alias("total_tokens"),
        (
            (F.col("prompt_tokens") * F.lit(prompt_price)
             + F.col("completion_tokens") * F.lit(completion_price)) / F.lit(1e6)
        ).alias("estimated_cost"),
        "request_seconds",
        "changes_explained",
        F.when(F.col("changes_explained") > 0, spent / F.col("changes_explained"))
        .otherwise(0.0)
        .alias("avg_tokens_per_change"),
        "fallback_count",
        "is_estimated",
        "error",
    )


def warnings(used: DataFrame) -> DataFrame:
    """A line for every ``usage`` row that had fallbacks or failed batches."""
    name = F.initcap("provider")
    # The wording of the warnings.
    gaps = F.concat(
        F.lit("⚠️ "), name, F.lit(" API fell back to template for "), "fallback_count",
        F.lit(" explanation(s) due to missing items in the response."),
    )
    batches = F.concat(F.col("failed_batches").cast("string"), F.lit(" batch(es)"))
    some = F.col("failed_batches") < F.col("batches")
    reason = (
        F.when(F.col("error").isNull(), batches)
        .when(some, F.concat("error", F.lit(" ("), batches, F.lit(")")))
        .otherwise(F.col("error"))
    )
    failed = F.concat(
        F.lit("⚠️ "), name, F.lit(" API failed: "), reason, F.lit(". Fell back to template."),
    )
    return (
        used.filter(F.col("provider") != TEMPLATE)
        .select(
            F.when(F.col("failed_batches") > 0, failed)
            .when(F.col("fallback_count") > 0, gaps)
            .alias("warning")
        )
        .filter(F.col("warning").isNotNull())
    )


@dataclass(frozen=True)
class Explained:
    """``provider`` names the price, ``label`` is what explanations are labelled with."""

    explanations: DataFrame
    batches: DataFrame
    provider: str
    model: str | None = None
    prices: tuple[float, float] | None = None
    json: bool = True
    label: str | None = None

    @cached_property
    def usage(self) -> DataFrame:
        return usage(self.batches, self.provider, self.model, self.prices, json=self.json)

    @cached_property
    def warnings(self) -> DataFrame:
        return warnings(self.usage)

    def provider_used(self) -> str:
        """The provider, or the template if every batch failed."""
        if self.provider == TEMPLATE:
            return TEMPLATE
        row = self.usage.first()
        return TEMPLATE if row["batches"] and row["failed_batches"] == row["batches"] else self.provider


def explain_changes(
    changes: DataFrame, key: list[str], explain: Callable | None = None, *,
    provider: str = "custom", model: str | None = None, prices: tuple[float, float] | None = None,
    label: str | None = None, size: int = 50, buckets: int | Column | None = None, unique: bool = False,
    single: bool = False, answers: str | None = None, calls_per_task: int = 10,
    folder: str | None = None, kept: Kept | None = None,
) -> Explained:
    """Explain all changes by template, or by a user's function with the template behind it.

    The function is called with a prompt per batch, or per record with ``single``. Its
    answers are stored under ``answers``, by default in a new table of the working folder;
    a run that names the table of an earlier one does not ask again (see ``ask_once``).
    Explanations are labelled ``provider (model)``, or ``provider``, or with ``label``.
    """
    if explain is None:
        records = to_explain(changes).select(F.array(F.lit(0)).alias("records"))
        return Explained(template_explanations(changes, key), records, TEMPLATE)
    if single:
        batches = single_prompts(changes, key)
    else:
        batches = batch_prompts(changes, key, size, buckets, unique=unique, folder=folder, kept=kept)
    kept = kept or Kept()
    if answers is None:
        answers = kept.path(changes.sparkSession, folder or working_folder(changes.sparkSession))
    asked = f"{provider} ({model})" if model else provider
    # Numbering and prompts are worked out once: the answers are joined to these very rows.
    batches = materialize(batches, folder or working_folder(changes.sparkSession), kept)
    answered = ask_once(batches, explain, answers, label=asked, calls_per_task=calls_per_task, kept=kept)
    answered = materialize(answered, folder or working_folder(changes.sparkSession), kept)
    label = label or asked
    merged = merge(answered, key, label, json=not single)
    return Explained(merged, answered, provider, model, prices, not single, label)
