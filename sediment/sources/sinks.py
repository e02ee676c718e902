"""Writing history tables and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.columns import IS_CURRENT, ORDERS
from sediment.functions.text import key_label
from sediment.operators.diff import report_order
from sediment.operators.explain import through_report
from sediment.operators.validate import Validation
from sediment.operators.views import ordered
from sediment.plans.materialize import Kept

# Copies of a text are written out in runs of at most this many.
_RUN = 10_000


def write_scd2(
    df: DataFrame, path: str, *, format: str = "parquet", sort_key: list[str] | None = None,
    partition_by_current: bool = True, mode: str = "errorifexists",
) -> None:
    """Write a history table as Parquet or CSV.

    Parquet is partitioned by ``is_current`` unless told otherwise, so that the next
    run reads open rows alone where it needs no others. ``sort_key`` sorts the rows by
    key and start, which costs a shuffle.
    """
    if sort_key:
        df = ordered(df, sort_key)
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    elif partition_by_current and IS_CURRENT in df.columns:
        writer = writer.partitionBy(IS_CURRENT)
    writer.save(path)


def validation_lines(validation: Validation) -> DataFrame:
    """Lines of the validation report: ``rule_no``, ``line_no``, ``value``; in that order.

    The history is read twice: for the counts, and for the keys and periods behind them.
    """
    by = [f"`{b}`" for b in validation.by]
    head = F.concat(F.lit("["), F.upper("status"), F.lit("] "), "rule", F.lit(": "), "message")
    kind = "struct<rule_no:int,line_no:int,text:string,copies:bigint>"

    def line(number, text, copies):
        return F.struct("rule_no", F.lit(number).alias("line_no"), text.alias("text"), copies).cast(kind)

    def detail(found):
        return line(1, F.concat(F.lit("  → "), found["detail"]), found["copies"])

    heads = F.array(
        line(0, head, F.lit(1)), *[F.when(d.isNotNull(), detail(d)) for d in validation.counted_details()]
    )
    # A text that counts n times becomes n lines, in runs so that no array grows with n.
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _RUN))
    left = F.least(F.col("copies") - F.col("run") * _RUN, F.lit(_RUN))
    whole = validation.rules.select(*by, F.inline(F.array_compact(heads)))
    rows = validation.row_details().select(
        *by, "rule_no", F.lit(1).alias("line_no"), F.concat(F.lit("  → "), "detail").alias("text"), "copies"
    )
    return (
        whole.unionByName(rows)
        .withColumn("run", F.explode(runs))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
        .select(*by, "rule_no", "line_no", F.col("text").alias("value"))
    )


def write_validation(validation: Validation, path: str) -> None:
    lines = validation_lines(validation)
    lines.orderBy(*validation.by, "rule_no", "line_no", "value").select("value").write.text(path)


def explanation_lines(explanations: DataFrame, key: list[str]) -> DataFrame:
    """One text per explanation: type and key, sentence, provider, empty line."""
    text = _line_text(explanations, key)
    return explanations.select(*[f"`{k}`" for k in key], "change_type", text.alias("value"))


def numbered_lines(
    explanations: DataFrame, key: list[str], folder: str | None = None, kept: Kept | None = None
) -> DataFrame:
    """``explanation_lines`` with ``line_no``, the place in the report from 0.

    Ranges of the report are numbered side by side (see ``through_report``); they are
    kept for that.
    """
    numbered = through_report(explanations, _line_order(explanations, key), folder=folder, kept=kept)
    rows = numbered.withColumn("line_no", F.col("__position").cast("long"))
    return rows.select(
        "line_no", *[f"`{k}`" for k in key], "change_type", _line_text(explanations, key).alias("value")
    )


def _line_order(explanations: DataFrame, key: list[str]) -> list[Column]:
    """Report order where explanations carry their position; else new, changed, deleted, by key."""
    if any(c in explanations.columns for c in ORDERS):
        return report_order(explanations, key)
    kind = F.col("change_type")
    section = F.when(kind == "new", 0).when(kind == "changed", 1).otherwise(2)
    return [section, *[F.col(f"`{k}`") for k in key]]


def _line_text(explanations: DataFrame, key: list[str]) -> Column:
    return F.concat(
        F.lit("["), F.upper("change_type"), F.lit("] "), key_label(key, explanations.schema),
        F.lit("\n  "), "text", F.lit("\n  Provider: "), "provider", F.lit("\n"),
    )


def write_explanations(explanations: DataFrame, key: list[str], path: str) -> None:
    nothing = (
        explanations.limit(1)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 0")
        .select(F.lit("No changes to explain.").alias("value"))
    )
    ordered = explanations.orderBy(*_line_order(explanations, key))
    body = ordered.select(_line_text(explanations, key).alias("value"))
    body.unionByName(nothing).write.text(path)


def save_bucketed(df: DataFrame, table: str, key: list[str], buckets: int) -> None:
    """Save a history as a table bucketed and sorted by its key, in parts by ``is_current``.

    A comparison with ``null_keys=False`` reads it without shuffling it, if there are at
    least as many ``buckets`` as shuffle partitions and key columns are not cast.
    """
    writer = df.write.format("parquet").mode("overwrite").bucketBy(buckets, *key).sortBy(*key)
    if IS_CURRENT in df.columns:
        writer = writer.partitionBy(IS_CURRENT)
    writer.saveAsTable(table)
