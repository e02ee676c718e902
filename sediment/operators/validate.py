"""Integrity rules over a history table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sediment.functions.columns import EFFECTIVE_FROM, EFFECTIVE_TO, IS_CURRENT, META
from sediment.functions.text import key_label

PASS, FAIL, WARN = "pass", "fail", "warn"

# The rules in report order, and two optional ones after them.
RULES = (
    "schema_completeness",
    "one_current_per_key",
    "no_null_keys",
    "no_overlapping_dates",
    "date_consistency",
)
EXTRA_RULES = ("valid_current_records", "no_history_gaps")


@dataclass(frozen=True)
class Validation:
    """Verdicts and, per rule, the rows behind them; everything is lazy.

    ``rules`` has one row per rule (and segment): ``rule_no``, ``rule``, ``status``,
    ``message``, ``violation_count``.
    """

    df: DataFrame
    rules: DataFrame
    key: list[str]
    by: list[str]
    extras: bool

    @cached_property
    def violations(self) -> dict[str, DataFrame]:
        """The offending rows of each rule that has some to show."""
        return _violations(self.df, self.key, self.by, self.extras)

    def summary(self) -> DataFrame:
        """Rules per status and ``passed``: no rule failed (a warning passes)."""
        return rule_summary(self.rules, self.by)

    def passed(self) -> bool:
        return self.rules.filter(F.col("status") == FAIL).isEmpty()

    def details(self) -> DataFrame:
        """Detail texts: ``rule_no``, ``rule``, ``detail``, and ``copies`` of that text.

        The history is read once for the texts and once for the counts among them.
        """
        by = [f"`{b}`" for b in self.by]
        counted = self.rules.select(*by, F.inline(F.array_compact(F.array(*self.counted_details()))))
        rules = F.array(*[F.lit(r) for r in (*RULES, *EXTRA_RULES)])
        found = counted.unionByName(self.row_details())
        return found.select(*by, "rule_no", F.get(rules, F.col("rule_no") - 1).alias("rule"), "detail", "copies")

    def counted_details(self) -> list[Column]:
        """Details that follow from a row of ``rules`` alone; null for other rows."""
        one = F.lit(1).cast("long")
        missing = sorted(c for c in META if c not in self.df.columns)
        texts = [(1, F.lit(f"Missing: {c}"), F.lit(True)) for c in missing]
        if _has(self.df, *self.key):
            count = F.col("violation_count")
            texts.append((3, _null_key_text(count), count > 0))
        return [
            F.when(
                (F.col("rule_no") == number) & when,
                F.struct(F.col("rule_no").alias("rule_no"), text.alias("detail"), one.alias("copies")),
            )
            for number, text, when in texts
        ] or [F.lit(None).cast("struct<rule_no:int,detail:string,copies:bigint>")]

    def row_details(self) -> DataFrame:
        """Details about single keys and periods: ``rule_no``, ``detail``, ``copies``."""
        present = self.key if _has(self.df, *self.key) else None
        if present is None:
            return self.rules.limit(0).select(
                *[f"`{b}`" for b in self.by], "rule_no", F.col("message").alias("detail"),
                F.col("violation_count").alias("copies"),
            )
        return _key_details(self.df, self.key, self.by, self.extras)


def rule_summary(rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in (PASS, FAIL, WARN)]
    return rules.groupBy(*(by or [])).agg(
        *counts,
        F.count(F.lit(1)).alias("total_count"),
        F.every(F.col("status") != FAIL).alias("passed"),
    )


def validate_scd2(
    df: DataFrame, key: list[str], *, by: list[str] | None = None, extras: bool = False,
    observation: Observation | None = None,
) -> Validation:
    """Check a history table, as a whole or each segment of it (``by`` columns) alone.

    One pass over the key, date and flag columns counts the violations of all rules. The
    first job that reads ``rules`` leaves the number of rows inspected in ``observation``,
    under ``rows``.
    """
    by = list(by or [])
    counts = _counts(df, key, by)
    if observation is not None:
        counts = counts.observe(observation, F.sum("__rows").alias("rows"))
    verdicts = _verdicts(df, key, extras)
    rules = counts.select(
        *by, F.inline(F.array(*[F.struct(*v) for v in verdicts]))
    )
    return Validation(df, rules, list(key), by, extras)


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def _c(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def null_key(key: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(f"`{k}`").isNull() for k in key])


def inverted() -> Column:
    return F.col(EFFECTIVE_TO).isNotNull() & (F.col(EFFECTIVE_FROM) > F.col(EFFECTIVE_TO))


def _reaches(start: Column) -> Column:
    """Does the period of this row go beyond a next one that begins at ``start``?

    An open end reaches any start. A null start comes after nothing, so whatever
    precedes it conflicts with it.
    """
    end = F.col(EFFECTIVE_TO)
    return end.isNull() | start.isNull() | (end > start)


def _starts(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row per key and start date, with the next start of the key.

    Versions of a key follow each other by start, then by end with open ends last.
    Among rows with one start, all but the last are followed by that same start, so
    counts per start are enough to compare neighbours: no task sorts the rows of a
    large key, only its different dates.
    """
    start = _c(df, EFFECTIVE_FROM, "date")
    end = _c(df, EFFECTIVE_TO, "date")
    flag = _c(df, IS_CURRENT, "boolean")
    rows = df.select(
        *[f"`{c}`" for c in [*by, *key]],
        start.alias(EFFECTIVE_FROM), end.alias(EFFECTIVE_TO), flag.alias(IS_CURRENT),
    )
    per_start = rows.groupBy(*[f"`{c}`" for c in [*by, *key]], EFFECTIVE_FROM).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count_if(IS_CURRENT).alias("__current_rows"),
        F.count_if(inverted()).alias("__inverted_rows"),
        F.count_if(_reaches(F.col(EFFECTIVE_FROM))).alias("__reaching_rows"),
        F.count_if(_leaves_gap(F.col(EFFECTIVE_FROM))).alias("__gap_rows"),
        F.count_if(F.col(IS_CURRENT) & F.col(EFFECTIVE_TO).isNotNull()).alias("__ended_current_rows"),
        F.min(EFFECTIVE_TO).alias("__first_end"),
        F.when(F.max(F.col(EFFECTIVE_TO).isNull()), F.lit(None).cast("date"))
        .otherwise(F.max(EFFECTIVE_TO))
        .alias(EFFECTIVE_TO),
    )
    order = Window.partitionBy(*[f"`{c}`" for c in [*by, *key]]).orderBy(
        F.asc_nulls_first(EFFECTIVE_FROM)
    )
    # Only the first start of a key can be null, so a null next start means: none.
    return per_start.withColumns(
        {
            "__next_start": F.lead(EFFECTIVE_FROM).over(order),
            "__next_end": F.lead("__first_end").over(order),
        }
    )


def _leaves_gap(start: Column) -> Column:
    """Is this row closed on another day than a next one begins at ``start``?"""
    return F.col(EFFECTIVE_TO).isNotNull() & ~F.col(EFFECTIVE_TO).eqNullSafe(start)


def _counts(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    present = [k for k in key if k in df.columns]
    starts = _starts(df, present, by)

    def neighbours(total, test):
        inside = F.col(total) - test(F.col(EFFECTIVE_FROM)).cast("long")
        across = F.col("__next_start").isNotNull() & test(F.col("__next_start"))
        return F.sum(inside + across.cast("long"))

    per_key = starts.groupBy(*[f"`{c}`" for c in [*by, *present]]).agg(
        F.sum("__rows").alias("__rows"),
        F.sum("__current_rows").alias("__current_rows"),
        F.sum("__inverted_rows").alias("__inverted_rows"),
        F.sum("__ended_current_rows").alias("__ended_current_rows"),
        neighbours("__reaching_rows", _reaches).alias("__overlaps"),
        neighbours("__gap_rows", _leaves_gap).alias("__gaps"),
    )

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0).cast("long"))

    unknown = null_key(present) if present else F.lit(False)
    return per_key.groupBy(*[f"`{b}`" for b in by]).agg(
        total("__rows").alias("__rows"),
        F.count_if(F.col("__current_rows") > 1).alias("__repeated_keys"),
        total(F.when(unknown, F.col("__rows"))).alias("__null_key_rows"),
        total("__inverted_rows").alias("__inverted_rows"),
        total("__ended_current_rows").alias("__ended_current_rows"),
        total("__overlaps").alias("__overlaps"),
        total("__gaps").alias("__gaps"),
    )


def _verdicts(df: DataFrame, key: list[str], extras: bool) -> list[list[Column]]:
    """Rule number, name, status, message and count of every rule, over ``_counts``."""
    zero = F.lit(0).cast("long")

    def row(number, rule, status, message, count):
        return [
            F.lit(number).alias("rule_no"),
            F.lit(rule).alias("rule"),
            status.alias("status"),
            message.alias("message"),
            count.alias("violation_count"),
        ]

    def counted(number, rule, count, bad, good):
        failed = F.col(count) > 0
        return row(
            number,
            rule,
            F.when(failed, FAIL).otherwise(PASS),
            F.when(failed, bad).otherwise(F.lit(good)),
            F.col(count),
        )

    def fixed(number, rule, status, message, count=zero):
        return row(number, rule, F.lit(status), F.lit(message), count)

    def prefixed(count, text):
        return F.concat(F.col(count).cast("string"), F.lit(text))

    missing = sorted(c for c in META if c not in df.columns)
    absent = [k for k in key if k not in df.columns]
    verdicts = []

    # The wording of the messages.
    if missing:
        message = f"Missing required SCD2 columns: {missing}"
        verdicts.append(fixed(1, RULES[0], FAIL, message, F.lit(len(missing)).cast("long")))
    else:
        verdicts.append(fixed(1, RULES[0], PASS, "All required SCD2 columns present."))

    if absent:
        verdicts.append(fixed(2, RULES[1], FAIL, f"Business key column '{absent[0]}' missing."))
        verdicts.append(fixed(3, RULES[2], FAIL, f"Business key column '{absent[0]}' missing."))
    else:
        if IS_CURRENT in missing:
            verdicts.append(fixed(2, RULES[1], FAIL, f"Column '{IS_CURRENT}' missing."))
        else:
            verdicts.append(
                counted(
                    2, RULES[1], "__repeated_keys",
                    prefixed("__repeated_keys", " business key(s) have multiple current rows."),
                    "Each business key has at most one current row.",
                )
            )
        verdicts.append(
            counted(
                3, RULES[2], "__null_key_rows",
                prefixed("__null_key_rows", " row(s) have null business key values."),
                "No null business keys found.",
            )
        )

    if not _has(df, EFFECTIVE_FROM, EFFECTIVE_TO):
        message = "Required date columns missing. Skipping overlap check."
        verdicts.append(fixed(4, RULES[3], WARN, message))
    elif absent:
        message = f"Business key column '{absent[0]}' missing. Skipping overlap check."
        verdicts.append(fixed(4, RULES[3], WARN, message))
    else:
        verdicts.append(
            counted(
                4, RULES[3], "__overlaps",
                F.lit("Overlapping date ranges detected."),
                "No overlapping validity periods detected.",
            )
        )

    if not _has(df, EFFECTIVE_FROM, EFFECTIVE_TO):
        message = "Date columns missing, cannot validate consistency."
        verdicts.append(fixed(5, RULES[4], WARN, message))
    else:
        verdicts.append(
            counted(
                5, RULES[4], "__inverted_rows",
                prefixed("__inverted_rows", " row(s) have effective_from > effective_to."),
                "All date ranges are consistent (effective_from <= effective_to).",
            )
        )

    if extras and not missing and not absent:
        verdicts.append(
            counted(
                6, EXTRA_RULES[0], "__ended_current_rows",
                prefixed("__ended_current_rows", " current row(s) have an effective_to."),
                "All current rows are open.",
            )
        )
        verdicts.append(
            counted(
                7, EXTRA_RULES[1], "__gaps",
                prefixed("__gaps", " version(s) end on another day than the next one starts."),
                "Every version starts on the day the previous one ends.",
            )
        )
    return verdicts


def _violations(df: DataFrame, key: list[str], by: list[str], extras: bool) -> dict[str, DataFrame]:
    found = {}
    if missing := sorted(c for c in META if c not in df.columns):
        found[RULES[0]] = df.sparkSession.range(1).select(
            *[F.lit(None).alias(b) for b in by],
            F.explode(F.array(*[F.lit(f"Missing: {c}") for c in missing])).alias("detail"),
        )
    if not _has(df, *key):
        return found
    if IS_CURRENT in df.columns:
        found[RULES[1]] = repeated_current(df, key, by)
    found[RULES[2]] = null_key_rows(df, key, by)
    if _has(df, EFFECTIVE_FROM, EFFECTIVE_TO):
        found[RULES[3]] = overlaps(df, key, by)
        found[RULES[4]] = df.filter(inverted())
    if extras and _has(df, *META):
        found[EXTRA_RULES[0]] = df.filter(F.col(IS_CURRENT) & F.col(EFFECTIVE_TO).isNotNull())
        found[EXTRA_RULES[1]] = gaps(df, key, by)
    return found


def repeated_current(df: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Keys with more than one current row."""
    columns = [f"`{c}`" for c in [*(by or []), *key]]
    counted = df.filter(IS_CURRENT).groupBy(*columns).agg(F.count(F.lit(1)).alias("current_rows"))
    text = _repeated_text(key_label(key, df.schema), F.col("current_rows"))
    return counted.filter("current_rows > 1").withColumn("detail", text)


def null_key_rows(df: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Number of rows whose key has a null in it, if there are any."""
    counted = df.filter(null_key(key)).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("null_rows"))
    return counted.filter("null_rows > 0").withColumn("detail", _null_key_text(F.col("null_rows")))


def _neighbours(df: DataFrame, key: list[str], by: list[str], test) -> DataFrame:
    """Pairs of consecutive versions whose first one passes ``test(start of the next)``.

    Columns: key, ``from_a``, ``to_a``, ``from_b``, ``to_b``, and ``pairs``, the number
    of pairs with these very dates (several copies of a row are one group here).
    """
    group = [f"`{c}`" for c in [*by, *key]]

    def pair(to_a, from_b, to_b, pairs):
        return F.struct(
            F.col(EFFECTIVE_FROM).alias("from_a"), to_a.alias("to_a"),
            from_b.alias("from_b"), to_b.alias("to_b"), pairs.cast("long").alias("pairs"),
        )

    end, start = F.col(EFFECTIVE_TO), F.col(EFFECTIVE_FROM)
    return (
        _periods(df, key, by)
        .select(
            *group,
            F.explode(
                F.array_compact(
                    F.array(
                        F.when((F.col("__copies") > 1) & test(start), pair(end, start, end, F.col("__copies") - 1)),
                        F.when(
                            F.col("__has_next") & test(F.col("__next_start")),
                            pair(end, F.col("__next_start"), F.col("__next_end"), F.lit(1)),
                        ),
                    )
                )
            ).alias("p"),
        )
        .select(*group, "p.*")
    )


def _periods(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row per key and period, with its ``__copies`` and the period that follows.

    Copies are counted before the shuffle. A task sorts the different periods of a key,
    never its rows. ``__current_rows`` is the number of current rows of the whole key,
    and ``__first`` marks one row of each key.
    """
    group = [f"`{c}`" for c in [*by, *key]]
    flag = _c(df, IS_CURRENT, "boolean")
    counted = (
        df.select(
            *group, _c(df, EFFECTIVE_FROM, "date").alias(EFFECTIVE_FROM),
            _c(df, EFFECTIVE_TO, "date").alias(EFFECTIVE_TO), flag.alias(IS_CURRENT),
        )
        .groupBy(*group, EFFECTIVE_FROM, EFFECTIVE_TO)
        .agg(F.count(F.lit(1)).alias("__copies"), F.count_if(IS_CURRENT).alias("__current"))
    )
    order = Window.partitionBy(*group).orderBy(
        F.asc_nulls_first(EFFECTIVE_FROM), F.asc_nulls_last(EFFECTIVE_TO)
    )
    return counted.withColumns(
        {
            "__has_next": F.lead(F.lit(True)).over(order),
            "__next_start": F.lead(EFFECTIVE_FROM).over(order),
            "__next_end": F.lead(EFFECTIVE_TO).over(order),
            "__first": F.row_number().over(order) == 1,
            "__current_rows": F.sum("__current").over(Window.partitionBy(*group)),
        }
    )


def _key_details(df: DataFrame, key: list[str], by: list[str], extras: bool) -> DataFrame:
    """Detail texts of the rules about keys and periods, from one reading of the history."""
    dated, flagged = _has(df, EFFECTIVE_FROM, EFFECTIVE_TO), IS_CURRENT in df.columns
    end, start = F.col(EFFECTIVE_TO), F.col(EFFECTIVE_FROM)
    label = key_label(key, df.schema)
    following = (end, F.col("__next_start"), F.col("__next_end"))

    def item(number, when, text, copies):
        fields = (F.lit(number).alias("rule_no"), text.alias("detail"), copies.cast("long").alias("copies"))
        return F.when(when, F.struct(*fields))

    def pairs(number, test, text):
        copies = F.col("__copies")
        return [
            item(number, (copies > 1) & test(start), text(start, end, start, end), copies - 1),
            item(number, F.col("__has_next") & test(F.col("__next_start")), text(start, *following), F.lit(1)),
        ]

    items = []
    if flagged:
        repeated = F.col("__first") & (F.col("__current_rows") > 1)
        items.append(item(2, repeated, _repeated_text(label, F.col("__current_rows")), F.lit(1)))
    if dated:
        items += pairs(4, _reaches, lambda *days: _overlap_text(label, *days))
    if dated and extras and flagged:
        items += pairs(7, _leaves_gap, lambda _, to_a, from_b, __: _gap_text(label, to_a, from_b))
    if not items:
        return df.sparkSession.createDataFrame([], "rule_no int, detail string, copies long").select(
            *[F.lit(None).cast(df.schema[b].dataType).alias(b) for b in by], "rule_no", "detail", "copies"
        )
    return _periods(df, key, by).select(
        *[f"`{b}`" for b in by], F.inline(F.array_compact(F.array(*items)))
    )


def _repeated_text(label: Column, rows: Column) -> Column:
    return F.concat(F.lit("Key "), label, F.lit(" has "), rows, F.lit(" current rows"))


def _null_key_text(rows: Column) -> Column:
    return F.concat(F.lit("Row with null key found (row count: "), rows, F.lit(")"))


def _overlap_text(label: Column, from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    def day(c):
        return F.coalesce(c.cast("string"), F.lit("NULL"))

    # Fixed value: the layout of the text.
    return F.concat(
        F.lit("Overlap detected for "), label,
        F.lit("\nPeriod A:\n"), day(from_a), F.lit(" → "), day(to_a),
        F.lit("\n\nPeriod B:\n"), day(from_b), F.lit(" → "), day(to_b),
    )


def _gap_text(label: Column, to_a: Column, from_b: Column) -> Column:
    return F.concat(
        F.lit("Gap for "), label, F.lit(": "), to_a.cast("string"), F.lit(" → "),
        F.coalesce(from_b.cast("string"), F.lit("NULL")),
    )


def overlaps(df: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Consecutive versions of a key whose periods overlap."""
    days = [F.col(c) for c in ("from_a", "to_a", "from_b", "to_b")]
    text = _overlap_text(key_label(key, df.schema), *days)
    return _neighbours(df, key, list(by or []), _reaches).withColumn("detail", text)


def gaps(df: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Consecutive versions of a key where the second does not start as the first ends."""
    text = _gap_text(key_label(key, df.schema), F.col("to_a"), F.col("from_b"))
    return _neighbours(df, key, list(by or []), _leaves_gap).withColumn("detail", text)
