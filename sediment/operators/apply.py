"""The next version of a history table."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sediment.functions.columns import (
    CHANGED,
    DELETED,
    EFFECTIVE_FROM,
    EFFECTIVE_TO,
    IS_CURRENT,
    META,
    NEW,
    UNCHANGED,
)
from sediment.operators.diff import Comparison, compare, current_rows, new, old
from sediment.plans.keyed import join_sliced, match_key


def output_columns(comparison: Comparison) -> list[str]:
    """Key, tracked columns, columns kept from the history table, metadata."""
    return [*comparison.key, *comparison.tracked, *comparison.kept, *META]


def apply_scd2(
    source: DataFrame | Comparison,
    target: DataFrame | None = None,
    key: list[str] | None = None,
    tracked: list[str] | None = None,
    processing_date: datetime.date | str | None = None,
    *,
    delete_policy: str = "soft_delete",
    null_flags: str = "drop",
    observation: Observation | None = None,
    **options,
) -> DataFrame:
    """Close superseded rows, open new versions, keep the rest and all closed rows.

    Takes a ``Comparison``, or what ``compare`` takes. ``delete_policy='ignore'``
    leaves the rows of keys that left the snapshot open. Rows whose ``is_current``
    is null are neither current nor closed and are dropped; ``null_flags='error'``
    stops the job on the first one. The first job that reads the result leaves their
    number in ``observation``, under ``dropped``.
    """
    if delete_policy not in ("soft_delete", "ignore"):
        raise ValueError("delete_policy must be 'soft_delete' or 'ignore'")
    if null_flags not in ("drop", "error"):
        raise ValueError("null_flags must be 'drop' or 'error'")
    if processing_date is None:
        raise ValueError("processing_date is required")
    comparison = source
    if not isinstance(comparison, Comparison):
        comparison = compare(source, target, key, tracked, **options)
    live = live_rows(comparison, processing_date, delete_policy)
    closed = _closed_rows(comparison, null_flags, observation)
    return live if closed is None else closed.unionByName(live)


def live_rows(
    comparison: Comparison, processing_date: datetime.date | str, delete_policy: str = "soft_delete"
) -> DataFrame:
    """The part of the next table that was open before or is opened: all but the rows closed earlier."""
    today = F.lit(str(processing_date)).cast("date")
    closing = [CHANGED, DELETED] if delete_policy == "soft_delete" else [CHANGED]
    if comparison.unique:
        return _unique_keys(comparison, today, closing)
    return _repeated_keys(comparison, today, closing)


def _closed_rows(
    comparison: Comparison, null_flags: str, observation: Observation | None
) -> DataFrame | None:
    target = comparison.target
    if IS_CURRENT not in target.columns:
        return None
    is_closed = ~F.col(IS_CURRENT)
    if null_flags == "error":
        is_closed = F.when(
            F.col(IS_CURRENT).isNull(),
            F.raise_error(F.lit("The history table has rows whose is_current is null.")).cast(
                "boolean"
            ),
        ).otherwise(is_closed)
    elif observation is not None:
        # Open rows are not read for this.
        target = target.filter(is_closed | F.col(IS_CURRENT).isNull()).observe(
            observation, F.count_if(F.col(IS_CURRENT).isNull()).alias("dropped")
        )
    return target.filter(is_closed).select(*_target_row(comparison, lambda c: c))


def _target_row(comparison: Comparison, name, closes: Column | None = None, today=None):
    """Output columns of a history row; ``closes`` says which rows end today."""
    def meta(column, dtype):
        present = column in comparison.target.columns
        return (F.col(f"`{name(column)}`") if present else F.lit(None)).cast(dtype)

    data = [*comparison.key, *comparison.tracked, *comparison.kept]
    columns = [comparison.target_value(c, name).alias(c) for c in data]
    start = meta(EFFECTIVE_FROM, "date")
    end = meta(EFFECTIVE_TO, "date")
    flag = meta(IS_CURRENT, "boolean")
    if closes is not None:
        end = F.when(closes, today).otherwise(end)
        flag = F.when(closes, F.lit(False)).otherwise(flag)
    return [
        *columns, start.alias(EFFECTIVE_FROM), end.alias(EFFECTIVE_TO), flag.alias(IS_CURRENT)
    ]


def _opened_row(comparison: Comparison, today: Column, prefix=new):
    """Output columns of the version that starts today."""
    return [
        *[
            comparison.source_value(c, prefix).alias(c)
            for c in [*comparison.key, *comparison.tracked]
        ],
        *[F.lit(None).cast(comparison.type_of(c)).alias(c) for c in comparison.kept],
        today.alias(EFFECTIVE_FROM),
        F.lit(None).cast("date").alias(EFFECTIVE_TO),
        F.lit(True).alias(IS_CURRENT),
    ]


def _unique_keys(comparison: Comparison, today: Column, closing: list[str]) -> DataFrame:
    # Each compared row becomes one or two output rows on the spot: nothing moves.
    kind = F.col("change_type")
    opens = (
        F.when(kind == NEW, F.array(F.lit(True)))
        .when(kind == CHANGED, F.array(F.lit(False), F.lit(True)))
        .otherwise(F.array(F.lit(False)))
    )
    before = _target_row(comparison, old, kind.isin(closing), today)
    return _versions(comparison, comparison.rows, opens, before, _opened_row(comparison, today))


def _versions(comparison, rows, opens, before, after) -> DataFrame:
    """A row per element of ``opens``: the new version where it is true, else the old one."""
    opened = F.col("__opened")
    return rows.select("*", F.explode(opens).alias("__opened")).select(
        *[
            F.when(opened, a).otherwise(b).alias(c)
            for c, b, a in zip(output_columns(comparison), before, after, strict=True)
        ]
    )


def _repeated_keys(comparison: Comparison, today: Column, closing: list[str]) -> DataFrame:
    # A key is kept open if any of its snapshot rows is unchanged, closed if not,
    # and gets one new version from its last snapshot row if any is changed or new.
    on, kind = comparison.on, F.col("change_type")
    values = [new(c) for c in [*comparison.key, *comparison.tracked]]
    per_key = (
        comparison.rows.filter(kind != DELETED)
        .groupBy(*on)
        .agg(
            F.max(kind == UNCHANGED).alias("__keep"),
            F.max(kind.isin(CHANGED, NEW)).alias("__open"),
            F.max(F.struct("__order", *[f"`{v}`" for v in values])).alias("__last"),
        )
    )
    target = comparison.target
    key_types = [comparison.type_of(k) for k in comparison.key]
    keys = [F.col(f"`{k}`").cast(t) for k, t in zip(comparison.key, key_types, strict=True)]
    current = current_rows(target).select("*", *match_key(keys, key_types, comparison.null_keys))
    closes = ~F.coalesce(F.col("__keep"), F.lit(DELETED not in closing))
    existing = _target_row(comparison, lambda c: c, closes, today)
    after = _opened_row(comparison, today, lambda c: f"__last`.`{new(c)}")
    columns = output_columns(comparison)
    # Existing rows are on the left, where those of a hot key are split; new versions
    # come from the flags and last row of each key, which both branches read.
    live = join_sliced(current, per_key.select(*on, "__keep"), on, comparison.hot).select(
        *[e.alias(c) for e, c in zip(existing, columns, strict=True)]
    )
    opened = per_key.filter("__open").select(*[a.alias(c) for a, c in zip(after, columns, strict=True)])
    return live.unionByName(opened)
