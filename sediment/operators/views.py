"""Views of a history table and of a change report."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.columns import (
    CHANGED,
    DELETED,
    EFFECTIVE_FROM,
    EFFECTIVE_TO,
    IS_CURRENT,
    NEW,
)
from sediment.operators.diff import Comparison, differs, new, old

# The choices of the status filter.
ALL, CURRENT_ONLY, HISTORICAL_ONLY = "All", "Current only", "Historical only"

# Fixed value: rows in a preview.
PREVIEW_ROWS = 200


def by_status(df: DataFrame, status: str = ALL, sort: str | None = None) -> DataFrame:
    """All, current or closed rows, sorted by one column on request."""
    if status not in (ALL, CURRENT_ONLY, HISTORICAL_ONLY):
        raise ValueError(f"Unknown status filter: {status}")
    if IS_CURRENT in df.columns:
        if status == CURRENT_ONLY:
            df = df.filter(F.col(IS_CURRENT))
        elif status == HISTORICAL_ONLY:
            df = df.filter(~F.col(IS_CURRENT))
    if sort is not None and sort not in df.columns:
        raise ValueError(f"Unknown column to sort by: {sort}")
    return df if sort is None else df.orderBy(f"`{sort}`")


def ordered(df: DataFrame, key: list[str]) -> DataFrame:
    """A history table sorted by key and start, nulls first."""
    return df.orderBy(*[f"`{k}`" for k in key], EFFECTIVE_FROM)


def changed_wide(comparison: Comparison) -> DataFrame:
    """Changed records with ``c (old)`` and ``c (new)``, filled for changed fields only."""
    columns = []
    for c in comparison.tracked:
        changed = differs(c)
        columns += [
            F.when(changed, F.col(f"`{old(c)}`")).alias(f"{c} (old)"),
            F.when(changed, F.col(f"`{new(c)}`")).alias(f"{c} (new)"),
        ]
    return comparison.of_type(CHANGED).select(
        *[f"`{k}`" for k in comparison.key], *columns
    )


def new_keys(comparison: Comparison) -> DataFrame:
    return comparison.of_type(NEW).select(*[f"`{k}`" for k in comparison.key])


def deleted_keys(comparison: Comparison) -> DataFrame:
    return comparison.of_type(DELETED).select(*[f"`{k}`" for k in comparison.key])


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a table."""
    return df.limit(rows)


def as_of(df: DataFrame, day: datetime.date | str) -> DataFrame:
    """The version of every key that held on a day: started by then and not yet ended."""
    day = F.lit(str(day)).cast("date")
    return df.filter(
        (F.col(EFFECTIVE_FROM) <= day) & (F.col(EFFECTIVE_TO).isNull() | (day < F.col(EFFECTIVE_TO)))
    )
