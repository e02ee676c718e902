"""Change detection: a snapshot against the current rows of a history table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.casts import checked_cast, widen
from sediment.functions.columns import (
    CHANGE_TYPES,
    CHANGED,
    DELETED,
    IS_CURRENT,
    META,
    NEW,
    ORDERS,
    ROW_ORDER,
    TARGET_ORDER,
    UNCHANGED,
    data_columns,
)
from sediment.functions.text import display, same_value
from sediment.functions.types import common_type, key_type
from sediment.plans.keyed import (
    hot_slices,
    last_per_key,
    match,
    match_columns,
    match_key,
    rows_per_key,
)
from sediment.plans.materialize import Kept, materialize

FIELD_CHANGES = "array<struct<column:string,old_value:string,new_value:string>>"

_IN_SOURCE = "__in_source"
_IN_TARGET = "__in_target"
_ORDER = "__order"
_OLD_ORDER = "__old_order"


def new(column: str) -> str:
    """Name under which ``Comparison.rows`` holds a value of the snapshot."""
    return f"__new_{column}"


def old(column: str) -> str:
    """Name under which ``Comparison.rows`` holds a value of the current history row."""
    return f"__old_{column}"


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None)


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


@dataclass(frozen=True)
class Comparison:
    """A snapshot set against a history table.

    ``rows`` has one row per change record: the key, ``change_type``, a flag per
    tracked column, the values of both sides and the match columns of the key. With
    ``unique`` no key repeats on either side, so every key is on exactly one row.
    """

    rows: DataFrame
    source: DataFrame
    target: DataFrame
    key: list[str]
    tracked: list[str]
    kept: list[str]
    unique: bool
    #: Hot keys of the history's current rows (see ``hot_slices``), where keys may repeat.
    hot: dict[int, int] = field(default_factory=dict)
    #: Whether key columns may be null.
    null_keys: bool = True

    @property
    def on(self) -> list[str]:
        return match_columns(self.key, self.null_keys)

    def type_of(self, column: str) -> T.DataType:
        """Output type of a data column: it holds the values of both sides as they are."""
        pick = key_type if column in self.key else common_type
        return pick(_types(self.source).get(column), _types(self.target).get(column))

    def source_value(self, column: str, prefix=new) -> Column:
        """A snapshot value in the output type."""
        source_type, dtype = _types(self.source).get(column), self.type_of(column)
        if source_type is None:
            return F.lit(None).cast(dtype)
        value = F.col(f"`{prefix(column)}`")
        if column in self.key:
            return checked_cast(value, column, source_type, dtype)
        return widen(value, source_type, dtype)

    def target_value(self, column: str, name) -> Column:
        """A value of the history, found under ``name(column)``, in the output type."""
        target_type, dtype = _types(self.target).get(column), self.type_of(column)
        if target_type is None:
            return F.lit(None).cast(dtype)
        value = F.col(f"`{name(column)}`")
        return value.cast(dtype) if column in self.key else widen(value, target_type, dtype)

    def of_type(self, kind: str) -> DataFrame:
        """The rows of one change type.

        Asks for the sides a row is on, so that the full outer join becomes a one-sided
        or an inner one, and new and deleted rows need no tracked columns.
        """
        in_source, in_target = F.col(_IN_SOURCE), F.col(_IN_TARGET)
        if kind == NEW:
            return self.rows.filter(in_source & in_target.isNull())
        if kind == DELETED:
            return self.rows.filter(in_target & in_source.isNull())
        return self.rows.filter(in_source & in_target & (F.col("change_type") == kind))

    def changes(self, kind: str | None = None) -> DataFrame:
        """The report: key, ``change_type``, ``field_changes``; one row per record.

        ``kind`` picks the records of one type. Where the sides have an order, records
        carry the position of their snapshot row, deletions that of their history row.
        """
        rows = self.of_type(kind) if kind else self.rows
        order = [c for c in ORDERS if c in rows.columns]
        return rows.select(
            *[f"`{k}`" for k in self.key], "change_type", self._field_changes(), *order
        )

    def _field_changes(self) -> Column:
        source_types, target_types = _types(self.source), _types(self.target)
        nothing = F.array().cast(FIELD_CHANGES)
        if not self.tracked:
            return nothing.alias("field_changes")

        def shown(column, name, types):
            if column not in types:
                return F.lit(None).cast("string")
            return display(F.col(f"`{name(column)}`"), types[column])

        fields = [
            F.when(
                F.col(f"`{_flag(c)}`"),
                F.struct(
                    F.lit(c).alias("column"),
                    shown(c, old, target_types).alias("old_value"),
                    shown(c, new, source_types).alias("new_value"),
                ),
            )
            for c in self.tracked
        ]
        return (
            F.when(F.col("change_type") == CHANGED, F.array_compact(F.array(*fields)))
            .otherwise(nothing)
            .cast(FIELD_CHANGES)
            .alias("field_changes")
        )

    def materialized(self, folder: str | None = None, kept: Kept | None = None) -> Comparison:
        """The same comparison over rows that are computed once."""
        return replace(self, rows=materialize(self.rows, folder, kept))


def _flag(column: str) -> str:
    return f"__differs_{column}"


def differs(column: str) -> Column:
    """Did this tracked column change? Null where the key is on one side only."""
    return F.col(f"`{_flag(column)}`")


def current_rows(target: DataFrame) -> DataFrame:
    """The open rows; every row where the table has no ``is_current``."""
    return target.filter(IS_CURRENT) if IS_CURRENT in target.columns else target


def compare(
    source: DataFrame,
    target: DataFrame,
    key: list[str],
    tracked: list[str] | None = None,
    *,
    unique: bool | None = None,
    duplicates: str = "last",
    order_by: list[str] | None = None,
    target_order_by: list[str] | None = None,
    removed_columns: str = "drop",
    null_keys: bool = True,
) -> Comparison:
    """Match a snapshot with the current rows of a history table, null keys included.

    ``unique``: True is the caller's promise that no key repeats on either side,
    False that some may; None finds out with a job over the key columns alone.
    With repeated keys a job over the key columns looks for hot ones, whose rows are
    split over tasks, and each snapshot row is compared with the last current row of
    its key, "last" being by ``order_by``/``target_order_by`` or by position in the
    input files; ``duplicates='error'`` rejects them instead, whatever was promised.
    ``removed_columns='keep'`` carries columns that only the history table has.
    ``null_keys=False`` is the promise that no key column is null: sides are then joined
    on the key columns themselves, so that a history bucketed by them is not shuffled. A
    snapshot that breaks it stops the job.
    """
    if duplicates not in ("last", "error"):
        raise ValueError("duplicates must be 'last' or 'error'")
    if removed_columns not in ("drop", "keep"):
        raise ValueError("removed_columns must be 'drop' or 'keep'")
    if tracked is None:
        tracked = sorted(c for c in data_columns(source) if c not in key)
    kept = []
    if removed_columns == "keep":
        kept = [c for c in data_columns(target) if c not in key and c not in tracked]
    source_types, target_types = _types(source), _types(target)
    key_types = [key_type(source_types[k], target_types[k]) for k in key]
    on = match_columns(key, null_keys)

    source_keys = [
        checked_cast(F.col(f"`{k}`"), k, source_types[k], t)
        for k, t in zip(key, key_types, strict=True)
    ]
    if not null_keys:
        source_keys = [_promised(c, k, t) for c, k, t in zip(source_keys, key, key_types, strict=True)]
    target_keys = [
        checked_cast(F.col(f"`{k}`"), k, target_types[k], t, "history table")
        for k, t in zip(key, key_types, strict=True)
    ]
    current = current_rows(target)
    left = source.select(
        *match_key(source_keys, key_types, null_keys),
        F.lit(True).alias(_IN_SOURCE),
        *[_column(source, c).alias(new(c)) for c in [*key, *tracked]],
        *_order(source, order_by),
    )
    right = current.select(
        *match_key(target_keys, key_types, null_keys),
        F.lit(True).alias(_IN_TARGET),
        *[_column(target, c).alias(old(c)) for c in [*key, *tracked, *kept, *META]],
        *_order(target, target_order_by, _OLD_ORDER),
    )

    if unique is None or duplicates == "error":
        most_source, most_target = rows_per_key(left, right, on)
        unique = most_source <= 1 and most_target <= 1
        if most_source > 1 and duplicates == "error":
            raise ValueError("The snapshot has duplicate business keys.")
        if most_target > 1 and duplicates == "error":
            raise ValueError("The history table has several current rows for a key.")
    hot: dict[int, int] = {}
    if unique:
        rows = left.join(right, on, "full_outer")
    else:
        _require_order(source, order_by, "snapshot")
        _require_order(target, target_order_by, "history table")
        last = last_per_key(right, on, [_OLD_ORDER])
        slices, hot = hot_slices([left, right], on)
        rows = match(left, last, on, slices)

    labelled = _label(rows, key, tracked, source_types, target_types, key_types)
    for name, side in ((ROW_ORDER, _ORDER), (TARGET_ORDER, _OLD_ORDER)):
        if side in labelled.columns:
            shown = F.col(side) if name == ROW_ORDER else F.when(F.col(_IN_SOURCE).isNull(), F.col(side))
            labelled = labelled.withColumn(name, shown)
    return Comparison(
        labelled, source, target, list(key), list(tracked), kept, bool(unique), hot, null_keys
    )


def _order(df: DataFrame, order_by: list[str] | None, name: str = _ORDER) -> list[Column]:
    if order_by:
        return [F.struct(*[F.col(f"`{c}`") for c in order_by]).alias(name)]
    return [F.col(ROW_ORDER).alias(name)] if ROW_ORDER in df.columns else []


def _promised(col: Column, name: str, dtype: T.DataType) -> Column:
    message = F.lit(f"Key column '{name}' of the snapshot is null, against the promise.")
    return F.when(col.isNull(), F.raise_error(message).cast(dtype)).otherwise(col)


def _require_order(df: DataFrame, order_by: list[str] | None, what: str) -> None:
    if not order_by and ROW_ORDER not in df.columns:
        raise ValueError(
            f"Keys of the {what} may repeat, and its rows have no order that says which "
            "is the last: give order columns, or load the files with keep_order=True."
        )


def _label(rows, key, tracked, source_types, target_types, key_types) -> DataFrame:
    both = F.col(_IN_SOURCE) & F.col(_IN_TARGET)
    null = T.NullType()
    flags = [
        F.when(
            both,
            ~same_value(
                F.col(f"`{new(c)}`"),
                source_types.get(c, null),
                F.col(f"`{old(c)}`"),
                target_types.get(c, null),
            ),
        ).alias(_flag(c))
        for c in tracked
    ]
    keys = [
        F.when(F.col(_IN_SOURCE), checked_cast(F.col(f"`{new(k)}`"), k, source_types[k], t))
        .otherwise(F.col(f"`{old(k)}`").cast(t))
        .alias(k)
        for k, t in zip(key, key_types, strict=True)
    ]
    any_change = F.lit(False)
    for c in tracked:
        any_change = any_change | differs(c)
    change_type = (
        F.when(F.col(_IN_TARGET).isNull(), NEW)
        .when(F.col(_IN_SOURCE).isNull(), DELETED)
        .when(any_change, CHANGED)
        .otherwise(UNCHANGED)
    )
    return rows.select("*", *flags, *keys).withColumn("change_type", change_type)


def detect_changes(
    source: DataFrame, target: DataFrame, key: list[str], tracked: list[str] | None = None, **options
) -> DataFrame:
    """The change report of ``compare``: key, ``change_type``, ``field_changes``."""
    return compare(source, target, key, tracked, **options).changes()


def report_order(df: DataFrame, key: list[str]) -> list[Column]:
    """What sorts a report: snapshot order, deletions last in that of the history, then keys."""
    orders = [F.col(c) for c in ORDERS if c in df.columns]
    return [F.col("change_type") == DELETED, *orders, *[F.col(f"`{k}`") for k in key]]


def in_report_order(changes: DataFrame, key: list[str]) -> DataFrame:
    """Records in the order of the snapshot (of its keys, if it has no order).

    Deletions come last, in the order of the history if that has one.
    """
    return changes.orderBy(*report_order(changes, key))


def summary(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of records per change type and in total; one row, or one per segment."""
    counts = [F.count_if(F.col("change_type") == t).alias(t) for t in CHANGE_TYPES]
    return changes.groupBy(*(by or [])).agg(*counts, F.count(F.lit(1)).alias("total"))


def exploded_fields(changes: DataFrame, key: list[str]) -> DataFrame:
    """One row per changed field: key, ``column``, ``old_value``, ``new_value``."""
    return changes.filter(F.col("change_type") == CHANGED).select(
        *[f"`{k}`" for k in key], F.inline("field_changes")
    )
