"""Bringing the columns of a snapshot and its history table to one type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.text import display, strip
from sediment.functions.types import EXACT, FLOATING


def widen(col: Column, source: T.DataType, target: T.DataType) -> Column:
    """A value in the common type of two (``common_type``), which loses nothing of it.

    Text is what reports print, so that a value compares with its own text as equal.
    """
    if source == target:
        return col
    return display(col, source) if isinstance(target, T.StringType) else col.cast(target)


def checked_cast(
    col: Column, name: str, source: T.DataType, target: T.DataType, side: str = "snapshot"
) -> Column:
    """Cast that stops the job with a clear message where a value does not fit.

    A value fits if casting it back gives the same value again, so that digits or times
    of day are never lost silently. Text fits if it can be read and says the same number
    or time as what was read.
    """
    if source == target:
        return col
    cast = col.try_cast(target)
    message = F.concat(
        F.lit(f"Column '{name}': value '"),
        col.cast("string"),
        F.lit(f"' of the {side} does not fit the history type {target.simpleString()}."),
    )
    if isinstance(source, T.StringType):
        text = strip(col)
        bad = (col.isNotNull() & (text != "")) & (cast.isNull() | _says_otherwise(text, cast, target))
    else:
        bad = col.isNotNull() & cast.isNull()
        if not isinstance(target, T.StringType):
            bad = bad | (col.isNotNull() & ~cast.try_cast(source).eqNullSafe(col))
    return F.when(bad, F.raise_error(message).cast(target)).otherwise(cast)


def _says_otherwise(text: Column, cast: Column, target: T.DataType) -> Column:
    """Is what was read from a text another number or time than the text?"""
    if isinstance(target, (*EXACT, *FLOATING)):
        # With and without room for decimal places: a number may have too many digits for one.
        return ~(
            text.try_cast("decimal(38,18)").eqNullSafe(cast.cast("string").try_cast("decimal(38,18)"))
            & text.try_cast("decimal(38,0)").eqNullSafe(cast.cast("string").try_cast("decimal(38,0)"))
        )
    if isinstance(target, T.DateType):
        moment = text.try_cast("timestamp_ntz")
        return moment.isNotNull() & ~moment.eqNullSafe(cast.cast("timestamp_ntz"))
    return F.lit(False)
