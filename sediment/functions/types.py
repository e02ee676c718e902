"""Types that hold the values of two others."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
EXACT = (*INTEGRAL, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Decimal digits that the integers of each size may have.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_MOST_DIGITS = 38


def _only(given: T.DataType | None, other: T.DataType | None) -> T.DataType | None:
    """The answer where at most one of two types says anything, or both say the same."""
    if given is None or isinstance(given, T.NullType):
        return other or given or T.StringType()
    if other is None or isinstance(other, T.NullType) or given == other:
        return given
    return None


def common_type(source: T.DataType | None, target: T.DataType | None) -> T.DataType:
    """The narrowest type that holds all values of both, as they print; text holds any.

    Integers meet as long, floats as double, integers and decimals as a decimal with
    room for both, a date and a timestamp as a timestamp. A long and a double meet as
    text: neither holds all values of the other.
    """
    if (same := _only(source, target)) is not None:
        return same
    if isinstance(source, INTEGRAL) and isinstance(target, INTEGRAL):
        return T.LongType()
    if isinstance(source, FLOATING) and isinstance(target, FLOATING):
        return T.DoubleType()
    if isinstance(source, EXACT) and isinstance(target, EXACT):
        return _wider_decimal(source, target)
    stamps = {type(t) for t in (source, target)} - {T.DateType}
    if isinstance(source, TIMES) and isinstance(target, TIMES) and len(stamps) == 1:
        return source if isinstance(target, T.DateType) else target
    return T.StringType()


def _wider_decimal(*types: T.DataType) -> T.DataType:
    shapes = [
        (t.precision, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[type(t)], 0) for t in types
    ]
    scale = max(s for _, s in shapes)
    precision = max(p - s for p, s in shapes) + scale
    return T.DecimalType(precision, scale) if precision <= _MOST_DIGITS else T.StringType()


def key_type(source: T.DataType | None, target: T.DataType | None) -> T.DataType:
    """Type of a key column: that of the history, numbers of two types as long or double.

    Keys identify rows of the history, so they take its type and values must fit it.
    """
    if (same := _only(source, target)) is not None:
        return same
    if isinstance(source, INTEGRAL) and isinstance(target, INTEGRAL):
        return T.LongType()
    if isinstance(source, INTEGRAL + FLOATING) and isinstance(target, INTEGRAL + FLOATING):
        return T.DoubleType()
    return target


def one_family(left: T.DataType, right: T.DataType) -> bool:
    """Are these exact numbers, or dates and times, that compare by value?"""
    pair = (left, right)
    if isinstance(common_type(left, right), T.StringType):
        return False
    return any(all(isinstance(t, family) for t in pair) for family in (EXACT, TIMES))
