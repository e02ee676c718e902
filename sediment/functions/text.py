"""Column expressions that turn values into text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.types import common_type, one_family

# Every character ``str.strip`` removes; all of them lie below U+3001.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` removes only spaces)."""
    return F.btrim(col, F.lit(WHITESPACE))


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def display(col: Column, dtype: T.DataType) -> Column:
    """Text of a value as reports print it; null stays null.

    Differs from ``cast('string')`` for booleans (``True``), floats (``1e+16``,
    ``12345678.5``) and timestamps (six digits of microseconds, or none).
    """
    if isinstance(dtype, T.StringType):
        return col
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _float_text(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(col, "SSSSSS")
        return F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros))
    return col.cast("string")


def _float_text(col: Column) -> Column:
    # Spark prints an exponent from 1e7 up and below 1e-3; reports only from 1e16
    # up and below 1e-4, so the numbers between are written out digit by digit.
    text = col.cast("double").cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.rtrim(F.regexp_replace(mantissa, "[-.]", ""), F.lit("0"))
    count = F.length(digits)
    whole = exponent + 1
    plain = F.when(
        count <= whole, F.concat(F.rpad(digits, whole, F.lit("0")), F.lit(".0"))
    ).otherwise(
        F.concat(
            F.substr(digits, F.lit(1), whole), F.lit("."), F.substr(digits, whole + 1, count)
        )
    )
    scientific = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)),
        F.when(count > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2), count))).otherwise(""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when(col.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(col), "nan")
        .when(text == "Infinity", "inf")
        .when(text == "-Infinity", "-inf")
        .when(~text.contains("E"), text)
        .when(exponent.between(0, 15), F.concat(sign, plain))
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .otherwise(F.concat(sign, scientific))
    )


def printed(col: Column, dtype: T.DataType, null: str = "None") -> Column:
    """``display`` with a word for null."""
    return F.coalesce(display(col, dtype), F.lit(null))


def norm(col: Column, dtype: T.DataType) -> Column:
    """Comparison form of a tracked value: stripped text, empty text is null."""
    return null_if_empty(strip(display(col, dtype)))


def same_value(
    left: Column, left_type: T.DataType, right: Column, right_type: T.DataType
) -> Column:
    """Do two tracked values agree?

    Values of one exact type agree when they are equal, so no text is built for
    them, and so do numbers without a floating point, or dates and times, of two types.
    All others agree if they print alike. Text is compared raw first and stripped only
    where that differs.
    """
    exact = not isinstance(left_type, (T.StringType, T.FloatType, T.DoubleType))
    if left_type == right_type and exact:
        return left.eqNullSafe(right)
    if left_type != right_type and one_family(left_type, right_type):
        both = common_type(left_type, right_type)
        return left.cast(both).eqNullSafe(right.cast(both))
    by_text = norm(left, left_type).eqNullSafe(norm(right, right_type))
    if left_type != right_type or not isinstance(left_type, T.StringType):
        return by_text
    return F.when(left.eqNullSafe(right), F.lit(True)).otherwise(by_text)


def key_label(key: list[str], schema: T.StructType) -> Column:
    """``k=v, k2=v2`` for the key columns of a row."""
    parts = [F.concat(F.lit(f"{k}="), printed(F.col(f"`{k}`"), schema[k].dataType)) for k in key]
    return F.concat_ws(", ", *parts)
