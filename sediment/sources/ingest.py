"""Reading snapshots and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.casts import checked_cast
from sediment.functions.columns import EFFECTIVE_FROM, EFFECTIVE_TO, IS_CURRENT, ROW_ORDER
from sediment.functions.text import null_if_empty, strip


def load_snapshot(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    *,
    format: str = "csv",
    keep_order: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """Read a snapshot or history table and normalize names, text and metadata.

    Without a ``schema`` the types of a CSV file are inferred, which reads it once
    more. ``multi_line=False`` lets Spark split large CSV files; only files without
    line breaks inside quotes allow it. ``keep_order=True`` adds the row position
    that decides which of several rows with one key is the last.
    """
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.options(
            header=True, inferSchema=schema is None, multiLine=multi_line, escape='"',
            enforceSchema=False,
        )
    df = reader.load(path)
    if not df.columns:
        raise ValueError("CSV file is empty or has no columns.")
    names = df.columns
    if keep_order:
        df = df.select(
            "*",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias(ROW_ORDER),
        )
    return coerce_meta(strip_strings(widen_integers(normalize_names(df, names))))


def normalize_names(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip and lower-case column names; two that become equal are an error."""
    columns = df.columns if columns is None else columns
    names = [c.strip().lower() if c in columns else c for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"Column names are equal after normalization: {repeated}")
    return df.toDF(*names)


def widen_integers(df: DataFrame) -> DataFrame:
    """Give every integer column the type long, however small its values are."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.withColumns(
        {f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema if isinstance(f.dataType, small)}
    )


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip the values of all string columns."""
    return df.withColumns(
        {f.name: strip(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.StringType)}
    )


def parse_flag(col: Column) -> Column:
    """``true``, ``1`` and ``yes`` in any case are true, empty is null, the rest false."""
    # The words that mean true.
    return F.lower(null_if_empty(col.cast("string"))).isin("true", "1", "yes")


def coerce_meta(df: DataFrame) -> DataFrame:
    """Make the metadata columns date, date and boolean; unreadable dates become null.

    A timestamp must be midnight, and any other stops the job: the day alone would say
    something else.
    """
    columns = {}
    for name in (EFFECTIVE_FROM, EFFECTIVE_TO):
        if name not in df.columns or isinstance(df.schema[name].dataType, T.DateType):
            continue
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            columns[name] = checked_cast(
                F.col(name), name, kind, T.DateType(), "table"
            )
        else:
            columns[name] = F.try_to_date(F.col(name).cast("string"), "yyyy-MM-dd")
    if IS_CURRENT in df.columns and not isinstance(df.schema[IS_CURRENT].dataType, T.BooleanType):
        columns[IS_CURRENT] = parse_flag(F.col(IS_CURRENT))
    return df.withColumns(columns)


def align_empty(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give a side without rows the column types of the other side.

    A CSV file with nothing but a header has only text columns; its types say nothing.
    """

    shared = (set(source.columns) & set(target.columns)) - {ROW_ORDER}

    def text_only(df):
        return all(isinstance(df.schema[c].dataType, T.StringType) for c in shared)

    def adopt(empty, other):
        types = {f.name: f.dataType for f in other.schema if f.name in shared}
        columns = [
            F.col(f"`{f.name}`").try_cast(types[f.name]).alias(f.name)
            if f.name in types
            else F.col(f"`{f.name}`")
            for f in empty.schema
        ]
        return empty.select(*columns)

    if text_only(source) and source.isEmpty():
        return adopt(source, target), target
    if text_only(target) and target.isEmpty():
        return source, adopt(target, source)
    return source, target
