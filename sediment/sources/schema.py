"""Finding the business key and the tracked columns; are two tables compatible?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.columns import META, data_columns

# Endings that mark a key column, and names that are keys by themselves.
KEY_ENDINGS = ("_id", "_key", "_code", "_no", "_num", "_number", "id", "key", "code")
KEY_NAMES = ("id", "key")

# Points for the ending, for the whole name and for unique values.
ENDING_POINTS = 30
NAME_POINTS = 15
UNIQUE_POINTS = 10

# Rows of the sample that refutes columns which are not unique.
SAMPLE = 10_000


def name_score(column: str) -> int:
    """Points a column name earns as a business key."""
    name = column.lower()
    return ENDING_POINTS * name.endswith(KEY_ENDINGS) + NAME_POINTS * (name in KEY_NAMES)


def shared_columns(source: DataFrame, target: DataFrame) -> list[str]:
    return sorted(set(data_columns(source)) & set(data_columns(target)))


def unique_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that have no value twice; null counts as a value.

    A sample of rows refutes most of them in one job. Each of the others is then tested
    by itself: only that column is shuffled, and the first repeated value ends the test.
    """
    if not columns:
        return []
    different = [
        (F.size(F.collect_set(F.col(f"`{c}`"))) + F.coalesce(F.max(F.col(f"`{c}`").isNull().cast("int")), F.lit(0)))
        for c in columns
    ]
    first = df.select(*[f"`{c}`" for c in columns]).limit(SAMPLE)
    rows, *numbers = first.agg(F.count(F.lit(1)), *different).first()
    left = [c for c, n in zip(columns, numbers, strict=True) if n == rows]
    if rows < SAMPLE:  # that was the whole table
        return left
    counted = F.count(F.lit(1)).alias("rows")
    return [c for c in left if df.groupBy(f"`{c}`").agg(counted).filter("rows > 1").isEmpty()]


def key_scores(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every shared column with its score as a business key: ``column_name``, ``score``."""
    columns = shared_columns(source, target)
    if not columns:
        raise ValueError("No shared columns between source and target. Cannot detect a business key.")
    unique = set(unique_columns(source, columns))
    scores = [(c, name_score(c) + UNIQUE_POINTS * (c in unique)) for c in columns]
    return source.sparkSession.createDataFrame(scores, "column_name string, score int")


def detect_business_key(source: DataFrame, target: DataFrame) -> list[str]:
    """The shared columns that tie at the best score; the first one if none scores.

    The bonus for unique values is smaller than the gaps between name scores, so only
    the columns with the best name are tested for it.
    """
    columns = shared_columns(source, target)
    if not columns:
        raise ValueError("No shared columns between source and target. Cannot detect a business key.")
    best = max(map(name_score, columns))
    top = [c for c in columns if name_score(c) == best]
    if best and len(top) == 1:
        return top
    unique = unique_columns(source, top)
    if unique:
        return unique
    return top if best else columns[:1]


def detect_tracked(source: DataFrame, key: list[str]) -> list[str]:
    """All data columns of the snapshot outside the key, sorted."""
    return sorted(c for c in data_columns(source) if c not in key)


def check_compatibility(source: DataFrame, target: DataFrame) -> list[str]:
    """What keeps these two tables from being compared; empty if nothing does."""
    meta = set(META)
    source_columns = set(data_columns(source)) | (meta & set(source.columns))
    messages = []
    if not source.columns:
        messages.append("Source CSV has no columns.")
    if not target.columns:
        messages.append("Target CSV has no columns.")
    if reserved := sorted(meta & source_columns):
        messages.append(f"Source CSV should not contain SCD2 metadata columns: {reserved}")
    missing = sorted(meta - set(target.columns))
    if missing:
        messages.append(f"Target CSV is missing required SCD2 columns: {missing}")
    unknown = sorted(source_columns - set(data_columns(target)))
    if unknown and not missing:
        messages.append(f"Source columns not found in target: {unknown}")
    return messages


def require_compatible(source: DataFrame, target: DataFrame) -> None:
    if messages := check_compatibility(source, target):
        raise ValueError(f"CSV validation errors: {'; '.join(messages)}")
