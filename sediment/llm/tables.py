"""Reading tables, and writing what several jobs read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.plans.materialize import Kept, working_folder

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows_a_batch(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python workers by the thousand: by default ten times as many go at once."""
    if not 0 < int(spark.conf.get(_ROWS)) <= rows:
        spark.conf.set(_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    few_rows_a_batch(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, tables: Kept | None = None) -> DataFrame:
    """Write ``df`` to the folder in ``spark.checkpoint.dir`` and read it back.

    Lost executors then cost no more than their running tasks, and a join of two such
    tables has plain exchanges on both sides, which adaptive execution can split where
    a key is hot. A local session that names no folder gets one of its own; on a cluster
    that is an error, as executors would not reach it. The table goes with ``tables``;
    without them it stays.
    """
    spark = df.sparkSession
    path = (tables or Kept()).path(spark, working_folder(spark))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
