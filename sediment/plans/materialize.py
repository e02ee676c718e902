"""Keeping intermediate results that several jobs read, and letting go of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str | None:
    """Folder all executors reach, if the session names one."""
    return spark.conf.get(_SETTING, None) or None


def working_folder(spark: SparkSession) -> str:
    """The shared folder; a new temporary one where driver and executors are one process."""
    folder = shared_folder(spark)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {_SETTING} to a folder that all executors reach.")
    folder = tempfile.mkdtemp(prefix="sediment-")
    spark.conf.set(_SETTING, folder)
    return folder


class Kept:
    """Results that were kept: closing it removes their tables and frees their memory.

    Frames that read them are of no use afterwards. It can serve as a context.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.frames: list[DataFrame] = []
        self._spark: SparkSession | None = None

    def materialize(self, df: DataFrame, folder: str | None = None) -> DataFrame:
        """Write ``df`` once and read it back, so later jobs neither redo nor lose it.

        The table goes to the shared folder of the session (or ``folder``), where it
        outlives lost executors, and later jobs read only the columns they use. In a
        session without such a folder the frame is persisted; Spark recomputes lost parts.
        """
        self._spark = df.sparkSession
        folder = folder or shared_folder(df.sparkSession)
        if not folder:
            self.frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return self.frames[-1]
        path = self.path(df.sparkSession, folder)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def path(self, spark: SparkSession, folder: str) -> str:
        """A new path in ``folder`` that goes with the other tables."""
        self._spark = spark
        self.paths.append(f"{folder.rstrip('/')}/sediment-{uuid.uuid4().hex}")
        return self.paths[-1]

    def close(self) -> None:
        while self.frames:
            self.frames.pop().unpersist()
        while self.paths:
            remove(self._spark, self.paths.pop())

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def materialize(df: DataFrame, folder: str | None = None, kept: Kept | None = None) -> DataFrame:
    """``Kept.materialize`` into ``kept``, or for as long as the caller cares to keep it."""
    return (kept or Kept()).materialize(df, folder)


def file_system(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote."""
    file, system = file_system(spark, path)
    system.delete(file, True)


def exists(spark: SparkSession, path: str) -> bool:
    file, system = file_system(spark, path)
    return system.exists(file)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    file, system = file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(file)] if system.exists(file) else []
