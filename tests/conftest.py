import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the test modules whose functions they run.
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])

DAY = datetime.date(2026, 6, 8)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sediment-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows given as tuples, with a DDL schema; dates may be text."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema.replace(" date", " string"))
        wanted = [c.strip().split(" ") for c in schema.split(",")]
        return df.selectExpr(*[f"cast(`{c}` as {t}) as `{c}`" for c, t in wanted])

    return make


HISTORY = "id long, name string, effective_from date, effective_to date, is_current boolean"


@pytest.fixture
def history(frame):
    return lambda *rows: frame(list(rows), HISTORY)


@pytest.fixture
def snapshot(frame):
    return lambda *rows: frame(list(rows), "id long, name string")


def rows(df, *columns):
    """The rows of a frame as a sorted list of tuples."""
    picked = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
