"""Registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from sediment.llm.queries import ORACLES, QUERIES
from sediment.llm.tables import kept

DATA = "/root/testdata/sf0.001"


def _rows(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [d[0] for d in cursor.description]
    expected = _rows((dict(zip(order, r, strict=True)) for r in cursor.fetchall()), columns)
    frame = QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == columns
    assert _rows((r.asDict() for r in frame.collect()), columns) == expected


def test_stages(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "repeats", "packing"]
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = kept(stage(spark, docs, DATA))
        assert after.columns == documents.columns
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        if name in ("line_dedup", "repeats"):
            assert after.count() == docs.count()
        assert after.filter("n_chars <> length(text)").count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_boilerplate_goes_and_copies_keep_their_lines(spark):
    """A line on 12 of 100 pages goes; a third of a host that is one text, copied, stays."""
    rows = [(i, f"page {i}" + ("\nplanted line" if i < 12 else ""), "a") for i in range(100)]
    rows += [(200 + i, "copied text\nof two lines" if i < 5 else f"own {i}", "b") for i in range(15)]
    rows += [(300 + i, f"small {i}" + ("\nplanted line" if i < 3 else ""), "c") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "length(text) n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, DATA).collect()}
    assert got == {i: text.replace("\nplanted line", "") for i, text, _ in rows}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
