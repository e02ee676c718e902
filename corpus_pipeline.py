"""From raw documents to packed training batches: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import line_dedup, packing, repeats, simhash, toxicity
from sediment.llm.tables import few_rows_a_batch, kept, table

# Lines go before copies are merged, so exact copies count as one page of their site.
LINE_RATIO, LINE_LEAST = 0.1, 3
# Bytes of repeated passages: over 50 words of five letters and a space or less.
REPEAT = 256


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date where ``text`` has become shorter."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; weights are learned from labelled documents of the input."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over a tenth of a host's different texts, and three at least, go from its documents."""
    return _counted(line_dedup.drop_lines(docs, ratio=LINE_RATIO, least=LINE_LEAST, copies=False))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    few_rows_a_batch(spark)
    return simhash.drop_near_copies(docs, shingle=3, distance=2)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages found more than once go from every document that has them."""
    few_rows_a_batch(spark)
    return _counted(repeats.drop_repeats(docs, length=REPEAT))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as sequences in batches; see ``packing.pack``."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash", drop_near_copies),
    ("repeats", drop_repeats),
    ("packing", pack),
]

#: Learned weights, fingerprints and refined buckets have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the sequences of the last one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs
