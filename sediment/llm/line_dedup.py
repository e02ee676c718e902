"""Lines that a large part of a site's pages share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import free_name, kept, text_or_empty


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits for a line without the white space around it; null for a blank one."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(
        bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))
    )


def boilerplate(
    docs: DataFrame, *, ratio: float, least: int, host_column: str = "source", text_column: str = "text",
    copies: bool = True,
) -> DataFrame:
    """Per host its ``keys``: lines on more than ``ratio`` of its pages, and on ``least`` at least.

    A page counts once for each of its lines. Without ``copies`` pages of a host with the
    same whole text count as one page, both for a line and in the host's total. Lines are reduced to their hashes and to
    one count a host before anything is shuffled, so a host with a third of all pages
    is spread over tasks by its lines. A host has fewer keys than the average number of
    lines on its pages divided by ``ratio``, which bounds the array.
    """
    text = text_or_empty(text_column)
    pages = docs.select(
        F.col(f"`{host_column}`").alias("host"),
        F.array_distinct(F.transform(_lines(text), _key)).alias("keys"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"),
    )
    if not copies:
        pages = kept(pages.groupBy("host", "a", "b").agg(F.first("keys").alias("keys")))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        pages.select("host", F.explode(F.array_compact("keys")).alias("key"))
        .groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
    )
    totals = totals.withColumnRenamed("host", "site")
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("site")))
        .filter(F.col("n") > F.col("pages") * ratio)
        .groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    )


def _with_keys(
    docs: DataFrame, keys: str, ratio: float, least: int, host_column: str, text_column: str, copies: bool = True
) -> DataFrame:
    """``docs`` with a column ``keys``, the boilerplate of each row's host.

    The table of hosts is written first, so that its size is known: below the session's
    threshold it is broadcast, beyond it the rows are joined by host, and adaptive
    execution splits a host with very many.
    """
    site = free_name(docs, "__site")
    found = kept(
        boilerplate(
            docs, ratio=ratio, least=least, host_column=host_column, text_column=text_column, copies=copies
        ).select(F.col("host").alias(site), F.col("keys").alias(keys))
    )
    return docs.join(found, F.col(f"`{host_column}`").eqNullSafe(F.col(site)), "left").drop(site)


def _left(lines: Column, keys: str) -> Column:
    def stays(line):
        key = _key(line)
        return key.isNull() | ~F.array_contains(F.col(keys), key)

    return F.filter(lines, stays)


def strip_lines(
    docs: DataFrame,
    *,
    ratio: float = 0.1,
    least: int = 5,
    id_column: str = "doc_id",
    host_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """Drops from every text the lines that too many pages of its host have.

    Per row: the id, ``n_lines``, ``n_removed``, ``text``. A line is boilerplate if more
    than ``ratio`` of the host's pages have it, and at least ``least`` pages. Lines end at
    line feeds and are compared without white space at their ends; blank lines always
    stay. A null host is a host of its own; an empty table gives no rows. A null text counts as the empty text, which
    is one blank line. Rows that repeat are pages of their own.
    """
    rows = docs.select(
        *[F.col(f"`{c}`").alias(c) for c in dict.fromkeys((id_column, host_column))],
        text_or_empty(text_column).alias(text_column),
    )
    keys = free_name(rows, "__keys")
    joined = _with_keys(rows, keys, ratio, least, host_column, text_column)
    lines = _lines(F.col(f"`{text_column}`"))
    left = F.when(F.col(keys).isNull(), lines).otherwise(_left(lines, keys))
    return joined.select(
        F.col(f"`{id_column}`"), F.size(lines).cast("long").alias("n_lines"), left.alias("__left")
    ).select(
        F.col(f"`{id_column}`"), "n_lines", (F.col("n_lines") - F.size("__left")).alias("n_removed"),
        F.array_join("__left", "\n").alias("text"),
    )


def drop_lines(docs: DataFrame, *, ratio: float = 0.1, least: int = 5, copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; rows and columns stay as they are."""
    keys = free_name(docs, "__keys")
    joined = _with_keys(docs, keys, ratio, least, "source", "text", copies)
    text = F.when(
        F.col(keys).isNotNull() & F.col("text").isNotNull(),
        F.array_join(_left(_lines(F.col("text")), keys), "\n"),
    ).otherwise(F.col("text"))
    return joined.withColumn("text", text).select([F.col(f"`{c}`") for c in docs.columns])
