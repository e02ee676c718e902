"""SimHash near-duplicates, found at the anchors of a covering code."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.graph import components
from sediment.llm.tables import free_name, kept, text_or_empty

SEED = 42
BITS = 64
_SLICE = 1 << 16


def shingle_hashes(text: str, length: int) -> list[int]:
    """XXH64 of every shingle of ``length`` words; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    if len(words) < length:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    shingles = map(b" ".join, zip(*(words[i:] for i in range(length)), strict=False))
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def fingerprint(text: str, length: int) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    hashes = shingle_hashes(text, length)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = np.array(hashes[i : i + _SLICE], np.uint64).astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return int(value.astype(np.int64))


def fingerprint_column(column: str, shingle: int):
    """The fingerprint of a text column (null: that of the empty text, zero)."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return fingerprints(text_or_empty(column))


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs ``u``, ``v`` of distinct fingerprints ``fp`` that differ in 1 to ``distance`` bits.

    The bits are cut into ``distance // 2 + 1`` parts, so that two linked fingerprints
    differ by at most one bit in some part. Anchors of a part are the words of the
    Hamming code over its first 2^r - 1 bits: every value is within one bit of exactly
    one anchor (covering radius 1). A fingerprint goes to all anchors within radius plus
    threshold, 1 + 1 bits, and is compared there with those whose nearest anchor it is.
    """
    parts = distance // 2 + 1
    width = BITS // parts
    order = int(np.log2(width + 1))
    size = (1 << order) - 1
    sides = []
    for part in range(parts):
        value = f"(shiftrightunsigned(fp, {part * width}) & {(1 << size) - 1}L)"
        # The syndrome: XOR of the places (from 1) of the bits that are set.
        checks = [sum(1 << (i - 1) for i in range(1, size + 1) if i >> k & 1) for k in range(order)]
        syndrome = " + ".join(
            f"shiftleft(bit_count({value} & {mask}L) % 2, {k})" for k, mask in enumerate(checks)
        )
        sides.append(
            prints.select(
                "fp",
                F.lit(part).alias("part"),
                F.expr(value).alias("value"),
                F.expr(f"cast({syndrome} as int)").alias("syndrome"),
            )
        )
    placed = sides[0]
    for side in sides[1:]:
        placed = placed.unionByName(side)
    nearest = "if(syndrome = 0, value, value ^ shiftleft(1L, syndrome - 1))"
    two_off = (
        f"transform(filter(sequence(1, {size}), i -> syndrome > 0 and i < (i ^ syndrome)), "
        "i -> value ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ syndrome) - 1))"
    )
    homes = placed.select("part", F.expr(nearest).alias("anchor"), F.col("fp").alias("u"))
    copies = placed.select(
        "part",
        F.explode(F.expr(f"concat(array({nearest}), {two_off})")).alias("anchor"),
        F.col("fp").alias("v"),
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    return (
        copies.join(homes, ["part", "anchor"])
        .filter((F.col("u") != F.col("v")) & near)
        .select("u", "v")
    )


def simhash_groups(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    distance: int = 2,
) -> DataFrame:
    """Per row: the id, ``fp`` (signed 64-bit) and ``component_id``.

    ``component_id`` is the smallest id that can be reached over links, its own included.
    Rows of one fingerprint are in one component without being compared; so are null and
    empty texts, whose fingerprint is zero. Rows that repeat an id stay rows of their own,
    and a component of nothing but null ids has a null one.
    """
    rows = kept(
        docs.select(
            F.col(f"`{id_column}`").alias(id_column),
            fingerprint_column(text_column, shingle).alias("fp"),
        )
    )
    prints = kept(rows.groupBy("fp").agg(F.min(id_column).alias("first")))
    found = components(links(prints.select("fp"), distance))
    rooted = kept(
        prints.join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    firsts = kept(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    by_print = kept(rooted.join(firsts, "root").select("fp", "component_id"))
    return rows.join(by_print, "fp", "left").select(id_column, "fp", "component_id")


def drop_near_copies(docs: DataFrame, *, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One document of each group stays: the one with the smallest ``doc_id``.

    Of rows that repeat this id and its fingerprint the one with the smallest hash of its
    text stays, and of those the one with the smallest hash of all columns; null ids are
    one id, which stays only where its group has no other. Columns are those of ``docs``;
    an empty table stays empty.
    """
    groups = simhash_groups(docs, shingle=shingle, distance=distance)
    own, its_id, its_print = (free_name(docs, n) for n in ("__fp", "__id", "__print"))
    stay = (
        groups.groupBy("component_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")).alias("it"))
        .select(F.col("it.doc_id").alias(its_id), F.col("it.fp").alias(its_print))
    )
    stay = kept(stay.distinct())
    marked = docs.withColumn(own, fingerprint_column("text", shingle))
    # Null-safe also for fingerprints, which are never null: a filter for that would make them twice.
    same = F.col("doc_id").eqNullSafe(F.col(its_id)) & F.col(own).eqNullSafe(F.col(its_print))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.xxhash64("text"), F.xxhash64(*columns))
    return (
        marked.join(stay, same, "left_semi")
        .groupBy(F.col("doc_id").alias("of"), F.col(own).alias("fp"))
        .agg(F.min_by(F.struct(*columns), order).alias("row"))
        .select("row.*")
    )
