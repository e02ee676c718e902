"""Optimal length buckets, and batches of a token budget inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.tables import kept, text_or_empty


def word_count(column: str) -> Column:
    """Words between spaces, tabs and line ends; 0 for null."""
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding in all.

    Dynamic programming over the distinct lengths in rising order: the best cost of the
    first j lengths in k buckets is the least, over i, of the best cost of the first i
    in k - 1 and the padding of those between. Of equally good last buckets the longest
    wins (smallest i).
    """
    size = len(lengths)
    if not size:
        return []
    n = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    total = np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64) * np.asarray(counts, np.int64))))
    far = np.iinfo(np.int64).max // 4
    best = np.full(size + 1, far)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, size)):
        after, chosen = np.full(size + 1, far), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            chosen[j] = cost.argmin()
            after[j] = cost[chosen[j]]
        best = after
        choices.append(chosen)
    j, bounds = size, []
    for chosen in reversed(choices):
        bounds.append(int(lengths[j - 1]))
        j = int(chosen[j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    *,
    longest: int = 2048,
    buckets: int = 8,
    budget: int = 32_768,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: Column | None = None,
) -> DataFrame:
    """Batches of sequences of about equal length.

    Texts of more than ``longest`` tokens are cut into sequences of that length and a
    rest. Buckets are chosen to minimise the padding of all sequences. Within a bucket,
    sequences in order of id, place and length fill batches of ``budget`` tokens,
    padding included (of one sequence at least). Per sequence: the id, ``part`` (from 0),
    ``n_tokens``, ``bucket`` (its padded length), ``batch`` and ``slot`` (from 0 in each
    bucket and batch). ``length`` is the number of tokens of a row; by default words.
    Null and empty texts are one sequence of no tokens. Rows that repeat are packed each.

    The histogram has at most ``longest`` + 1 rows, whatever the input. Sequences are
    numbered in ranges: within each range, after the numbers of the ranges before.
    """
    tokens = word_count(text_column) if length is None else length.cast("long")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(tokens, F.lit(0)).alias("tokens"))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / longest) - 1, F.lit(0)))
    sequences = kept(
        rows.select("id", "tokens", F.explode(parts).alias("part")).select(
            "id", "part", F.least(F.col("tokens") - F.col("part") * longest, F.lit(longest)).alias("n_tokens")
        )
    )
    histogram = sorted(sequences.groupBy("n_tokens").count().collect())  # at most longest + 1 rows
    bounds = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bucket = F.lit(bounds[-1] if bounds else 0)
    for bound in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    order = ["bucket", "id", "part", "n_tokens"]
    spread = sequences.withColumn("bucket", bucket.cast("long")).repartitionByRange(*order)
    placed = kept(spread.withColumn("range", F.spark_partition_id()))
    sizes = placed.groupBy("range", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("range", "bucket").orderBy("id", "part", "n_tokens")
    number = F.col("before") + F.row_number().over(within) - 1
    each = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1))), F.lit(1))
    return placed.join(kept(offsets), ["range", "bucket"]).withColumn("number", number).select(
        F.col("id").alias(id_column), "part", "n_tokens", "bucket",
        F.floor(F.col("number") / each).alias("batch"), (F.col("number") % each).alias("slot"),
    )
