"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import kept


def components(edges: DataFrame) -> DataFrame:
    """Components of the graph with edges (``u``, ``v``): one row per node that has an edge.

    Returns ``node`` and ``root``, the smallest node of its component. Every round each
    node steps to that one of itself and its neighbours which comes first in an order
    drawn anew for the round; edges are then drawn between the places reached. The
    order being random, the number of edges falls by a factor each round, also on long
    chains, and the rounds stop when no edge is left. Steps of all rounds are then
    followed back to front. Nothing but a row count reaches the driver.
    """
    edges = kept(_tidy(edges))
    steps: list[DataFrame] = []
    while edges.count():
        turn = F.lit(len(steps))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = F.min(F.struct(F.xxhash64(turn, "v").alias("h"), F.col("v").alias("n")))
        own = F.struct(F.xxhash64(turn, "u").alias("h"), F.col("u").alias("n"))
        step = kept(
            both.groupBy("u").agg(first.alias("m"))
            .select(F.col("u").alias("node"), F.least("m", own)["n"].alias("to"))
        )
        steps.append(step)
        left = step.select(F.col("node").alias("u"), F.col("to").alias("new_u"))
        right = step.select(F.col("node").alias("v"), F.col("to").alias("new_v"))
        moved = kept(edges.join(left, "u").select("new_u", "v"))
        edges = kept(
            _tidy(moved.join(right, "v").select(F.col("new_u").alias("u"), F.col("new_v").alias("v")))
        )
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("root"))
    places = steps[-1]
    for step in reversed(steps[:-1]):
        after = places.select(F.col("node").alias("to"), F.col("to").alias("end"))
        places = kept(
            step.join(after, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        )
    smallest = kept(places.groupBy("to").agg(F.min("node").alias("root")))
    return kept(places.join(smallest, "to").select("node", "root"))


def _tidy(edges: DataFrame) -> DataFrame:
    return (
        edges.filter(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
