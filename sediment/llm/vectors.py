"""Near-duplicate vectors: NN-descent over a neighbour graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.graph import components
from sediment.llm.tables import kept

_BLOCK = 512  # vectors of one code that are compared with each other
_CENTRES = 128  # neighbourhoods that one call of Python refines
_CELL = 2048  # vectors of a component in a block, compared _BLOCK rows at a time
_LINKED = 32  # vectors with links that an audit should have
_CANDIDATE = "u long, v long, sim double, new boolean"


@dataclass(frozen=True)
class Settings:
    """Of the neighbour graph.

    ``neighbours``: length of a list. ``tables``: random partitions that the first lists
    come from, at least; the more vectors, the longer the codes and the more there are.
    ``rounds``: of refinement at most; they end when less than ``settled`` of all lists
    change. ``audited``: vectors whose links are counted exactly, up to 16 times as many
    where few have links, and vectors that a noisy copy is planted for. ``recall``: the share of links that must be found, or twice as
    many tables are added; after as many ``tries`` the job stops.
    """

    neighbours: int = 10
    tables: int = 8
    rounds: int = 4
    settled: float = 0.002
    audited: int = 256
    recall: float = 0.97
    tries: int = 3


@dataclass(frozen=True)
class Found:
    """``rows``: one a vector. ``recall``: the lower one of the shares found of audited and
    of planted links; 1 if there is nothing to find. ``rounds``: of refinement, in all."""

    rows: DataFrame
    recall: float
    rounds: int


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors of length 1 in double precision; none for those that cannot be compared."""
    for batch in batches:
        out = []
        for raw in batch["raw"]:
            x = np.array([np.nan if v is None else v for v in raw], np.float64) if raw is not None else np.empty(0)
            largest = np.abs(x).max() if len(x) else 0.0
            if np.isfinite(largest) and largest > 0:
                x = x / largest
                out.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())  # no negative zeros
            else:
                out.append(None)
        batch["vector"] = out
        yield batch[["id", "vector"]]


def _best(sims: np.ndarray, nodes: np.ndarray, keep: int) -> pd.DataFrame:
    """Of every row of every square in ``sims`` the ``keep`` largest; ties by smaller place.
    ``nodes`` has a row a square. What is -inf is left out."""
    order = np.argsort(-sims, axis=2, kind="stable")[:, :, :keep]
    best = np.take_along_axis(sims, order, 2)
    square, row, place = np.nonzero(best > -np.inf)
    v = nodes[square, order[square, row, place]]
    return pd.DataFrame({"u": nodes[square, row], "v": v, "sim": best[square, row, place], "new": True})


def _nearest_in_block(keep: int):
    """Candidates of a block: the nearest others in other places, none of them planted."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        x, place = _matrix(group["vector"]), group["place"].to_numpy()
        sims = x @ x.T
        sims[(place[:, None] == place[None, :]) | group["planted"].to_numpy()[None, :]] = -np.inf
        return _best(sims[None], group["node"].to_numpy()[None], keep)

    return run


def _nearest_around(keep: int):
    """Candidates of many neighbourhoods at once, from pairs of which one is new to the
    centre, and only those that are nearer than the end of a list."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["centre", "node"])
        _, row, sizes = np.unique(group["centre"].to_numpy(), return_inverse=True, return_counts=True)
        column = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def laid_out(values: np.ndarray, empty) -> np.ndarray:
            out = np.full((len(sizes), sizes.max()) + values.shape[1:], empty, values.dtype)
            out[row, column] = values
            return out

        there = laid_out(np.ones(len(group), bool), False)
        node, place, new, planted, worst = (
            laid_out(group[c].to_numpy(), empty)
            for c, empty in (("node", 0), ("place", 0), ("new", False), ("planted", False), ("worst", np.inf))
        )
        x = laid_out(_matrix(group["vector"]), 0.0)
        sims = x @ x.transpose(0, 2, 1)
        wanted = there[:, :, None] & (there & ~planted)[:, None, :] & (place[:, :, None] != place[:, None, :])
        wanted &= (new[:, :, None] | new[:, None, :]) & (sims > worst[:, :, None])
        sims[~wanted] = -np.inf
        return _best(sims, node, keep)

    return run


def _signs(first: int, tables: int, bits: int):
    """The codes of a vector: the sides of random planes it is on, in each table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _matrix(batch["vector"])
            for t in range(first, first + tables):
                planes = np.random.default_rng(t).standard_normal((bits, x.shape[1]))
                code = ((x @ planes.T > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"node": batch["node"], "table": t, "code": code})

    return run


def _shortest(candidates: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best different neighbours of each ``u``, as a sorted list of (far, v, new).
    Tasks drop what cannot be among them before anything is shuffled by ``u``."""
    pairs = candidates.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    nearest = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    best = pairs.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= keep)
    entry = F.struct((-F.col("sim")).alias("far"), "v", "new")
    return best.groupBy("u").agg(F.sort_array(F.collect_list(entry)).alias("list"))


def _pairs(graph: DataFrame) -> DataFrame:
    """The entries of all lists, as (u, v, sim, new)."""
    return graph.select("u", F.explode("list").alias("e")).select("u", "e.v", (-F.col("e.far")).alias("sim"), "e.new")


def _bits(count: int) -> int:
    """Length of the codes of so many vectors."""
    return max(0, int(np.ceil(np.log2(max(count, 1) / (_BLOCK / 4)))))


def _tables(bits: int, threshold: float, settings: Settings) -> int:
    """So many that a pair at the threshold shares a code in one with the recall's chance."""
    shared = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    if shared >= settings.recall or settings.recall >= 1:
        return settings.tables
    return max(settings.tables, int(np.ceil(np.log(1 - settings.recall) / np.log1p(-shared))))


def _first_lists(vectors: DataFrame, count: int, threshold: float, attempt: int, settings: Settings) -> DataFrame:
    """Candidates from random partitions; a code with many vectors is dealt out in blocks.

    Every attempt has partitions of its own, twice as many as the one before.
    """
    bits = _bits(count)
    tables = _tables(bits, threshold, settings)
    first, tables = tables * (2**attempt - 1), tables * 2**attempt
    coded = kept(vectors.select("node", "vector").mapInPandas(_signs(first, tables, bits), "node long, table int, code long"))
    sizes = coded.groupBy("table", "code").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
    dealt = coded.join(kept(sizes), ["table", "code"]).select(
        "table", "code", "node", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).alias("block")
    )
    return dealt.join(vectors, "node").groupBy("table", "code", "block").applyInPandas(
        _nearest_in_block(settings.neighbours), _CANDIDATE
    )


def _around(graph: DataFrame, vectors: DataFrame, known: DataFrame | None, count: int, keep: int) -> DataFrame:
    """Candidates among the neighbours of each vector, itself and some it is a neighbour of.

    Of the lists that a vector is in, ``keep`` are used, new ones before those drawn by
    hash, so that no centre has more than 3 * ``keep`` + 1 members; what that leaves open is
    for later rounds. Pairs that met in an earlier round are not compared again, and centres
    without a new member not visited. ``known`` are neighbours from an earlier search, in
    the place of the vector itself.
    """
    pairs = _pairs(graph)
    drawn = Window.partitionBy("v").orderBy(F.col("new").desc(), F.xxhash64("u", "v"))
    back = pairs.withColumn("n", F.row_number().over(drawn)).filter(F.col("n") <= keep)
    members = (
        pairs.select(F.col("u").alias("centre"), F.col("v").alias("node"), "new")
        .unionByName(back.select(F.col("v").alias("centre"), F.col("u").alias("node"), "new"))
        .unionByName(graph.select(F.col("u").alias("centre"), F.col("u").alias("node"), F.lit(False).alias("new")))
    )
    if known is not None:
        inside = _pairs(known).join(graph.select("u"), "u", "left_semi")
        members = members.unionByName(
            inside.select(F.col("u").alias("centre"), F.col("v").alias("node"), F.lit(True).alias("new"))
        )
    busy = members.withColumn("any", F.max("new").over(Window.partitionBy("centre"))).filter("any")
    ends = graph.filter(F.size("list") >= keep).select(
        F.col("u").alias("node"), (-F.element_at("list", keep)["far"]).alias("worst")
    )
    held = vectors.join(ends, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    together = F.pmod(F.xxhash64("centre"), F.lit(max(1, -(-count // _CENTRES))))
    return (
        busy.groupBy("centre", "node").agg(F.max("new").alias("new"))
        .join(held, "node").withColumn("together", together)
        .groupBy("together").applyInPandas(lambda group: _nearest_around(keep)(group), _CANDIDATE)
    )


def _settled(graph: DataFrame) -> DataFrame:
    """The entries of all lists, as ones that have met the others."""
    return _pairs(graph).withColumn("new", F.lit(False))


def _search(
    vectors: DataFrame, graph: DataFrame | None, known: DataFrame | None, threshold: float, attempt: int,
    settings: Settings,
) -> tuple[DataFrame, int]:
    """Lists of the nearest vectors in other places, and the rounds they took."""
    count = vectors.count()
    candidates = _first_lists(vectors, count, threshold, attempt, settings)
    if graph is not None:
        candidates = candidates.unionByName(_settled(graph))
    graph, rounds = kept(_shortest(candidates, settings.neighbours)), 0
    while rounds < settings.rounds:
        more = _around(graph, vectors, known, count, settings.neighbours).unionByName(_settled(graph))
        graph, rounds = kept(_shortest(more, settings.neighbours)), rounds + 1
        changed = graph.filter(F.exists("list", lambda e: e["new"])).count()
        if changed <= settings.settled * count:
            break
    return graph, rounds


def _edges(graph: DataFrame, threshold: float) -> DataFrame:
    return (
        _pairs(graph).filter(F.col("sim") >= threshold)
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )


def _full(graph: DataFrame, threshold: float, settings: Settings) -> DataFrame:
    """Nodes whose list is full of links, so that it may hide more."""
    return graph.filter(
        (F.size("list") >= settings.neighbours) & (-F.element_at("list", settings.neighbours)["far"] >= threshold)
    ).select(F.col("u").alias("node"))


def _linked(graph: DataFrame, nodes: DataFrame, threshold: float, attempt: int, settings: Settings):
    """Edges of links, components of them, and the components to compare as a whole.

    A list full of links is made longer by the whole component that its vector is in, to be
    compared block by block, and by a list of the nearest vectors outside it. As long as
    such lists hold links, components grow together; those full of links are made longer
    again. A link that is in no list has a full list at both ends, so each search is only
    among the vectors whose last list was full.
    """
    near = kept(_edges(graph, threshold))
    found = components(near)
    full = kept(_full(graph, threshold, settings))
    hiding, rounds = full, 0
    while hiding.limit(1).count():
        vectors = kept(
            found.join(hiding, "node", "left_semi").join(nodes.select("node", "vector"), "node")
            .select("node", "vector", F.col("root").alias("place"), F.lit(False).alias("planted"))
        )
        if vectors.select("place").distinct().limit(2).count() < 2:
            break
        outside, n = _search(vectors, None, graph, threshold, attempt, settings)
        rounds += n
        more = kept(_edges(outside, threshold))
        if not more.limit(1).count():
            break
        near = kept(near.unionByName(more).distinct())
        found = components(near)
        hiding = kept(_full(outside, threshold, settings))
    wide = kept(found.join(full, "node", "left_semi").select("root").distinct())
    return near, found, wide, rounds


def _links_within(threshold: float):
    """Links between two blocks of one component, or within one; counts weighed by copies."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        side = group["own"].to_numpy()
        left, right = group[side == low], group[side == high]
        a, b = _matrix(left["vector"]), _matrix(right["vector"])
        ids, weights = right["node"].to_numpy(), right["copies"].to_numpy()
        own, copies = left["node"].to_numpy(), left["copies"].to_numpy()
        n, linked = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        parts = []
        for i in range(0, len(left) if len(right) else 0, _BLOCK):
            rows = slice(i, i + _BLOCK)
            near = (a[rows] @ b.T >= threshold) & (own[rows, None] != ids[None, :])
            parts.append(pd.DataFrame({"node": own[rows], "n": near @ weights, "linked": near.sum(1)}))
            if low != high:
                n, linked = n + near.T @ copies[rows], linked + near.sum(0)
        if low != high:
            parts.append(pd.DataFrame({"node": ids, "n": n, "linked": linked}))
        return pd.concat(parts)

    return run


def _exact_counts(ids: np.ndarray, q: np.ndarray, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            near = q @ _matrix(batch["vector"]).T >= threshold
            near &= ids[:, None] != batch["node"].to_numpy()[None, :]
            total += near.sum(1)
        yield pd.DataFrame({"node": ids, "linked": total})

    return run


def _audited(nodes: DataFrame, count: int, threshold: float, settings: Settings) -> dict[int, int]:
    """To how many others the vectors of a sample are linked; those without links are left out.

    The sample grows until it has enough vectors with links, up to a bound.
    """
    size, linked = settings.audited, {}
    while count and size:
        sample = nodes.orderBy(F.xxhash64(F.lit(7), "node"), "node").limit(size).select("node", "vector").collect()
        ids, q = np.array([r[0] for r in sample], np.int64), _matrix(pd.Series([r[1] for r in sample]))
        exact = nodes.select("node", "vector").mapInPandas(
            _exact_counts(ids, q, threshold), "node long, linked long"
        ).groupBy("node").agg(F.sum("linked").alias("linked"))
        linked = {node: n for node, n in map(tuple, exact.collect()) if n}
        if len(linked) >= _LINKED or size >= min(count, 16 * settings.audited):
            break
        size *= 4
    return linked


def _planted(nodes: DataFrame, threshold: float, settings: Settings) -> DataFrame | None:
    """Noisy copies of a bounded sample, their cosines from ``threshold`` up to half way to 1.

    They look for neighbours as others do, but are in no list, so they change no result.
    None where nothing can be planted: no vectors, or ones of a single component.
    """
    sample = nodes.orderBy(F.xxhash64(F.lit(8), "node"), "node").limit(settings.audited).select("node", "vector").collect()
    x = _matrix(pd.Series([r[1] for r in sample]))
    if x.shape[1] < 2:
        return None
    noise = np.random.default_rng(len(x)).standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.sqrt((noise * noise).sum(1, keepdims=True))
    cosine = (threshold + (1 - threshold) / 2 * (np.arange(len(x)) + 0.5) / len(x))[:, None]
    copies = cosine * x + np.sqrt(np.maximum(1 - cosine * cosine, 0)) * noise
    rows = [(r[0], bytearray(c.tobytes())) for r, c in zip(sample, copies)]
    made = nodes.sparkSession.createDataFrame(rows, "origin long, vector binary")
    return kept(made.withColumn("node", F.xxhash64(F.lit(2), "origin", "vector")))


def _planted_recall(graph: DataFrame, planted: DataFrame | None, threshold: float, settings: Settings) -> float | None:
    """The share of planted copies that found their origin. Those whose list is full of
    links say nothing: their link may be one that only longer lists show."""
    if planted is None:
        return None
    lists = planted.select(F.col("node").alias("u"), "origin").join(graph, "u", "left")
    full = _full(lists, threshold, settings).withColumnRenamed("node", "u").withColumn("full", F.lit(True))
    met = F.coalesce(F.exists("list", lambda e: e["v"] == F.col("origin")), F.lit(False))
    seen = lists.join(full, "u", "left").filter(met | F.col("full").isNull())
    share = seen.agg(F.avg(met.cast("double"))).first()
    return share[0]


def _recall(truth: dict[int, int], got: dict[int, int], few: int) -> float | None:
    """The mean share of links found, each vector counting alike; the lower one of vectors
    with up to ``few`` links and those with more, so that neither hides the other."""
    shares = [[min(got.get(k, 0), n) / n for k, n in truth.items() if (n > few) == many] for many in (False, True)]
    return min((float(np.mean(s)) for s in shares if s), default=None)


def near_vectors(
    rows: DataFrame,
    *,
    threshold: float = 0.9,
    settings: Settings | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> Found:
    """Links between vectors with a cosine of ``threshold`` or more, and their components.

    Rows: the id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest
    id reachable) and ``kept`` (is the id that one). Equal vectors become one node that
    carries their number. Nodes get first lists of neighbours from random partitions;
    rounds of NN-descent then compare the neighbours of each node with each other.
    Lists full of links may hide more: they are made longer by all of their component and
    by the nearest vectors outside it, until none is full of links. Components with such
    lists are compared as a whole, block by block, whatever their size. The links of a
    bounded sample, counted exactly, give the recall, and so do noisy copies planted for
    another one, as links may be rare; while it is too low, further partitions are added,
    and if it stays so, the job stops with a message. An empty table gives no rows.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and so do those of different dimensions. Rows that repeat an id are vectors
    of their own; null ids are smaller than none.
    """
    settings = settings or Settings()
    kind = rows.schema[id_column].dataType.simpleString()
    units = kept(
        rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("raw"))
        .mapInPandas(_unit, f"id {kind}, vector binary")
    )
    # Two hashes of all components stand for a vector; equal vectors are one node.
    print_of = [F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")]
    keyed = units.withColumns({"node": print_of[0], "check": print_of[1]})
    usable = keyed.filter(F.col("vector").isNotNull())
    nodes = kept(
        usable.groupBy("node", "check").agg(
            F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
        )
    )
    sizes = [r[0] for r in nodes.select(F.octet_length("vector").alias("d")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("Vectors have different dimensions.")
    if len(sizes) and nodes.groupBy("node").count().filter("count > 1").limit(1).count():
        raise ValueError("Two vectors have one 64-bit hash.")
    searched = nodes.select("node", "vector", F.col("node").alias("place"), F.lit(False).alias("planted"))
    planted = _planted(nodes, threshold, settings)
    if planted is not None:
        searched = searched.unionByName(
            planted.select("node", "vector", F.col("node").alias("place"), F.lit(True).alias("planted"))
        )
    vectors = kept(searched)
    truth = _audited(nodes, nodes.count(), threshold, settings)

    graph, rounds = None, 0
    for attempt in range(settings.tries):
        graph, n = _search(vectors, graph, None, threshold, attempt, settings)
        # Planted copies are in no list, and their own lists end here.
        lists = graph if planted is None else graph.join(planted.select(F.col("node").alias("u")), "u", "left_anti")
        near, found, wide, more = _linked(lists, nodes, threshold, attempt, settings)
        rounds += n + more
        counts = _links(near, found, wide, nodes, threshold)
        # As many rows as are audited, which is bounded.
        got = counts.filter(F.col("node").isin(list(truth))).select("node", "linked").collect() if truth else []
        shares = (
            _recall(truth, dict(map(tuple, got)), settings.neighbours),
            _planted_recall(graph, planted, threshold, settings),
        )
        recall = min((s for s in shares if s is not None), default=1.0)
        if recall >= settings.recall or shares == (None, None):
            break
    else:
        raise RuntimeError(f"Of the audited links {recall:.3f} are found, less than {settings.recall}.")

    placed = kept(
        nodes.select("node", "first", "copies")
        .join(found.withColumnRenamed("root", "place"), "node", "left")
        .join(counts.select("node", "n"), "node", "left")
        .select(
            "node", "first", F.coalesce("place", "node").alias("place"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    firsts = kept(placed.groupBy("place").agg(F.min("first").alias("component_id")))
    by_node = kept(placed.join(firsts, "place").select("node", "n_links", "component_id"))
    ids = kept(keyed.select("id", F.when(F.col("vector").isNotNull(), F.col("node")).alias("node")))
    component = F.coalesce("component_id", "id")
    return Found(
        ids.join(by_node, "node", "left").select(
            F.col("id").alias(id_column),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
        ),
        recall,
        rounds,
    )


def _links(near: DataFrame, found: DataFrame, wide: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links of each node, weighed by copies; the components ``wide`` are compared as a whole."""
    sizes = found.join(wide, "root", "left_semi").groupBy("root").agg(
        F.ceil(F.count(F.lit(1)) / _CELL).alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = (
        found.join(kept(sizes), "root").join(nodes.select("node", "vector", "copies"), "node")
        .select("root", "node", "vector", "copies", own.alias("own"), other.alias("other"))
        .select(
            "root", "node", "vector", "copies", "own",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        )
    )
    whole = cells.groupBy("root", "low", "high").applyInPandas(
        _links_within(threshold), "node long, n long, linked long"
    )
    both = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    inside = found.join(wide, "root", "left_semi").select(F.col("node").alias("u"))
    copies = nodes.select(F.col("node").alias("v"), F.col("copies").alias("n"))
    listed = both.join(inside, "u", "left_anti").join(copies, "v").select(
        F.col("u").alias("node"), "n", F.lit(1).cast("long").alias("linked")
    )
    return kept(
        whole.unionByName(listed).groupBy("node").agg(F.sum("n").alias("n"), F.sum("linked").alias("linked"))
    )
