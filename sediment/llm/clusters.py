"""Centroid clustering in whole numbers, searched through Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import kept

WIDTH = 64
# Ends of the groups of coefficients that are compared one after the other.
_STEPS = (1, 2, 4, 8, 16, 32, 64)
# Components up to here keep all sums within 64 bits; Python's integers serve beyond.
_SMALL = 1 << 20
_LONGEST = (1 << 63) - 1


def _sequency() -> np.ndarray:
    """Rows of the Hadamard matrix of 64 in order of their changes of sign."""
    places = np.arange(WIDTH)
    signs = np.array([[(i & j).bit_count() & 1 for j in places] for i in places])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


_ORDER = _sequency()


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, from coarse to fine, exactly.

    The sum of squares of a row's coefficients is 64 times that of its components.
    """
    out = rows.copy()
    half = 1
    while half < WIDTH:
        parts = out.reshape(len(rows), -1, 2, half)
        a, b = parts[:, :, 0], parts[:, :, 1]
        out = np.stack((a + b, a - b), axis=2).reshape(len(rows), WIDTH)
        half *= 2
    return out[:, _ORDER]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and its squared distance.

    Squared differences of coefficients are added up from coarse to fine: the sum so far
    is at most 64 times the distance. The centroid that leads after the first groups is
    finished at once, and those whose sum exceeds its whole one are strictly worse and go
    no further. All others reach the last coefficient, so ties go to the smaller number.
    """
    left, right = transform(rows), transform(centroids)
    m, k = len(rows), len(centroids)
    sums = np.zeros((m, k), rows.dtype)
    alive = np.ones((m, k), bool)
    lead = None
    begin = 0
    for end in _STEPS:
        row, number = np.nonzero(alive)
        d = left[row, begin:end] - right[number, begin:end]
        sums[row, number] += (d * d).sum(axis=1)
        begin = end
        if end == 8:
            first = sums.argmin(axis=1)
            d = left - right[first]
            lead = (d * d).sum(axis=1)
        if lead is not None and end < WIDTH:
            alive &= sums <= lead[:, None]
    over = sums.max() + 1 if m and k else 0
    sums[~alive] = over
    number = sums.argmin(axis=1)
    return number, sums[np.arange(m), number] // WIDTH


def _integers(values: np.ndarray, centroids: np.ndarray | None = None):
    """Whole floats as integers: of 64 bits where nothing can overflow, else Python's."""
    most = max(np.abs(values).max(initial=0), 0 if centroids is None else np.abs(centroids).max(initial=0))
    if most <= _SMALL:
        return values.astype(np.int64), None if centroids is None else centroids.astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)
    return exact, centroids


def grid_vectors(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Rows with exactly 64 finite components: the id and floor(scale * x) of each, as ``grid``."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fit = (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == WIDTH).nonzero()[0]
            batch = batch.take(pa.array(fit))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            with np.errstate(over="ignore"):
                grid = np.floor(np.float64(scale) * flat.astype(np.float64))
            stay = np.isfinite(flat.astype(np.float64)).all(axis=1)  # a null reads as NaN
            if not np.isfinite(grid[stay]).all():
                raise OverflowError(f"A component times {scale} is beyond the range of doubles.")
            ends = np.arange(int(stay.sum()) + 1, dtype=np.int32) * WIDTH
            rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(grid[stay].ravel()))
            yield pa.record_batch([batch.column(0).filter(pa.array(stay)), rows], [id_column, "grid"])

    read = vectors.select(F.col(f"`{id_column}`"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    kind = vectors.schema[id_column].dataType.simpleString()
    return read.mapInArrow(floors, f"`{id_column}` {kind}, grid array<double>")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("grid").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def first_centroids(grids: DataFrame, k: int, id_column: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes; fewer if there are fewer.

    Rows that repeat an id follow each other in the order of their components. A null
    id counts as an empty text.
    """
    name = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    first = grids.orderBy(F.sha2(F.concat(F.lit("1:"), name).cast("binary"), 256), "grid").limit(k)
    return _exact([r["grid"] for r in first.select("grid").collect()])


def _exact(rows) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in rows], object).reshape(-1, WIDTH)


def moved_centroids(grids: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of the mean of the vectors nearest to it.

    A task adds up its vectors and sends one row for each centroid and component, so what
    is shuffled and collected depends on the number of centroids alone.
    """
    shared = grids.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value)
        sums, counts = np.zeros((k, WIDTH), object), np.zeros(k, np.int64)
        for batch in batches:
            rows, places = _integers(_rows(batch), shared.value)
            number, _ = nearest(rows, places)
            counts += np.bincount(number, minlength=k)
            for c in np.unique(number):
                sums[c] += rows[number == c].sum(axis=0).astype(object)
        has = np.flatnonzero(counts)
        cells = [(int(c), i, str(sums[c, i]), int(counts[c])) for c in has for i in range(WIDTH)]
        names = ["cluster", "place", "total", "n"]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, cell, strict=True)) for cell in cells],
            pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.string()), ("n", pa.int64())]),
        )

    cells = grids.select("grid").mapInArrow(add, "cluster int, place int, total string, n long")
    whole = cells.groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    out = centroids.copy()
    for r in whole.collect():  # at most 64 rows a centroid
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    shared.unpersist()
    return out


@dataclass(frozen=True)
class Clustering:
    """``rows``: id, ``cluster``, ``distance``. ``centroids``: Python integers, a row each."""

    rows: DataFrame
    centroids: np.ndarray


def cluster_vectors(
    vectors: DataFrame, *, k: int = 16, rounds: int = 3, scale: int = 64,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> Clustering:
    """Lloyd's rounds from ``k`` vectors chosen by hash, then one more assignment.

    Vectors that are null, of another length than 64, or hold null, NaN or infinite
    components take no part; with none left there are no rows and no centroids. Repeated
    rows count each. Equally near centroids: the smaller number. Empty clusters stay where
    they are. A squared distance beyond 64 bits stops the job.
    """
    grids = kept(grid_vectors(vectors, scale, id_column, vector_column))
    centroids = first_centroids(grids, k, id_column)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved_centroids(grids, centroids)
    shared = grids.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = _integers(_rows(batch), shared.value)
            if not len(rows):
                continue
            number, distance = nearest(rows, places)
            if distance.max() > _LONGEST:
                raise OverflowError("A squared distance does not fit a 64-bit integer.")
            columns = [pa.array(number.astype(np.int32)), pa.array(distance.astype(np.int64))]
            yield pa.record_batch([batch.column(0), *columns], [id_column, "cluster", "distance"])

    kind = grids.schema[id_column].dataType.simpleString()
    rows = kept(grids.mapInArrow(assign, f"`{id_column}` {kind}, cluster int, distance long"))
    return Clustering(rows, centroids)


def with_inertia(clustering: Clustering, id_column: str = "vec_id") -> DataFrame:
    """The rows, with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    sums = {
        r["cluster"]: r["inertia"]
        for r in clustering.rows.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    }  # one row a cluster
    table = [
        (i, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(clustering.centroids)
        if i in sums
    ]
    table = clustering.rows.sparkSession.createDataFrame(
        table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return clustering.rows.join(F.broadcast(table), "cluster").select(
        F.col(f"`{id_column}`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
