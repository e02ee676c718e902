"""Removing long byte strings that occur more than once, by refinement of buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import kept, text_or_empty
from sediment.plans.keyed import hot_slices, join_sliced
from sediment.plans.materialize import Kept

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers can be undone modulo 2^64
_LOW = np.uint64((1 << 21) - 1)
_BLOCK = 1 << 18  # positions that are worked on at once


@lru_cache(4)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    out[0], done = 1, 1
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


@lru_cache(1)
def _letters() -> np.ndarray:
    """A 64-bit number for every byte value."""
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Prefixes:
    """Polynomial hashes of all substrings of a byte string of at most two blocks."""

    def __init__(self, data: bytes, base: int):
        values = _letters()[np.frombuffer(data, np.uint8)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * _powers(base, 2 * _BLOCK)[: len(data)], out=self.sums[1:])
        self.undo = _powers(pow(base, -1, 1 << 64), 2 * _BLOCK)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.undo[starts])

    def windows(self, length: int) -> np.ndarray:
        """The hash of every substring of one length."""
        count = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:count]) * self.undo[:count])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    rows = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


def runs_of(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """The windows of ``length`` bytes, gathered by the anchor in each.

    A window's anchor is the leftmost of its q-grams (q = length / 4) with the least
    hash, so equal windows have equal anchors at equal offsets. Neighbouring windows
    with one anchor are a run. Arrays, one value a run: bucket (hash of the anchor's
    q-gram), hash of all the bytes of the run, offset of the anchor in the run, first
    window, number of windows. A very long text is worked on in overlapping blocks; a
    run is then cut at their borders.
    """
    q = length // 4
    found = []
    for at in range(0, max(len(data) - length + 1, 0), _BLOCK):
        block = data[at : at + _BLOCK + length - 1]
        if len(block) < length:
            break
        prefixes = _Prefixes(block, _BASES[0])
        grams = prefixes.windows(q)
        order = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        anchors = (_sliding_least(order, length - q + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        count = np.diff(np.append(first, len(anchors)))
        anchor = anchors[first]
        ends = first + count - 1 + length
        whole = prefixes.of(first, ends) ^ _mixed(
            _Prefixes(block, _BASES[1]).of(first, ends) + (anchor - first).astype(np.uint64)
        )
        found.append((grams[anchor], whole, anchor - first, first + at, count))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _find_runs(length: int):
    """Rows of texts, and of the places in them where there are such columns, as rows of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, prints = part.column(0), part.column(1)
                rows, columns = [], []
                texts = part.column(2).to_pylist()
                places = [[(0, len(data))] for data in texts]
                if part.num_columns > 3:
                    lists = zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
                    places = [list(zip(*x, strict=True)) for x in lists]
                for i, data in enumerate(texts):
                    for start, stop in places[i]:
                        if stop - start >= length:
                            bucket, whole, offset, first, count = runs_of(data[start:stop], length)
                            columns.append((bucket, whole, offset, first + start, count))
                            rows.append(np.full(len(bucket), i))
                if not rows:
                    continue
                at_row = pa.array(np.concatenate(rows))
                bucket, whole, offset, first, count = (np.concatenate(x) for x in zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(at_row), prints.take(at_row),
                        pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)),
                        pa.array(offset.astype(np.int32)), pa.array(first.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["id", "print", "bucket", "whole", "offset", "first", "count"],
                )

    return run


_MEMBER = "id {kind}, print long, bucket long, first int"


def _joined(rows: list[bytes]) -> Iterator[tuple[slice, bytes, np.ndarray]]:
    """Rows laid end to end, so many at once that they are about a block: which, bytes, beginnings."""
    sizes = np.array([len(r) for r in rows])
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _BLOCK, side="right")))
        yield slice(at, end), b"".join(rows[at:end]), np.cumsum(sizes[at:end]) - sizes[at:end]
        at = end


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` items of every row: the row and the number of the item in it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _cells(length: int, step: int):
    """Rows of runs as rows of cells: the windows of a run by their distance from the anchor.

    A cell holds ``step`` distances. ``core`` identifies the bytes that all windows of a
    whole cell share, ``whole`` those that any of its windows in this run has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset, first = _columns(batch, "offset", "first")
            rows = batch.column("data").to_pylist()
            least = offset - np.array([len(r) for r in rows], np.int64) + length
            for part, data, begin in _joined(rows):
                far, near = offset[part], least[part]
                row, item = _each(far // step - near // step + 1)
                cell = near[row] // step + item
                low = np.maximum(near[row], cell * step)
                high = np.minimum(far[row], cell * step + step - 1)
                anchor = begin[row] + far[row]
                core_at = anchor - cell * step
                hashes = []
                for base in _BASES:
                    prefixes = _Prefixes(data, base)
                    hashes.append(
                        (prefixes.of(core_at, core_at + length - step + 1), prefixes.of(anchor - high, anchor - low + length))
                    )
                core = hashes[0][0] ^ _mixed(hashes[1][0] + cell.view(np.uint64))
                whole = hashes[0][1] ^ _mixed(hashes[1][1] + (low * 2 * length + high).view(np.uint64))
                taken = pa.array(row + part.start)
                start = first[part][row] + far[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n).take(taken) for n in ("id", "print", "bucket", "first")),
                        pa.array(cell.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)),
                        pa.array((start - high).astype(np.int32)), pa.array((start - low + length).astype(np.int32)),
                    ],
                    names=["id", "print", "bucket", "first", "cell", "core", "whole", "start", "stop"],
                )

    return run


def _windows(length: int, step: int):
    """Rows of cells, with the bytes of their runs, as rows of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset, first, cell = _columns(batch, "offset", "first", "cell")
            rows = batch.column("data").to_pylist()
            least = offset - np.array([len(r) for r in rows], np.int64) + length
            low, high = np.maximum(least, cell * step), np.minimum(offset, cell * step + step - 1)
            for part, data, begin in _joined(rows):
                row, item = _each(high[part] - low[part] + 1)
                distance = low[part][row] + item
                at = begin[row] + offset[part][row] - distance
                one, two = (_Prefixes(data, base).of(at, at + length) for base in _BASES)
                window = one ^ _mixed(two + distance.view(np.uint64))
                taken = pa.array(row + part.start)
                start = first[part][row] + offset[part][row] - distance
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n).take(taken) for n in ("id", "print", "bucket", "first")),
                        pa.array(distance.astype(np.int32)), pa.array(window.view(np.int64)),
                        pa.array(start.astype(np.int32)), pa.array((start + length).astype(np.int32)),
                    ],
                    names=["id", "print", "bucket", "first", "distance", "window", "start", "stop"],
                )

    return run


def _again(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose identifier ``on`` is one of ``counted`` with more than one member.

    Identifiers that many rows have are split over tasks.
    """
    often = counted.filter("n > 1").select(*on)
    return join_sliced(rows, often, on, hot_slices([rows], on)[0], "left_semi")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Texts as bytes. ``print`` is a hash of the text, so that rows which repeat an id are
    told apart by their texts."""
    return docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.xxhash64(text_or_empty(text_column)).alias("print"),
        F.encode(text_or_empty(text_column), "UTF-8").alias("data"),
    )


def repeated_spans(
    docs: DataFrame,
    *,
    length: int = 400,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Intervals of bytes covered by strings of ``length`` bytes that also start elsewhere.

    Rows (``id``, ``print``, ``start``, ``stop``); intervals may overlap. ``print`` is a
    hash of the text, so that rows which repeat an id are told apart by their texts.

    Windows of ``length`` bytes start in buckets by one of their own q-grams, the anchor;
    neighbouring windows with one anchor stay together as a run. Buckets are refined in
    rounds, each by identifiers of the bytes that lie further from the anchor, and only
    members that share their identifier and are not yet alike go on, one of each kind:

    1. by the bytes of whole runs; 2. by cells of windows at like distances from the
    anchor, identified by the bytes they share (``core``) and by all they cover; 3. by
    single windows.

    A member that is alike with another one is repeated with all of its windows. Windows
    of a run all hold the anchor, so what is repeated of a run is one interval.
    """
    return _spans(_texts(docs, id_column, text_column), length)


def _spans(texts: DataFrame, length: int, tables: Kept | None = None) -> DataFrame:
    """``repeated_spans`` of texts; ``tables`` are those that the result reads.

    If texts have columns ``starts`` and ``stops``, only windows within these places count.
    """
    if length % 4 or length < 16:
        raise ValueError("length must be a multiple of 4, and at least 16")
    step = max(2, length // 25)
    texts = texts.filter(F.octet_length("data") >= length)
    kind = texts.schema["id"].dataType.simpleString()
    number = F.count(F.lit(1)).alias("n")
    member = _MEMBER.format(kind=kind)
    with Kept() as passing:
        runs = kept(
            texts.mapInArrow(
                _find_runs(length),
                f"id {kind}, print long, bucket long, whole long, offset int, first int, count int",
            ),
            passing,
        )
        # First round: whole runs.
        buckets = kept(runs.groupBy("bucket").agg(number).filter("n > 1"), passing)
        shared = kept(_again(runs, buckets, ["bucket"]), tables)
    same_run = ["bucket", "whole", "offset", "count"]
    kinds = kept(
        shared.groupBy(*same_run).agg(number, F.min(F.struct("id", "print", "first")).alias("one")), tables
    )
    alike = _again(shared, kinds, same_run)
    alike = alike.select(
        "id", "print", F.col("first").alias("start"), (F.col("first") + F.col("count") + length - 1).alias("stop")
    )
    edges = kept(
        _unlike(kinds, ["bucket"]).select("bucket", "offset", "count", "one.id", "one.print", "one.first"),
        tables,
    )
    of_text = [texts["id"].eqNullSafe(edges["id"]), texts["print"] == edges["print"]]
    cut = F.expr(f"substring(data, first + 1, count + {length - 1})").alias("data")
    spans = kept(
        texts.join(edges, of_text)
        .select(edges["id"], edges["print"], "bucket", "offset", "first", cut)
        # Rows that repeat both id and text are one place here; their runs are alike already.
        .dropDuplicates(["id", "print", "bucket", "first"]),
        tables,
    )
    # Second round: cells of windows.
    cells = kept(
        spans.mapInArrow(
            _cells(length, step), f"{member}, cell int, core long, whole long, start int, stop int"
        ),
        tables,
    )
    same_cell = ["bucket", "cell", "core", "whole"]
    counted = kept(
        cells.groupBy(*same_cell).agg(number, F.min(F.struct("id", "print", "first")).alias("one")), tables
    )
    found = _again(cells, counted, same_cell)
    open_cells = _unlike(counted, ["bucket", "cell", "core"]).select(
        "bucket", "cell", "one.id", "one.print", "one.first"
    )
    # Third round: single windows.
    bytes_of = [
        open_cells["id"].eqNullSafe(spans["id"]),
        *[open_cells[c] == spans[c] for c in ("print", "bucket", "first")],
    ]
    at_cells = open_cells.join(spans, bytes_of).select(*[spans[c] for c in spans.columns], "cell")
    windows = kept(
        at_cells.mapInArrow(
            _windows(length, step), f"{member}, distance int, window long, start int, stop int"
        ),
        tables,
    )
    same_window = ["bucket", "distance", "window"]
    repeated = _again(windows, kept(windows.groupBy(*same_window).agg(number), tables), same_window)
    of_run = ["id", "print", "bucket", "first", "start", "stop"]
    refined = (
        found.select(*of_run).unionByName(repeated.select(*of_run))
        .groupBy("id", "print", "bucket", "first")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .select("id", "print", "start", "stop")
    )
    return alike.unionByName(refined)


def _unlike(kinds: DataFrame, on: list[str]) -> DataFrame:
    """Kinds that share ``on`` with another kind: the members that go on to the next round."""
    several = kinds.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).select(*on, F.col("n"))
    return _again(kinds, several, on)


def merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that intervals cover."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts, stops, strict=True)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, stop in spans:
        parts.append(data[at:start])
        at = stop
    return b"".join([*parts, data[at:]])


def _lists(spans: DataFrame) -> DataFrame:
    return spans.groupBy("id", "print").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    )


def with_spans(docs: DataFrame, spans: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """All rows of ``docs`` in a column ``doc``, with ``starts`` and ``stops`` of each text's spans."""
    return _with_lists(docs, kept(_lists(spans)), id_column, text_column)


def _with_lists(docs: DataFrame, lists: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(
        F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(f"`{id_column}`").alias("of"), F.xxhash64(text_or_empty(text_column)).alias("text_print"),
    )
    same = rows["of"].eqNullSafe(lists["id"]) & (rows["text_print"] == lists["print"])
    return rows.join(lists, same, "left").select("doc", *lists.columns[2:])


def _maximal(length: int):
    """Rows of lists as the bytes that all of a text's maximal runs have, and the runs of ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, starts, stops = [], [], []
            for row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spans = merged(*row)
                counts.append(sum(b - a for a, b in spans))
                starts.append([a for a, b in spans if b - a >= length])
                stops.append([b for a, b in spans if b - a >= length])
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                    pa.array(starts, places), pa.array(stops, places),
                ],
                names=["id", "print", "n_repeated", "starts", "stops"],
            )

    return run


def _lists_of_two(texts: DataFrame, length: int, shorter: int) -> DataFrame:
    """``n_repeated`` by strings of ``shorter`` bytes, and lists of the spans of ``length`` bytes.

    A string that starts again elsewhere does so with all shorter strings in it. So it is
    within one maximal run of those, and only such runs are searched for it.
    """
    kind = texts.schema["id"].dataType.simpleString()
    with Kept() as tables:
        found = kept(
            _lists(_spans(texts, shorter, tables)).mapInArrow(
                _maximal(length), f"id {kind}, print long, n_repeated long, starts array<int>, stops array<int>"
            )
        )
    places = found.filter(F.size("starts") > 0)
    of_text = texts["id"].eqNullSafe(places["id"]) & (texts["print"] == places["print"])
    inside = kept(texts.join(places, of_text).select(*[texts[c] for c in texts.columns], "starts", "stops"))
    spans = kept(_lists(_spans(inside, length)))
    same = found["id"].eqNullSafe(spans["id"]) & (found["print"] == spans["print"])
    return kept(
        found.join(spans, same, "left").select(found["id"], found["print"], spans["starts"], spans["stops"], "n_repeated")
    )


def remove_repeats(
    docs: DataFrame,
    *,
    length: int = 400,
    shorter: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes that also starts elsewhere.

    Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (the bytes that are left, which may begin or end within a character). All
    places count, also those of the same row, and none of them stays. Null is the empty
    text; texts shorter than ``length`` stay; rows that repeat count as places apart.

    With ``shorter``, ``n_repeated`` tells how many bytes strings of that length cover
    that also start elsewhere. Of these, only the bytes counted in ``n_removed`` go.
    """
    texts = _texts(docs, id_column, text_column)
    if shorter is None:
        lists = kept(_lists(_spans(texts, length)))
    elif shorter > length:
        raise ValueError("shorter must not be more than length")
    else:
        lists = _lists_of_two(texts, length, shorter)
    rows = _with_lists(docs.select(
        F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text_column}`").alias(text_column)
    ), lists, id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col("doc")[text_column].cast("string"), F.lit(""))
    more = [] if shorter is None else [F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, starts, stops in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                spans = merged(starts or [], stops or [])
                rest = without(data, spans) if spans else data
                found.append((len(data), len(data) - len(rest), len(spans), rest))
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]),
                    pa.array(columns[3], pa.binary()), *batch.columns[4:],
                ],
                names=[id_column, "n_bytes", "n_removed", "n_spans", "kept", *batch.schema.names[4:]],
            )

    schema = f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows.select(
        F.col("doc")[id_column].alias(id_column), F.encode(text, "UTF-8").alias("data"), "starts", "stops", *more
    ).mapInArrow(run, schema + ", n_repeated long" * len(more))


def _rest(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    return pd.Series([
        without(t.encode(), merged(list(a), list(b))).decode("utf-8", "ignore")
        for t, a, b in zip(texts, starts, stops, strict=True)
    ])


def drop_repeats(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; rows and columns stay as they are.

    Where a cut falls within a character, the rest of that character goes too.
    """
    spans = repeated_spans(docs, length=length)
    rows = with_spans(docs, spans, "doc_id", "text")
    cut = F.pandas_udf(_rest, "string")
    nothing = F.array().cast("array<int>")
    text = F.coalesce(F.col("doc")["text"].cast("string"), F.lit(""))
    rest = cut(text, F.coalesce("starts", nothing), F.coalesce("stops", nothing))
    shorter = F.when(F.col("starts").isNotNull(), rest).otherwise(F.col("doc")["text"])
    return rows.withColumn("rest", shorter).select(
        *[(F.col("rest") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns]
    )
