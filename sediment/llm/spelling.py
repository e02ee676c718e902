"""Spelling variants: words one edit apart, found through broadcast Bloom filters."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import kept, text_or_empty

#: Bound of the filters that are broadcast at once, in blocks of 32 bytes: 32 MB.
PASS_BLOCKS = 1 << 20
_CHUNK = 1 << 11  # blocks in one row of the table of filters
_LANES = 8  # 32-bit parts of a block, in each of which a word sets one bit
_FLUSH = 50_000
_SLAB = 1 << 17
_GATHER = 1 << 12
# Letters of one byte in Latin-1, A-Z folded; all else separates runs.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SALTS = np.array(
    [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31],
    np.uint64,
)
_LOW = np.uint64(0xFFFFFFFF)


# ---- Words and their numbers


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, as Latin-1: one byte a code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def altered(run: bytes, start: int, every: int) -> bytes:
    """The run, one letter less if ``every`` divides its crc32, continued from ``start``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, *, shortest: int = 5, least: int = 3, every: int = 97,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``word``, ``n``: words of at least ``shortest`` letters with ``least`` occurrences.

    Words are the runs of a text, one in ``every`` of them misspelt by a dropped letter,
    chosen by id and run. Null texts have no words; a null id counts as an empty one.
    Rows that repeat an id count each. Tasks add up their own words first, so a word that
    a third of all texts hold is a few rows of the shuffle; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(r for r in runs(text) if len(r) >= shortest).items():
                    word = altered(run, start, every)
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) >= _FLUSH:
                    yield _counted(total)
                    total.clear()
        if total:
            yield _counted(total)

    read = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"),
        text_or_empty(text_column).alias("text"),
    )
    return (
        read.mapInArrow(count, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    )


def _counted(total: Counter[bytes]) -> pa.RecordBatch:
    words = [w.decode("latin-1") for w in total]
    return pa.record_batch(
        [pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
    )


# ---- Hashes of words and of their edits


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    return _mixed(codes.astype(np.uint64) + np.uint64(1))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    steps = np.full(n + 1, _BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, given as rows of code points: a sum over places."""
    return (_values(codes) * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def shard_of(length: int) -> int:
    """Words of one length share a shard; from 64 letters on those of one power of two."""
    return length if length < 64 else 58 + length.bit_length()


@dataclass(frozen=True)
class Layout:
    """Where the blocks of each shard lie: ``place[shard]`` is (first block, number)."""

    place: dict[int, tuple[int, int]]
    blocks: int

    @property
    def passes(self) -> int:
        return -(-self.blocks // PASS_BLOCKS)

    def slots(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and 32 further bits of every hash of a word of ``length`` letters."""
        first, number = self.place[shard_of(length)]
        h = _mixed(hashes)
        block = ((h >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
        return block + np.uint64(first), h & _LOW


def _layout(counts: dict[int, int]) -> Layout:
    place, at = {}, 0
    for shard in sorted(counts):
        # Longer words have more edits, and candidates that cost more to send.
        bits = 20 if shard < 32 else 64
        number = max(1, -(-counts[shard] * bits // (32 * _LANES)))
        place[shard] = (at, number)
        at += number
    return Layout(place, at)


def _bit(low: np.ndarray, lane: int) -> np.ndarray:
    return ((low * _SALTS[lane]) & _LOW) >> np.uint64(27)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def _filters(vocabulary: DataFrame, layout: Layout) -> DataFrame:
    """The filters in rows: ``chunk`` and its ``bits``, each made of the words that fall there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in _by_length(words):
                block, low = layout.slots(word_hashes(_letters([words[i] for i in at], length)), length)
                columns = [pa.array(a.astype(np.int64)) for a in (block // np.uint64(_CHUNK), block, low)]
                yield pa.record_batch(columns, ["chunk", "block", "low"])

    def fill(group):
        bits = np.zeros(_CHUNK * _LANES, np.uint32)
        block = group["block"].to_numpy() % _CHUNK
        low = group["low"].to_numpy().astype(np.uint64)
        for lane in range(_LANES):
            np.bitwise_or.at(bits, block * _LANES + lane, (np.uint64(1) << _bit(low, lane)).astype(np.uint32))
        return group.iloc[:1][["chunk"]].assign(bits=[bits.tobytes()])

    placed = vocabulary.select("word").mapInArrow(place, "chunk long, block long, low long")
    return placed.groupBy("chunk").applyInPandas(fill, "chunk long, bits binary")


@dataclass(frozen=True)
class Filters:
    """The blocks of one pass, from ``start`` on, as 32-bit parts in a row."""

    layout: Layout
    start: int
    parts: np.ndarray

    def hits(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Places in ``hashes`` of what may be words of ``length`` letters in this pass."""
        if shard_of(length) not in self.layout.place:
            return np.empty(0, np.int64)
        block, low = self.layout.slots(hashes, length)
        # Blocks before the start wrap around and are too large as well.
        block = block - np.uint64(self.start)
        alive = np.flatnonzero(block < np.uint64(len(self.parts) // _LANES))
        block, low = (block[alive] * np.uint64(_LANES)).astype(np.int64), low[alive]
        for lane in range(_LANES):
            found = self.parts[block + lane] >> _bit(low, lane).astype(np.uint32) & np.uint32(1)
            stay = np.flatnonzero(found)
            alive, block, low = alive[stay], block[stay], low[stay]
        return alive


def _edits(codes: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of words and those of their edits that a filter lets pass.

    Of two words one insertion apart the longer one finds the shorter one, deleting the
    last letter of a row of equal ones; of two that differ in a letter the one with the
    smaller letter finds the other. So no pair is probed or found twice.
    """
    m, length = codes.shape
    power = _powers(length)
    terms = _values(codes) * power[:length]
    until = np.cumsum(terms, axis=1, dtype=np.uint64)
    total = until[:, -1:]
    if length > 1:
        shorter = (until - terms) + (total - until) * _INVERSE
        last = np.concatenate((codes[:, 1:] != codes[:, :-1], np.ones((m, 1), bool)), axis=1)
        where = np.flatnonzero(last)
        row, at = np.divmod(where[filters.hits(shorter.ravel()[where], length - 1)], length)
        if len(row):
            keep = np.arange(length)[None, :] != at[:, None]
            yield row, _strings(codes[row][keep], length - 1)
    values = _values(alphabet)
    width = max(1, _SLAB // (m * len(alphabet)))
    for left in range(0, length, width):
        part = slice(left, min(left + width, length))
        size = part.stop - left
        rest = total - terms[:, part]
        hashes = rest[:, :, None] + values[None, None, :] * power[part][None, :, None]
        where = np.flatnonzero(alphabet[None, None, :] > codes[:, part][:, :, None])
        hit = where[filters.hits(hashes.ravel()[where], length)]
        row, at, letter = np.unravel_index(hit, (m, size, len(alphabet)))
        if len(row):
            edited = codes[row]
            edited[np.arange(len(row)), at + left] = alphabet[letter]
            yield row, _strings(edited, length)


def _strings(codes: np.ndarray, length: int) -> list[str]:
    text = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le")
    return [text[i : i + length] for i in range(0, len(text), length)]


# ---- Near words, forms and roots


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, each once: ``word``, ``n``, ``near``, ``near_n``.

    ``vocabulary`` has distinct words and their numbers. Its Bloom filters, sharded by
    length, are laid end to end and broadcast ``PASS_BLOCKS`` at a time, so that what is
    broadcast does not grow with the vocabulary: a larger one takes more passes. Edits a
    filter lets pass meet the vocabulary in a join, which removes its errors. A word takes
    part in the join no more often than it has possible edits.
    """
    spark = vocabulary.sparkSession
    shards = vocabulary.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words"))
    in_shard = F.when(F.col("length") < 64, F.col("length")).otherwise(
        F.lit(58) + F.length(F.bin("length"))
    )
    counts = {
        r["shard"]: r["words"]
        for r in shards.groupBy(in_shard.alias("shard")).agg(F.sum("words").alias("words")).collect()
    }  # fewer than a hundred rows
    layout = _layout(counts)
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).distinct()
    # No more rows than there are code points.
    alphabet = np.array(sorted(ord(r[0]) for r in letters.collect() if r[0]), np.uint32)
    filters = kept(_filters(vocabulary, layout))
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(counts.values()) // 32_768))
    dealt = vocabulary.repartition(tasks, "word")
    found = []
    for number in range(max(layout.passes, 1)):
        start = number * PASS_BLOCKS
        size = min(PASS_BLOCKS, layout.blocks - start)
        parts = np.zeros(-(-max(size, 0) // _CHUNK) * _CHUNK * _LANES, np.uint32)
        chunk = F.col("chunk")
        rows = filters.filter((chunk >= start // _CHUNK) & (chunk * _CHUNK < start + size))
        for row in rows.toLocalIterator():
            at = (row["chunk"] * _CHUNK - start) * _LANES
            parts[at : at + _CHUNK * _LANES] = np.frombuffer(row["bits"], np.uint32)
        shared = spark.sparkContext.broadcast(Filters(layout, start, parts))
        found.append(kept(dealt.mapInArrow(_prober(shared, alphabet), "word string, n long, near string")))
        shared.unpersist()
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return candidates.join(exact, "near").select("word", "n", "near", "near_n")


def _prober(shared, alphabet):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        words, numbers = [], []
        for batch in batches:
            words += batch.column("word").to_pylist()
            numbers += batch.column("n").to_pylist()
            if len(words) >= _GATHER:
                yield from found(words, numbers, filters)
                words, numbers = [], []
        yield from found(words, numbers, filters)

    def found(words, numbers, filters):
        for length, at in _by_length(words) if words else ():
            rows = max(1, _SLAB // (length * max(len(alphabet), 1)))
            for left in range(0, len(at), rows):
                part = [words[i] for i in at[left : left + rows]]
                for row, near in _edits(_letters(part, length), alphabet, filters):
                    yield pa.record_batch(
                        [
                            pa.array([part[i] for i in row], pa.string()),
                            pa.array([numbers[i] for i in at[left + row]], pa.int64()),
                            pa.array(near, pa.string()),
                        ],
                        ["word", "n", "near"],
                    )

    return probe


def spelling_groups(vocabulary: DataFrame, *, ratio: int = 2) -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word of largest number (ties: the first in code-point order),
    if that is at least ``ratio`` times the word's own, else null; ``ratio`` is at least
    2. ``root`` is reached by following forms. Numbers grow along the way by that factor,
    so a path is no longer than the logarithm of the largest one; each step joins on
    forms, of which a word is one for no more words than it has edits.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    vocabulary = kept(vocabulary.select("word", "n"))
    pairs = kept(near_pairs(vocabulary))
    turned = pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"),
        F.col("word").alias("near"), F.col("n").alias("near_n"),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    each = (
        pairs.unionByName(turned).groupBy("word")
        .agg(F.first("n").alias("own"), F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    )
    fits = -F.col("best.n") >= ratio * F.col("own")
    each = kept(
        each.select(
            "word", "n_near",
            F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n"),
        )
    )
    roots = _roots(each.filter("form is not null").select("word", "form"))
    return (
        vocabulary.join(each, "word", "left").join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )


def _roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words that have a form, nearest to the roots first."""
    links = kept(links)
    ends = links.select(F.col("word").alias("form"))
    level = kept(links.join(ends, "form", "left_anti").select("word", F.col("form").alias("root")))
    found = level
    while not level.isEmpty():
        above = level.select(F.col("word").alias("form"), "root")
        level = kept(links.join(above, "form").select("word", "root"))
        found = found.unionByName(level)
    return found
