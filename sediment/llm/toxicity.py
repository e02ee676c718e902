"""Toxicity scores: FTRL-proximal logistic regression over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import free_name, text_or_empty

#: Bound of the sample that weights are fitted on, in labelled rows.
SAMPLE = 20_000
_BLOCK = 1 << 18
# Bytes that belong to words: digits, a-z, and all of the characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
# Odd multipliers, by which n-grams of each kind get hashes of their own.
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


@dataclass(frozen=True)
class Settings:
    """``bits``: of the hash space. ``skips``: words left out between the two of a skip-gram.

    ``positive``: how many times a toxic example counts, the rarer class.
    """

    bits: int = 20
    skips: int = 1
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.0
    epochs: int = 3
    positive: float = 2.0


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of lower-case bytes, in order."""
    codes = np.frombuffer(data, np.uint8)
    inside = _WORD[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    letters = codes[inside].astype(np.uint64) + np.uint64(1)
    heads = np.cumsum(lengths) - lengths
    within = np.arange(len(letters)) - np.repeat(heads, lengths)
    powers = _KINDS[0] ** np.arange(1, lengths.max() + 1, dtype=np.uint64)
    sums = np.add.reduceat(letters * powers[within], heads)
    sums ^= sums >> np.uint64(32)
    sums *= _KINDS[1]
    return sums ^ (sums >> np.uint64(29))


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Word hashes of a text, in pieces that are cut between words."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and _WORD[data[end]]:
            end += 1
        yield word_hashes(data[at:end])
        at = end


def features(text: str, settings: Settings) -> np.ndarray:
    """Places of single words, pairs and skip-grams in the hash space, each once, sorted."""
    shift = np.uint64(64 - settings.bits)
    found, tail = [], np.empty(0, np.uint64)
    reach = settings.skips + 1
    for words in _blocks(text):
        joined = np.concatenate((tail, words))
        new = len(tail)
        parts = [words * _KINDS[2]]
        for gap in range(1, reach + 1):
            first = max(0, new - gap)
            left, right = joined[first : len(joined) - gap], joined[first + gap :]
            kind = _KINDS[3] + np.uint64(2 * gap)
            mixed = (left * kind) ^ (right * _KINDS[4])
            parts.append((mixed ^ (mixed >> np.uint64(31))) * _KINDS[2])
        found.append(np.unique(np.concatenate(parts) >> shift).astype(np.int32))
        tail = joined[-reach:]
    if not found:
        return np.empty(0, np.int32)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


class Ftrl:
    """Per-coordinate FTRL-proximal over binary features.

    ``bias`` is the log-odds of the labels before anything is known of a text. It is not
    learned: a text without any word has the share of toxic labels as its score.
    """

    def __init__(self, settings: Settings, bias: float):
        self.settings, self.bias = settings, bias
        self.z, self.n = np.zeros(1 << settings.bits), np.zeros(1 << settings.bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.settings, self.z[at]
        rate = (s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2
        return -np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0) / rate

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        slope = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - label
        slope *= self.settings.positive if label else 1.0
        n = self.n[at]
        step = (np.sqrt(n + slope * slope) - np.sqrt(n)) / self.settings.alpha
        self.z[at] += slope - step * w
        self.n[at] = n + slope * slope


@dataclass(frozen=True)
class Weights:
    """The weights that are not zero: no more than the hash space has places."""

    settings: Settings
    at: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, text: str, dense: np.ndarray) -> float:
        total = self.bias + float(dense[features(text, self.settings)].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.settings.bits)
        out[self.at] = self.value
        return out


def learnable(doc_id) -> F.Column:
    """False for the held-out fifth of the ids: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(
    docs: DataFrame, labels: DataFrame, *, settings: Settings | None = None, sample: int = SAMPLE
) -> Weights:
    """Learn weights from at most about ``sample`` labelled documents.

    Of the labelled ids that are not held out those with the smallest hashes are taken,
    a share that gives ``sample`` rows. Rows with the same id and text count once. An id
    with several labels has the highest, and null ones are left out. Features are made across tasks; one task runs over them in
    an order by hash. Without any row to learn from every score is near 0.
    """
    settings = settings or Settings()
    known = (
        labels.filter(learnable(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("label"))
    )
    share = sample / max(known.count(), sample)
    turn = F.xxhash64(F.col("doc_id")) / F.lit(2.0**64) + 0.5
    chosen = known.filter(F.col("doc_id").isNotNull() & (turn <= share))
    # Bounded by ``sample``, whatever the number of labels.
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    prints = {"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit("text"), "text")}
    rows = rows.withColumns(prints).dropDuplicates(["doc_id", "__a", "__b"]).select("doc_id", "label", "text")

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["at"] = [features(t, settings) for t in batch["text"]]
            yield batch[["doc_id", "label", "at"]]

    made = rows.mapInPandas(featurize, "doc_id long, label int, at array<int>")
    turn = F.xxhash64(F.col("doc_id"), F.lit(1)).alias("turn")
    made = made.select(turn, "doc_id", "label", "at", F.lit(0).alias("model"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "doc_id"], kind="stable")
        toxic = int((group["label"] > 0).sum())
        model = Ftrl(settings, float(np.log((toxic + 1) / (len(group) - toxic + 1))))
        for _ in range(settings.epochs):
            for at, label in zip(group["at"], group["label"], strict=True):
                model.learn(at, float(label > 0))
        w = model.weights(np.arange(len(model.z)))
        stay = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(stay, -1), "value": np.append(w[stay], model.bias)})

    found = made.groupBy("model").applyInPandas(learn, "at long, value double").toPandas()
    if found.empty:
        return Weights(settings, np.empty(0, np.int64), np.empty(0), -35.0)
    at, value = found["at"].to_numpy(), found["value"].to_numpy()
    bias = at < 0
    return Weights(settings, at[~bias], value[~bias], float(value[bias].sum()))


def score_column(docs: DataFrame, weights: Weights, column: str = "text"):
    """Probability that a text is toxic, 0 to 1; null counts as the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        dense = model.dense()
        for texts in parts:
            yield pd.Series([model.score(t, dense) for t in texts], dtype="float64")

    return scores(text_or_empty(column))


def toxicity_scores(docs: DataFrame, weights: Weights) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on).

    Rows that repeat are scored each, and an empty table gives no rows.
    """
    return docs.select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), score_column(docs, weights).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, weights: Weights, *, limit: float = 0.5) -> DataFrame:
    """The rows whose score is below ``limit``, with the columns of ``docs``.

    Rows that repeat a text get one score, so all of them stay or go; an empty table stays so.
    """
    score = free_name(docs, "__score")
    scored = docs.withColumn(score, score_column(docs, weights))
    return scored.filter(F.col(score) < limit).select([F.col(f"`{c}`") for c in docs.columns])
