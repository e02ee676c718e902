"""Language identification: averaged embeddings of hashed subwords and a linear softmax."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import text_or_empty

#: Bound of the sample the model is fitted on: about so many pieces of text, in all languages.
PIECES = 20_000
#: Code points in a piece.
PIECE = 256
#: More languages than this in the labels stop the job: the model would not be small.
LANGUAGES = 1000
UNKNOWN = "und"
_BLOCK = 1 << 16
# Averages of some hundred embeddings are short; so much longer they are of length one or so.
_SCALE = np.float32(8)
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Settings:
    """``bits``: of the hash space. ``width``: of an embedding. ``rejected``: the share of
    correctly named pieces of known languages that rejection may cost."""

    bits: int = 16
    width: int = 16
    epochs: int = 4
    rate: float = 0.5
    rejected: float = 0.002
    seed: int = 7


@cache
def _folded() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LM":
            small = chr(c).lower()
            table[c] = ord(small) if len(small) == 1 else c
    return table


def letters(text: str) -> np.ndarray:
    """Lower-case code points of words, with one 0 before, between and after them."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(len(codes) + 2, np.uint32)
    out[1:-1] = _folded()[codes]
    stay = np.ones(len(out), bool)
    stay[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[stay]


def subwords(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places in the hash space of all runs of two to four code points within a word.

    A word's run may hold the 0 before or after it, so that beginnings and ends count.
    """
    wide = codes.astype(np.uint64) + np.uint64(1)
    inside = codes != 0
    shift = np.uint64(64 - bits)
    found = []
    n = len(codes)
    for size in (2, 3, 4):
        if n < size:
            break
        sums = wide[: n - size + 1] * _PRIMES[0]
        for i in range(1, size):
            sums = (sums ^ (sums >> np.uint64(29))) + wide[i : n - size + 1 + i] * _PRIMES[i]
        ok = np.ones(n - size + 1, bool)
        for i in range(1, size - 1):
            ok &= inside[i : n - size + 1 + i]
        sums = sums[ok] * _PRIMES[size - 1]
        found.append((sums ^ (sums >> np.uint64(32))) * _PRIMES[0] >> shift)
    return found


def _places(piece: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of a piece's subwords and their shares."""
    found = subwords(letters(piece), bits)
    at, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
    return at.astype(np.int64), (n / max(n.sum(), 1)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """``table``: for every place in the hash space the logits it adds to an average, and 1 if
    it was seen in training. ``heat`` divides logits; ``lowest`` and ``familiar`` are the
    smallest accepted score and share of seen subwords."""

    settings: Settings
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    lowest: float
    familiar: float

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, its probability and the share of subwords seen in training.

        All of the text counts, a block of letters after the other. Without a letter, or
        without any language learned, the language is ``und``.
        """
        nothing = (UNKNOWN, 0.0, 0.0)
        if not text or not self.languages:
            return nothing
        sums, n = np.zeros(self.table.shape[1]), 0
        codes = letters(text)
        if not codes.any():
            return nothing
        for begin in range(0, len(codes), _BLOCK):
            # Blocks overlap by three: each run is in the block in which it begins.
            for size, found in enumerate(subwords(codes[begin : begin + _BLOCK + 3], self.settings.bits), 2):
                found = self._beginning(codes, begin, size, found)
                sums += self.table[found].sum(axis=0, dtype=np.float64)
                n += len(found)
        mean = sums / n
        p = softmax((mean[:-1] + self.bias) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), float(mean[-1])

    def _beginning(self, codes, begin, size, found):
        """Without the runs that begin in the next block."""
        block = codes[begin : begin + _BLOCK + 3]
        if len(block) <= _BLOCK:
            return found
        tail = subwords(block[_BLOCK:], self.settings.bits)
        extra = len(tail[size - 2]) if size - 2 < len(tail) else 0
        return found[: len(found) - extra]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learnable(doc_id) -> F.Column:
    """False for the held-out third of the ids: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit(
    docs: DataFrame, *, settings: Settings | None = None, pieces: int = PIECES,
    text_column: str = "text", language_column: str = "lang", where=None,
) -> Model:
    """Learn from about ``pieces`` distinct pieces of the labelled texts, alike for each language.

    Every text is cut into pieces as a whole; those whose hash is below the share of
    their language are taken, copies once. Languages with few pieces give all they have.
    ``where`` picks the rows to learn from (by default those that are not held out). One
    task runs over the pieces in an order by hash; a fifth of them is left out of training
    and sets the heat and the limits of rejection.
    """
    settings = settings or Settings()
    known = docs.filter(learnable(F.col("doc_id")) if where is None else where).select(
        F.col(f"`{language_column}`").cast("string").alias("language"), text_or_empty(text_column).alias("text")
    ).filter("language is not null")
    size = F.ceil(F.length("text") / PIECE)
    counts = known.groupBy("language").agg(F.sum(size).alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"More than {LANGUAGES} languages to learn.")
    each = pieces / max(len(counts), 1)
    share = {r["language"]: min(1.0, each / r["n"]) for r in counts if r["n"]}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for language, text in zip(batch["language"], batch["text"], strict=True):
                for i in range(0, len(text), PIECE):
                    piece = text[i : i + PIECE]
                    turn = xxhash.xxh64_intdigest(piece.encode("utf-8", "replace"), 1)
                    if turn / 2.0**64 <= share[language]:
                        rows.append((language, piece, turn - (1 << 63)))
            yield pd.DataFrame(rows, columns=["language", "piece", "turn"]).drop_duplicates()

    chosen = known.mapInPandas(cut, "language string, piece string, turn long").distinct()

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "piece", "language"])
        names = sorted(set(group["language"]))
        rows = [
            (_places(piece, settings.bits), names.index(language))
            for piece, language in zip(group["piece"], group["language"], strict=True)
        ]
        rows = [row for row in rows if len(row[0][0])]
        table, *numbers = _train(rows, len(names), settings)
        out = pd.DataFrame({"kind": ["table"], "name": [None], "value": [table.tobytes()]})
        for kind, value in zip(("bias", "numbers"), numbers, strict=True):
            out.loc[len(out)] = [kind, None, value.astype(np.float64).tobytes()]
        for name in names:
            out.loc[len(out)] = ["language", name, b""]
        return out

    found = (
        chosen.withColumn("model", F.lit(0)).groupBy("model")
        .applyInPandas(learn, "kind string, name string, value binary").collect()
    )
    if not found:
        return Model(settings, [], np.zeros((1 << settings.bits, 1), np.float32), np.zeros(0), 1.0, 0.0, 0.0)
    parts = {r["kind"]: r["value"] for r in found}
    languages = sorted(r["name"] for r in found if r["kind"] == "language")
    table = np.frombuffer(parts["table"], np.float32).reshape(1 << settings.bits, -1)
    heat, lowest, familiar = np.frombuffer(parts["numbers"])
    return Model(settings, languages, table, np.frombuffer(parts["bias"]), float(heat), float(lowest), float(familiar))


def descend(inner, outer, bias, at, weight, label: int, rate: float) -> None:
    """One step of stochastic gradient descent on the cross-entropy of one piece.

    Its logits are ``outer`` applied to ``_SCALE`` times the average of the embeddings.
    """
    mean = _SCALE * (weight @ inner[at])
    slope = softmax(outer @ mean + bias)
    slope[label] -= 1
    back = outer.T @ slope
    outer -= rate * np.outer(slope, mean)
    bias -= rate * slope
    inner[at] -= rate * _SCALE * np.outer(weight, back)


def _train(rows, classes: int, settings: Settings):
    """Embeddings and output weights by gradient descent, then calibration."""
    rng = np.random.default_rng(settings.seed)
    size = 1 << settings.bits
    inner = rng.standard_normal((size, settings.width)).astype(np.float32)
    outer = np.zeros((classes, settings.width), np.float32)
    bias = np.zeros(classes, np.float32)
    aside, train = rows[::5], [row for i, row in enumerate(rows) if i % 5] or rows
    seen = np.zeros(size, np.float32)
    step, steps = 0, settings.epochs * len(train)
    for _ in range(settings.epochs):
        for (at, weight), label in train:
            descend(inner, outer, bias, at, weight, label, np.float32(settings.rate * (1 - step / steps)))
            seen[at] = 1
            step += 1
    # Logits are linear in the average, so every place gets the logits it adds to it.
    table = np.float32(_SCALE) * (inner @ outer.T)
    logits = np.array([weight @ table[at] + bias for (at, weight), _ in aside]).reshape(-1, classes)
    labels = np.array([label for _, label in aside], int)
    heat = 1.0
    if len(labels):
        heats = np.geomspace(0.05, 20, 60)
        mine = np.arange(len(labels)), labels
        heat = min(heats, key=lambda h: -np.log(softmax(logits / h)[mine] + 1e-12).mean())
    p = softmax(logits / heat)
    right = p.argmax(axis=1) == labels
    lowest = familiar = 0.0
    if right.any():
        known = np.array([weight @ seen[at] for (at, weight), _ in aside])
        lowest = np.quantile(p.max(axis=1)[right], settings.rejected)
        familiar = np.quantile(known[right], settings.rejected)
    table = np.concatenate((table, seen[:, None]), axis=1).astype(np.float32)
    return table, bias, np.array([heat, lowest, familiar])


def languages(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` and ``rejected`` added after them.

    ``lang_pred`` is the likeliest of the learned languages, ``und`` for texts that are
    null or have no letter; ``score`` is its calibrated probability, 0 for ``und``.
    ``rejected`` says that the score or the share of subwords known from training is below
    what pieces of the learned languages reach, or that the language is ``und``. Columns of
    these names are replaced. Repeated rows get equal results, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            rows = [m.judge(t) for t in texts]
            yield pd.DataFrame(
                {
                    "lang_pred": [r[0] for r in rows],
                    "score": [r[1] for r in rows],
                    "rejected": [r[0] == UNKNOWN or r[1] < m.lowest or r[2] < m.familiar for r in rows],
                }
            )

    added = ["lang_pred", "score", "rejected"]
    place = "judged"
    while place in docs.columns:
        place += "_"
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return docs.select(*rest, judged(text_or_empty(text_column)).alias(place)).select(
        *rest, *[F.col(f"{place}.{c}") for c in added]
    )
