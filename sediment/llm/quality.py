"""Quality rules: words and lines, and how well tokenizers fit a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.bpe import read_ranks
from sediment.llm.tables import kept, text_or_empty

_WINDOW = 5
_SYMBOLS = b"#*$%&|<>"
_WORDS = 200_000  # words of which a worker remembers the tokens, twice
_CHARS = 1 << 21  # characters of texts that are measured at once


@dataclass(frozen=True)
class Band:
    """What the texts of a language or script may have.

    For each figure the band reaches from its lower to its upper quartile over all texts
    of that language or script, and ``reach`` times their distance beyond, more so for
    short texts (``tokens``, at which a text counts half) and where there are few texts.
    The bounds given here hold besides, for all of them.
    """

    reach: float = 3.0
    tokens: int = 200
    least_chars: float = 1.2
    most_chars: float = 9.0
    most_fallback: float = 0.2
    least_entropy: float = 2.0


#: By language, and for languages that are not named by script.
BANDS = {
    "en": Band(),
    "de": Band(),
    "fr": Band(),
    "es": Band(),
    "latin": Band(),
    "greek": Band(least_chars=0.8, most_fallback=0.4),
    "cyrillic": Band(least_chars=0.8, most_fallback=0.4),
    "arabic": Band(least_chars=0.5, most_fallback=0.7),
    "cjk": Band(least_chars=0.3, most_fallback=0.8),
    "other": Band(least_chars=0.25, most_fallback=0.9),
}
#: The figures that are judged, each with the least distance of its quartiles.
FIGURES = {
    "chars_per_token": 0.05, "byte_chars_per_token": 0.05, "fallback_share": 0.02, "token_entropy": 0.1,
}
_FEW = 40  # texts of a language or script at which its quartiles are that much less certain
# First code points of the scripts told apart here.
_SCRIPTS = [
    (0x41, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"),
    (0x590, "arabic"), (0x780, "other"), (0x3040, "cjk"), (0xA4D0, "other"), (0xAC00, "cjk"),
    (0xD7B0, "other"),
]
_STARTS = np.array([s for s, _ in _SCRIPTS])


def script_of(text: str) -> str:
    """The script with the most letters; ``other`` without any."""
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), "<u4")
    if not len(points):
        return "other"
    counts = np.bincount(np.searchsorted(_STARTS, points, side="right"), minlength=len(_SCRIPTS) + 1)
    names: dict[str, int] = {}
    for n, (_, name) in zip(counts[1:], _SCRIPTS, strict=True):
        names[name] = names.get(name, 0) + int(n)
    return max(names, key=lambda name: (names[name], name))


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words that stand in a window of words found twice or more, the first one included."""
    numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
    return _repeated(np.array([numbers[word] for word in words], np.int64), window)


def _repeated(ids: np.ndarray, window: int = _WINDOW) -> int:
    """``repeated_words`` of words given as numbers."""
    count = len(ids) - window + 1
    if count < 2:
        return 0
    # Windows are numbered exactly, word by word: pairs of (number so far, next word). Those
    # that begin like no other one are not found twice.
    at, places, many = np.arange(count), ids[:count], int(ids.max()) + 1
    for k in range(min(1, window - 1), window):
        _, places, times = np.unique(places * many + ids[at + k], return_inverse=True, return_counts=True)
        again = times[places] > 1
        at, places = at[again], places[again]
        if not len(at):
            return 0
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[at + k] = True
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Fertility:
    """Tokens of words under two public vocabularies.

    A word, with a space before it, is tokenised once and then remembered. The piece
    vocabulary gives tokens, entropy and byte fallback, the byte-level one a second
    number of characters per token.
    """

    def __init__(self, piece_model: bytes, ranks: dict[bytes, int], pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.bytes = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: Piece ids, and the number of byte-level tokens, of the latest words and those before.
        self.known: tuple[dict, dict] = ({}, {})
        self.before: tuple[dict, dict] = ({}, {})

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.known
        old_ids, old_counts = self.before
        new = []
        for word in words:
            if word in old_ids:
                ids[word], counts[word] = old_ids[word], old_counts[word]
            else:
                new.append(word)
        for word, pieces in zip(new, self.pieces.encode(new, num_threads=1), strict=True):
            ids[word] = tuple(pieces)
            counts[word] = len(self.bytes.encode_ordinary(f" {word}"))

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of different words: numbers of piece tokens, these tokens end to end, numbers of byte-level tokens."""
        if len(self.known[0]) > _WORDS:
            self.known, self.before = ({}, {}), self.known
        ids, counts = self.known
        self._learn([word for word in words if word not in ids])
        pieces = [ids[word] for word in words]
        return (
            np.array([len(p) for p in pieces], np.int64),
            np.array(list(chain.from_iterable(pieces)), np.min_scalar_type(len(self.fallback))),
            np.array([counts[word] for word in words], np.int64),
        )


def _entropy(tokens: np.ndarray) -> float:
    """In bits."""
    if not len(tokens):
        return 0.0
    tokens = np.sort(tokens)
    borders = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
    shares = np.diff(borders, prepend=0, append=len(tokens)) / len(tokens)
    return float(-(shares * np.log2(shares)).sum())


_models: dict[int, Fertility] = {}


def _fertility(shared) -> Fertility:
    value = shared.value
    key = hash((value[0], frozenset(value[1].items()), value[2]))
    if key not in _models:
        _models.clear()
        _models[key] = Fertility(*value)
    return _models[key]


def judge_quality(
    docs: DataFrame,
    piece_path: str,
    rank_path: str,
    pattern: str,
    *,
    bands: dict[str, Band] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str | None = "lang",
) -> DataFrame:
    """Counts, tokenizer figures and verdicts for every whole text.

    Per row: the id; ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words``; ``n_tokens``, ``chars_per_token``, ``byte_chars_per_token``,
    ``fallback_share``, ``token_entropy``; ``band`` (the language if it has a band, else
    the script); ``base_failed``; ``reasons``, a string of the figures outside the band;
    ``kept``. Null is the empty text; a text without words fails the base rule and has
    figures of 0. Rows that repeat are judged each; an empty table gives no rows.

    Figures are made in one pass and kept. Their quartiles, a row per band, come from all
    texts with words, where equal figures count once: a group of copies does not move them.
    """
    bands = BANDS if bands is None else bands
    with open(piece_path, "rb") as file:  # vocabulary files have a fixed size
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((model, read_ranks(rank_path), pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fertility = _fertility(shared)
        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].tolist()
            rows = []
            for part in _parts([len(text) for text in texts]):
                rows += _measure(texts[part], langs[part], fertility, bands)
            out = pd.DataFrame(rows, columns=[name for name, _ in _FIELDS])
            out.insert(0, id_column, batch[id_column].to_numpy())
            yield out

    rows = docs.select(
        F.col(f"`{id_column}`").alias(id_column),
        text_or_empty(text_column).alias("text"),
        text_or_empty(lang_column).alias("lang") if lang_column else F.lit("").alias("lang"),
    )
    kind = rows.schema[id_column].dataType.simpleString()
    measured = kept(
        rows.mapInPandas(run, f"`{id_column}` {kind}, " + ", ".join(f"{a} {b}" for a, b in _FIELDS))
    )
    return _judged(measured, _limits(measured, bands)).select(
        f"`{id_column}`", *[name for name, _ in _FIELDS], "reasons", "kept"
    )


def rejections(judged: DataFrame) -> DataFrame:
    """Number of texts that pass the base rule and that a figure rejects: ``band``, ``reason``, ``texts``."""
    reason = F.explode(F.split("reasons", ",")).alias("reason")
    outside = judged.filter(~F.col("base_failed") & (F.col("reasons") != "")).select("band", reason)
    return outside.groupBy("band", "reason").agg(F.count(F.lit(1)).alias("texts"))


_FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("n_tokens", "long"), ("chars_per_token", "double"),
    ("byte_chars_per_token", "double"), ("fallback_share", "double"), ("token_entropy", "double"),
    ("band", "string"), ("base_failed", "boolean"),
]


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Neighbouring texts of ``_CHARS`` characters together, or a single one that is longer."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > _CHARS:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if sizes:
        yield slice(begin, len(sizes))


def _sums(values: np.ndarray) -> np.ndarray:
    """The sums of the first 0, 1, ... values."""
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def _measure(texts: list[str], langs: list[str], fertility: Fertility, bands: dict[str, Band]) -> list[tuple]:
    """The fields of every text. Words are told apart and tokenised once for all texts together."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    words = split.flatten()
    filled = pc.greater(pc.binary_length(words), 0)  # none before and after white space at the ends
    bounds = _sums(filled.to_numpy(zero_copy_only=False))[split.offsets.to_numpy()]
    coded = words.filter(filled).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    counts, tokens, seconds = fertility.of(coded.dictionary.to_pylist())

    ends = _sums(counts)
    fallbacks = np.diff(_sums(fertility.fallback[tokens])[ends])
    chars, second, fallback, total = (
        _sums(of_word[ids])[bounds]
        for of_word in (pc.utf8_length(coded.dictionary).to_numpy(), seconds, fallbacks, counts)
    )
    # The tokens of all texts: those of the words, one word after the other.
    times = counts[ids]
    stream = tokens[np.arange(total[-1]) + np.repeat(ends[ids] - _sums(times)[:-1], times)]

    rows = []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        data = text.encode()
        n, n_chars, n_second, n_fallback, n_tokens = (
            int(x[i + 1] - x[i]) for x in (bounds, chars, second, fallback, total)
        )
        repeats = _repeated(ids[bounds[i] : bounds[i + 1]])
        rows.append((
            n, n_chars, len(data) - len(data.translate(None, _SYMBOLS)), repeated_lines(data), repeats,
            n_tokens, n_chars / n_tokens if n_tokens else 0.0, n_chars / n_second if n_second else 0.0,
            n_fallback / n_tokens if n_tokens else 0.0, _entropy(stream[total[i] : total[i + 1]]),
            lang if lang in bands else script_of(text), n < 10 or 100 * repeats > 20 * n,
        ))
    return rows


def _limits(measured: DataFrame, bands: dict[str, Band]) -> DataFrame:
    """A row per band: its quartiles, widths and own bounds."""
    alike = ["band", "n_words", "word_chars", "n_tokens", *FIGURES]
    quartiles = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in FIGURES]
    found = (
        measured.filter("n_tokens > 0").dropDuplicates(alike)
        .groupBy("band").agg(F.count(F.lit(1)).alias("texts"), *quartiles)
        .collect()  # no more rows than bands
    )
    rows = []
    for r in found:
        band = bands.get(r["band"], Band())
        ends = []
        for name, least in FIGURES.items():
            low, high = r[name]
            ends += [low, high, band.reach * max(high - low, least)]
        own = (band.least_chars, band.most_chars, band.most_fallback, band.least_entropy)
        rows.append((r["band"], float(band.tokens), _FEW / r["texts"], *ends, *own))
    names = [f"{end}_{c}" for c in FIGURES for end in ("low", "high", "more")]
    own = ["least_chars", "most_chars", "most_fallback", "least_entropy"]
    ddl = "limits_of string, " + ", ".join(f"{n} double" for n in ["half", "few", *names, *own])
    return measured.sparkSession.createDataFrame(rows, ddl)


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    wider = F.sqrt(1 + F.col("half") / F.greatest("n_tokens", F.lit(1)) + F.col("few"))
    own = {
        "chars_per_token": ~F.col("chars_per_token").between(F.col("least_chars"), F.col("most_chars")),
        "fallback_share": F.col("fallback_share") > F.col("most_fallback"),
        "token_entropy": F.col("token_entropy") < F.col("least_entropy"),
    }
    reasons = []
    for c in FIGURES:
        more = F.col(f"more_{c}") * wider
        outside = (F.col(c) < F.col(f"low_{c}") - more) | (F.col(c) > F.col(f"high_{c}") + more)
        reasons.append(F.when((F.col("n_tokens") > 0) & (outside | own.get(c, F.lit(False))), F.lit(c)))
    joined = measured.join(F.broadcast(limits), F.col("band") == F.col("limits_of"), "left")
    return joined.withColumn("reasons", F.concat_ws(",", *reasons)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("reasons") == "")
    )
