"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding."""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import text_or_empty

# Memory of one worker is bounded by forgetting what can be worked out again.
_PIECES = 500_000
_MOVES = 900_000
_SHORT = 64  # bytes of a piece that is read side by side with others
_BYTES = 4 << 20  # of texts that are encoded together


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Merges of a rank table compiled, state by state as needed, into a transducer.

    A sequence of tokens is what merging makes of its bytes exactly if each two
    neighbours are what merging makes of theirs. So the nondeterministic machine may end
    a token wherever its left neighbour permits, and each beginning of a piece has one
    token that ends it. A state of the subset construction is the last token that is
    certain and the bytes read since; its members are the places among these bytes
    from which a token may still reach on. Tokens that the ways to all members share are
    certain and are emitted; no member lags behind by more than the longest token, which
    bounds the lookahead. The last certain token is the left neighbour only of what begins
    where it ends; a state without a member there is the same one after any such token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        #: The tokens as a tree: by byte, the node after it (None at a leaf) and the token there (or -1).
        self.root: dict[int, tuple[dict | None, int]] = {}
        for token, rank in ranks.items():
            node = self.root
            for byte in token[:-1]:
                after, here = node.get(byte, (None, -1))
                if after is None:
                    after = {}
                    node[byte] = after, here
                node = after
            node[token[-1]] = node.get(token[-1], (None, -1))[0], rank
        self.forget()

    def forget(self) -> None:
        """Drop the compiled states."""
        #: Of each state: last certain token, bytes since, token that ends at each of them,
        #: members (place, node of the tree).
        self.states = [(-1, b"", (), ((0, self.root),))]
        self.numbers: dict[tuple, int] = {(-1, b""): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _bound(self) -> None:
        if len(self.moves) > _MOVES:
            self.forget()
        if len(self.fits) > _MOVES:
            self.fits.clear()

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of the pattern; a piece that is a token stays whole."""
        if not piece:
            return ()
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        self._bound()
        return self._read(piece)

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces, which are read side by side: a move that many make is looked up once.

        For the last byte of a piece only the token that ends there is needed, and no state.
        """
        self._bound()
        ranks, moves = self.ranks, self.moves
        found: list[tuple[int, ...]] = []
        open_pieces = []
        for i, piece in enumerate(pieces):
            whole = ranks.get(piece)
            if whole is not None:
                found.append((whole,))
            elif len(piece) > _SHORT:
                found.append(self._read(piece))
            else:
                found.append(())
                open_pieces.append(i)
        at = np.array(open_pieces, np.int64)
        short = [pieces[i] for i in open_pieces]
        data = np.frombuffer(b"".join(short), np.uint8).astype(np.int64)
        sizes = np.array([len(piece) for piece in short], np.int64)
        places, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        states = np.zeros(len(at), np.int64)
        while len(at):
            keys, move_of = np.unique(states << 8 | data[places], return_inverse=True)
            places += 1
            goes_on = places < ends
            used = np.zeros(len(keys), bool)
            used[move_of[~goes_on]] = True
            out: list[tuple[int, ...]] = [()] * len(keys)
            for k, key in zip(np.flatnonzero(used).tolist(), keys[used].tolist(), strict=True):
                out[k] = self._last(key >> 8, key & 255)
            for i, k in zip(at[~goes_on].tolist(), move_of[~goes_on].tolist(), strict=True):
                found[i] += out[k]
            at, move_of, places, ends = at[goes_on], move_of[goes_on], places[goes_on], ends[goes_on]
            used[:] = False
            used[move_of] = True
            after, emits = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            for k, key in zip(np.flatnonzero(used).tolist(), keys[used].tolist(), strict=True):
                move = moves.get(key)
                if move is None:
                    move = moves[key] = self._move(key >> 8, key & 255)
                after[k], out[k] = move
                if move[1]:
                    emits[k] = True
            states = after[move_of]
            some = emits[move_of]
            for i, k in zip(at[some].tolist(), move_of[some].tolist(), strict=True):
                found[i] += out[k]
        return found

    def _read(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece, byte by byte."""
        moves, state, out = self.moves, 0, []
        for byte in piece[:-1]:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self._move(state, byte)
            state, emitted = move
            out += emitted
        return (*out, *self._last(state, piece[-1]))

    def _last(self, state: int, byte: int) -> tuple[int, ...]:
        """The tokens that are not yet emitted where a piece ends with a byte read in a state."""
        ended = self._ending(state, byte)
        _, since, ends, _ = self.states[state]
        return (*self._way(ends, len(since) + 1 - self.sizes[ended]), ended)

    def _way(self, ends: tuple[int, ...], place: int) -> list[int]:
        """The tokens on the way to a place."""
        way = []
        while place:
            token = ends[place - 1]
            way.append(token)
            place -= self.sizes[token]
        way.reverse()
        return way

    def _ending(self, state: int, byte: int) -> int:
        """The token that ends with a byte read in a state."""
        last, _, ends, members = self.states[state]
        for place, node in members:
            step = node.get(byte)
            if step is not None and step[1] >= 0:
                pair = ends[place - 1] if place else last, step[1]
                fits = self.fits.get(pair)
                if fits is None:
                    fits = self.fits[pair] = self._stand_together(*pair)
                if fits:
                    return step[1]
        raise ValueError(f"no token begins with the byte {byte}")

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, since, ends, members = self.states[state]
        reach, ended = [], -1
        for place, node in members:
            step = node.get(byte)
            if step is None:
                continue
            node, rank = step
            if node is not None:
                reach.append((place, node))
            if ended < 0 <= rank:
                pair = ends[place - 1] if place else last, rank
                fits = self.fits.get(pair)
                if fits is None:
                    fits = self.fits[pair] = self._stand_together(*pair)
                if fits:
                    ended = rank
        if ended < 0:
            raise ValueError(f"no token begins with the byte {byte}")
        since += bytes((byte,))
        ends += (ended,)
        reach.append((len(since), self.root))
        emitted: tuple[int, ...] = ()
        if reach[0][0]:
            sizes, cut = self.sizes, reach[0][0]
            for place, _ in reach:  # step back from the further of two places until both ways have met
                while place != cut:
                    if place > cut:
                        place -= sizes[ends[place - 1]]
                    else:
                        cut -= sizes[ends[cut - 1]]
                if not cut:
                    break
            if cut:
                emitted = tuple(self._way(ends, cut))
                last, since, ends = emitted[-1], since[cut:], ends[cut:]
                reach = [(place - cut, node) for place, node in reach]
        number = self.numbers.setdefault((ends if reach[0][0] else last, since), len(self.states))
        if number == len(self.states):
            self.states.append((last, since, ends, tuple(reach)))
        return number, emitted

    def _half(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte.

        A token that merging never makes has (-1, -1).
        """
        if rank not in self.halves:
            token = self.tokens[rank]
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                made = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
                first = min(made)
                if first >= rank:
                    break
                i = made.index(first)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[rank] = (
                None if len(parts) == 1
                else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2
                else (-1, -1)
            )
        return self.halves[rank]

    def _stand_together(self, left: int, right: int) -> bool:
        """Does merging leave these two tokens as they are, side by side?

        Merges are undone from the latest on, at the border only: a merge across it that
        comes before the one undone last would have been made instead.
        """
        if self._half(right) == (-1, -1):
            return False
        if left < 0:
            return True
        before = len(self.ranks) + 1
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < before:
                return False
            ends, begins = self._half(left), self._half(right)
            if ends is None and begins is None:
                return True
            if begins is None or (ends is not None and left > right):
                before, left = left, ends[1]
            else:
                before, right = right + 1, begins[0]


class Utf8Machine:
    """An incremental UTF-8 decoder that takes tokens and gives text.

    Between tokens it keeps the bytes of a character that is not complete. Moves by
    (kept bytes, token) are worked out byte by byte once and then remembered.
    Bytes that no character can have become U+FFFD, one for each.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.complete = _Complete(self)
        self.pending = b""

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        if not self.pending:
            try:
                return "".join(map(self.complete.__getitem__, ids))
            except KeyError:  # some token ends within a character
                pass
        out, pending, moves = [], self.pending, self.moves
        for i in ids:
            move = moves.get((pending, i))
            if move is None:
                if len(moves) > _MOVES:
                    moves.clear()
                move = moves[pending, i] = self._move(pending, self.tokens[i])
            pending, text = move
            out.append(text)
        self.pending = pending
        return "".join(out)

    def finish(self) -> str:
        """Ends the text; what is still pending was no character."""
        rest, self.pending = "�" * len(self.pending), b""
        return rest

    @staticmethod
    def _move(pending: bytes, token: bytes) -> tuple[bytes, str]:
        out = []
        for byte in token:
            pending, text = _utf8_step(pending, byte)
            out.append(text)
        return pending, "".join(out)


class _Complete(dict):
    """The moves that start and end between characters, by token; the others are missing."""

    def __init__(self, machine: Utf8Machine):
        super().__init__()
        self.machine = machine

    def __missing__(self, i: int) -> str:
        pending, text = self.machine._move(b"", self.machine.tokens[i])
        if pending:
            raise KeyError(i)
        self[i] = text
        return text


def _utf8_step(pending: bytes, byte: int) -> tuple[bytes, str]:
    if pending:
        low, high = 0x80, 0xBF
        if len(pending) == 1:  # bounds that rule out overlong forms, surrogates and too large values
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(
                pending[0], (low, high)
            )
        if not low <= byte <= high:
            after, text = _utf8_step(b"", byte)
            return after, "�" * len(pending) + text
        pending += bytes((byte,))
        length = 2 if pending[0] < 0xE0 else 3 if pending[0] < 0xF0 else 4
        return (b"", pending.decode()) if len(pending) == length else (pending, "")
    if byte < 0x80:
        return b"", chr(byte)
    return (bytes((byte,)), "") if 0xC2 <= byte <= 0xF4 else (b"", "�")


class Codec:
    """Texts to ids and back, piece by piece of a pattern.

    With ``cut_at_spaces`` the pattern must end every piece before a single space that
    stands between two characters other than white space; texts are then cut there, and
    what lies between two cuts is worked out once. Where a space has white space beside
    it, the pattern runs over the whole text.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_at_spaces: bool):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.machine = Utf8Machine(self.transducer.tokens)
        self.cut_at_spaces = cut_at_spaces
        #: What is known of the latest words, and of those before; and of pieces, which words share.
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.transducer.encode(piece.encode())
        return out

    def _learn(self, words: list[str]) -> list[tuple[int, ...]]:
        """Work out what follows a space; distinct pieces together."""
        if len(self.pieces) > _PIECES:
            self.pieces = {}
        pieces = self.pieces
        split = [
            [f" {word}"] if word.isascii() and word.isalpha() else self.pattern.findall(f" {word}") for word in words
        ]
        new = list(set(chain.from_iterable(split)).difference(pieces))
        pieces.update(zip(new, self.transducer.encode_many([piece.encode() for piece in new]), strict=True))
        found = [
            pieces[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(pieces.__getitem__, parts)))
            for parts in split
        ]
        self.known.update(zip(words, found, strict=True))
        return found

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        if not self.cut_at_spaces:
            return [self._encode(text) for text in texts]
        if len(self.known) > _PIECES:
            self.known, self.before = {}, self.known
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        distinct, codes, begins = words.dictionary.to_pylist(), words.indices.to_numpy(), split.offsets.to_numpy()
        after_space = np.ones(len(codes), bool)
        after_space[begins[:-1]] = False
        used = np.zeros(len(distinct), bool)
        used[codes[after_space]] = True
        unsafe = np.array([not x or x != x.strip() for x in distinct], bool)
        known, before = self.known, self.before
        found: list[tuple[int, ...]] = [()] * len(distinct)
        new = []
        for i in np.flatnonzero(used & ~unsafe).tolist():
            word = distinct[i]
            ids = known.get(word)
            if ids is None:
                ids = before.get(word)
                if ids is None:
                    new.append(i)
                    continue
                known[word] = ids
            found[i] = ids
        for i, ids in zip(new, self._learn([distinct[i] for i in new]), strict=True):
            found[i] = ids
        # Sums of unsafe words up to each place tell which texts hold some.
        sums = np.concatenate(([0], np.cumsum(unsafe[codes] & after_space)))
        whole = (sums[begins[1:]] > sums[begins[:-1]]).tolist()
        numbers, begins, out = codes.tolist(), begins.tolist(), []
        for text, begin, end, together in zip(texts, begins, begins[1:], whole, strict=False):
            first = distinct[numbers[begin]]
            if together or first != first.strip():
                out.append(self._encode(text))
            else:
                rest = map(found.__getitem__, numbers[begin + 1 : end])
                out.append([*self._encode(first), *chain.from_iterable(rest)])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.machine.feed(ids) + self.machine.finish()


_codecs: dict[tuple, Codec] = {}


def _codec(ranks, pattern: str, cut_at_spaces: bool) -> Codec:
    """The codec of this worker; its tables serve all tasks that the worker runs."""
    table = ranks.value
    key = (hash(frozenset(table.items())), pattern, cut_at_spaces)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(table, pattern, cut_at_spaces)
    return _codecs[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of some length at a time. Meanwhile nothing looks for reference cycles, of which there are none."""
    gc.disable()
    try:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = before = 0
            while at < len(ends):
                end = max(at + 1, int(np.searchsorted(ends, before + _BYTES, side="right")))
                yield batch.slice(at, end - at)
                at, before = end, ends[end - 1]
    finally:
        gc.enable()


def _shared(df: DataFrame, path: str):
    # A vocabulary file has a fixed size, whatever the number of documents.
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    cut_at_spaces: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The id and ``ids`` (array of token ids) of every text; null and empty texts have none."""
    ranks = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern, cut_at_spaces)
        for batch in _slices(batches):
            ids = pa.array(codec.encode_all(batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    rows = docs.select(F.col(f"`{id_column}`").alias(id_column), text_or_empty(text_column).alias("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(
    rows: DataFrame, path: str, *, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """The id and ``text`` of every array of token ids; null arrays give the empty text."""
    ranks = _shared(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, "", False)
        for batch in batches:
            texts = pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_column, "text"])

    rows = rows.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{ids_column}`").alias("ids"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    cut_at_spaces: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encodes and decodes every text, and gives digests of both in place of the ids.

    Per row: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded text as UTF-8). Null is the empty text, with no
    token; rows that repeat are rows of their own.
    """
    ranks = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern, cut_at_spaces)
        decimals = _Decimals()
        for batch in _slices(batches):
            counts, digests, decoded = [], [], []
            for ids in codec.encode_all(batch.column(1).to_pylist()):
                counts.append(len(ids))
                digests.append(sha256(",".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(f"`{id_column}`").alias(id_column), text_or_empty(text_column).alias("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(
        run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


class _Decimals(dict):
    def __missing__(self, i: int) -> str:
        self[i] = text = str(i)
        return text
