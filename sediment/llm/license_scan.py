"""Licence notices in texts, found also with a few letters wrong."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.tables import text_or_empty

# Phrases and the labels that they stand for.
BASE_NOTICES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Further notices, in words of their usual wording.
NOTICES = {
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
}

_SPACED = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Notice:
    """A phrase of words with single spaces; ``edits`` letters may be wrong, missing or too many."""

    phrase: str
    label: str
    edits: int
    base: bool = False


def notices(per_edit: int = 12, most: int = 3) -> list[Notice]:
    """The known notices, with one edit for every ``per_edit`` letters."""
    return [
        Notice(phrase, label, min(len(phrase) // per_edit, most), base)
        for group, base in ((BASE_NOTICES, True), (NOTICES, False))
        for phrase, label in group.items()
    ]


def words_of(text: str) -> list[bytes]:
    """Runs of digits, a-z (A-Z are made lower) and characters beyond ASCII."""
    return text.encode().lower().translate(_SPACED).split()


class Scanner:
    """Looks for all notices in one pass over a text.

    A phrase with k edits allowed is cut into k + 1 seeds. Whatever text is within k
    edits of the phrase has one of the seeds unchanged (pigeonhole), so an automaton
    over all seeds gives every place where a match can be. There the bounded-error
    matching of the regex library verifies the edits and gives the span.
    """

    def __init__(self, known: list[Notice]):
        self.known = known
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, notice in enumerate(known):
            n, parts = len(notice.phrase), notice.edits + 1
            cuts = [n * k // parts for k in range(parts + 1)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                seeds[notice.phrase[start:stop]].append((i, start))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()
        self.patterns = [
            regex.compile(rf"(?e)(?<= )(?:{regex.escape(x.phrase, special_only=True)}){{e<={x.edits}}}(?= )")
            for x in known
        ]

    def scan(self, spaced: str) -> list[tuple[int, int, int, int]]:
        """Matches in words with a space before and behind each: notice, start, end, edits."""
        windows: dict[int, list[list[int]]] = defaultdict(list)
        exact: dict[int, dict[int, None]] = defaultdict(dict)
        for end, (length, places) in self.automaton.iter(spaced):
            for i, offset in places:
                notice = self.known[i]
                start = end + 1 - length - offset
                stop = start + len(notice.phrase)
                if start > 0 and spaced.startswith(f" {notice.phrase} ", start - 1):
                    exact[i][start] = None
                elif notice.edits:
                    slack = notice.edits + 1
                    low, high = max(start - slack, 0), min(stop + slack, len(spaced))
                    if windows[i] and low <= windows[i][-1][1]:
                        windows[i][-1][0] = min(low, windows[i][-1][0])
                        windows[i][-1][1] = max(high, windows[i][-1][1])
                    else:
                        windows[i].append([low, high])
        found = [
            (i, start, start + len(self.known[i].phrase), 0) for i, starts in exact.items() for start in starts
        ]
        for i, places in windows.items():
            for low, high in places:
                for match in self.patterns[i].finditer(spaced, low, high):
                    edits = sum(match.fuzzy_counts)
                    if edits:  # the exact places are known
                        found.append((i, match.start(), match.end(), edits))
        return sorted(set(found), key=lambda x: (x[1], x[2], x[0]))


def scan_notices(
    docs: DataFrame,
    known: list[Notice] | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """All notices in each text, over the whole of it.

    Per row: the id, ``n_words`` and ``matches``, an array of (``label``, ``phrase``,
    ``base``, ``first_word``, ``n_words``, ``edits``, ``similarity``) by place. Words count
    from 0; similarity is 1 less the edits for each letter of the phrase. Null is the
    empty text, without words or matches; rows that repeat are scanned each; an empty
    table gives no rows.
    """
    known = notices() if known is None else known

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(known)
        for batch in batches:
            counts, results = [], []
            for text in batch["text"]:
                words = words_of(text)
                counts.append(len(words))
                spaced = f" {b' '.join(words).decode()} "
                found = scanner.scan(spaced)
                # Places of the spaces, once for all matches of a text.
                spaces = [m.start() for m in re.finditer(" ", spaced)] if found else []
                results.append([_match(scanner, spaces, *x) for x in found])
            yield pd.DataFrame({id_column: batch[id_column], "n_words": counts, "matches": results})

    rows = docs.select(F.col(f"`{id_column}`").alias(id_column), text_or_empty(text_column).alias("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    match = "label string, phrase string, base boolean, first_word long, n_words long, edits int, similarity double"
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in match.split(","))
    return rows.mapInPandas(run, f"`{id_column}` {kind}, n_words long, matches array<struct<{fields}>>")


def _match(scanner: Scanner, spaces: list[int], i: int, start: int, end: int, edits: int) -> dict:
    notice = scanner.known[i]
    before, until = bisect_left(spaces, start), bisect_left(spaces, end)
    return {
        "label": notice.label,
        "phrase": notice.phrase,
        "base": notice.base and not edits,
        "first_word": before - 1,
        "n_words": until - before + 1,
        "edits": edits,
        "similarity": 1 - edits / len(notice.phrase),
    }
