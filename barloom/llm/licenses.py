"""License scans: exact phrases, and notices found with a few edits by seeds and bounded-error matching."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barloom.llm.common import alnum_words, id_and_text, in_batches, rows_of

# The phrases of the exact scan and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Short notices as their words, their label, and the edits (characters) a notice may differ by.
NOTICES = (
    ("released under the mit license", "mit", 3),
    ("licensed under the mit license", "mit", 3),
    ("distributed under the terms of the mit license", "mit", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache-2", 4),
    ("apache license version 2 0 january 2004", "apache-2", 3),
    ("you may not use this file except in compliance with the license", "apache-2", 6),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("creative commons attribution noncommercial 4 0", "cc-by-nc", 4),
    ("licensed under cc by 4 0", "cc-by", 1),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1),
    ("creative commons attribution sharealike 4 0", "cc-by-sa", 4),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", 6),
    ("licensed under the gnu general public license version 2", "gpl-2", 3),
    ("under the terms of the gnu general public license", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2 0", "mpl-2", 3),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    ("licensed under the bsd 3 clause license", "bsd", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
)


@dataclass(frozen=True)
class Notice:
    words: bytes
    label: str
    edits: int

    @property
    def seeds(self) -> list[tuple[int, bytes]]:
        """``edits + 1`` parts: whatever the edits, one part stands unchanged."""
        n, k = len(self.words), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def may_stand_in(self, text: bytes) -> bool:
        """An edit spoils at most three of the notice's three-letter parts; all others must be there."""
        parts = [self.words[i : i + 3] for i in range(len(self.words) - 2)]
        return sum(p in text for p in parts) >= len(parts) - 3 * self.edits


class Scanner:
    """Seeds of all notices in one automaton; a seed's surroundings are checked by bounded-error matching."""

    def __init__(self, notices: tuple[tuple[str, str, int], ...]) -> None:
        import ahocorasick

        self.notices = [Notice(w.encode(), label, edits) for w, label, edits in notices]
        self.patterns = [regex.compile(b"(?:%s){e<=%d}" % (regex.escape(n.words, special_only=True), n.edits), regex.ENHANCEMATCH) for n in self.notices]
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for at, seed in notice.seeds:
                seeds.setdefault(seed.decode("latin-1"), []).append((k, at))
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def candidates(self, text: bytes) -> list[list[tuple[int, int]]]:
        """For each notice the stretches that a seed allows: at its place, give or take the edits; merged."""
        found: list[list[tuple[int, int]]] = [[] for _ in self.notices]
        for end, (size, places) in self.automaton.iter(text.decode("latin-1")):
            start = end + 1 - size
            for k, at in places:
                notice = self.notices[k]
                low = start - at - notice.edits
                found[k].append((max(low, 0), low + len(notice.words) + 2 * notice.edits))
        return [_merged(sorted(own)) for own in found]

    def matches(self, text: bytes) -> list[tuple[int, int, str, float]]:
        """(start, end, label, likeness) in the joined words, by start; of overlapping ones the likest, then longest."""
        found = []
        for notice, pattern, own in zip(self.notices, self.patterns, self.candidates(text), strict=True):
            for low, high in own:
                free, left = low, []
                at = text.find(notice.words, low, high)
                while at >= 0:
                    stop = at + len(notice.words)
                    found.append((0.0, -len(notice.words), at, stop, notice.label))
                    left.append((free, at))
                    free = stop
                    at = text.find(notice.words, at + 1, high)
                for a, b in (*left, (free, high)):
                    if a < b and notice.may_stand_in(text[a:b]):
                        for m in pattern.finditer(text, a, b):
                            found.append((sum(m.fuzzy_counts) / len(notice.words), m.start() - m.end(), *m.span(), notice.label))
        out: list[tuple[int, int, str, float]] = []
        for loss, size, a, b, label in sorted(found):
            k = bisect_left(out, (a,))
            clear = (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0])
            if size and clear:
                out.insert(k, (a, b, label, 1 - loss))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


@lru_cache(maxsize=2)
def scanner(notices: tuple[tuple[str, str, int], ...]) -> Scanner:
    return Scanner(notices)


LICENSES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("phrases", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("notices", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("likeness", pa.float64())]))),
    ]
)
LICENSES_DDL = (
    "doc_id bigint, n_words bigint, phrases array<struct<word:bigint,label:string>>, "
    "notices array<struct<start:bigint,end:bigint,label:string,likeness:double>>"
)


def find_licenses(
    docs: DataFrame,
    notices: tuple[tuple[str, str, int], ...] = NOTICES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """License phrases and notices of every whole text: (doc_id, n_words, phrases, notices).

    A text is its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z
    lower-cased, joined by one space. ``phrases`` lists every place where an
    exact phrase's words stand (first word, from 0) by place. A notice that may
    differ by k edits is cut into k + 1 seeds, one of which must stand
    unchanged; an automaton finds all seeds in one pass, and bounded-error
    matching around each verifies the edits and gives the words ``[start, end)``
    touched and the likeness (1: no edit).

    Null and empty texts have no words; equal rows give equal rows; ids may be
    null; an empty table gives no rows; further columns are ignored. Texts of any
    length are searched whole in time linear in them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(notices)
        wanted = [(b" %s " % p.encode(), label) for p, label in phrases]

        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                words = alnum_words(text or b"")
                joined = b" %s " % b" ".join(words)
                spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                exact = sorted((int(np.searchsorted(spaces, at)), label) for p, label in wanted for at in _places(joined, p))
                fuzzy = []
                for a, b, label, like in scan.matches(joined[1:-1]):
                    first = int(np.searchsorted(spaces, a + 1)) - (joined[a + 1 : a + 2] != b" ")
                    last = int(np.searchsorted(spaces, b + 1)) - (joined[b : b + 1] == b" ")
                    fuzzy.append({"start": first, "end": max(last, first + 1), "label": label, "likeness": like})
                yield doc_id, len(words), [{"word": w, "label": label} for w, label in exact], fuzzy

        return in_batches(rows(), LICENSES)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, LICENSES_DDL)


def _places(text: bytes, phrase: bytes) -> Iterator[int]:
    at = text.find(phrase)
    while at >= 0:
        yield at
        at = text.find(phrase, at + 1)
