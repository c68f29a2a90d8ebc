"""License scans: exact phrases and a fuzzy search for short notices.

Texts are lower-cased on A-Z and cut into words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Base
    Places where the words of a phrase stand consecutively.

Fuzzy search
    Notices are searched in the words joined by one space, with at most one edit
    per ``EDIT_EVERY`` characters.  A notice with k edits is cut into k + 1
    pieces, one of which a match must hold unchanged (pigeonhole), within k
    places of its own; an Aho-Corasick automaton finds all pieces of all notices
    in one pass.  Around each seed the ``regex`` library's best match with at
    most k errors, at word ends, verifies the edits and gives the span.  Of
    overlapping matches of a label the one with the fewest errors stays, then
    the leftmost.

    Cost per document is one pass, and a window of a notice's length per seed.

Defined results
    A null text is empty: no words, no labels, score 0.  The score is 1 for a
    base place, else the best match's share of unedited characters.  Spans are in
    code points of the original text, end exclusive.  Every input row gives one
    row.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons zero", "cc0"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("all rights reserved", "all-rights-reserved"),
)
EDIT_EVERY = 12
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Match:
    label: str
    start: int
    end: int
    errors: int
    length: int


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits + 1`` pieces that make up the notice."""
    n = edits + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """The automaton and the patterns of a list of (notice, label)."""

    def __init__(self, notices: Sequence[tuple[str, str]] = NOTICES, every: int = EDIT_EVERY) -> None:
        self.notices = [(n, label, max(1, len(n) // every)) for n, label in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _, edits) in enumerate(self.notices):
            for offset, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b) (?:{regex.escape(n, literal_spaces=True)}){{e<={edits}}} ") for n, _, edits in self.notices]

    def search(self, text: str) -> list[Match]:
        """Matches in words joined by one space, with spans of that text."""
        text = f" {text} "  # a match lies between two spaces, so no window need grow to the end of a word
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                notice, _, edits = self.notices[k]
                a = last - size + 1 - offset
                windows.setdefault(k, []).append((max(0, a - edits - 1), a + len(notice) + edits + 1))
        found: list[Match] = []
        for k, places in windows.items():
            notice, label, edits = self.notices[k]
            done: set[tuple[int, int]] = set()
            for a, b in dict.fromkeys(places):
                if (m := self.patterns[k].search(text, a, b)) and m.span() not in done:
                    done.add(m.span())
                    found.append(Match(label, m.start(), m.end() - 2, sum(m.fuzzy_counts), len(notice)))
        kept: list[Match] = []
        ends: dict[str, list[tuple[int, int]]] = {}
        for m in sorted(found, key=lambda m: (m.label, m.errors / m.length, m.start, -m.end)):
            own = ends.setdefault(m.label, [])  # sorted, and no two overlap
            at = bisect_left(own, (m.start, m.end))
            if (not at or own[at - 1][1] <= m.start) and (at == len(own) or m.end <= own[at][0]):
                own.insert(at, (m.start, m.end))
                kept.append(m)
        return sorted(kept, key=lambda m: (m.start, m.end, m.label))


@dataclass
class Scan:
    n_words: int
    places: list[tuple[int, str]]
    matches: list[Match]
    """Spans in code points of the original text."""

    def row(self) -> tuple:
        starts, base = [p for p, _ in self.places], {label for _, label in self.places}
        score = 1.0 if base else max((max(0.0, 1 - m.errors / m.length) for m in self.matches), default=0.0)
        return self.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m.label for m in self.matches})), score


def scan(text: str, scanner: Scanner, phrases: Sequence[tuple[str, str]] = PHRASES) -> Scan:
    words = text.encode().translate(_TABLE).split()
    joined = b" ".join(words).decode()
    padded, places = f" {joined} ", []
    for phrase, label in phrases:
        needle, at = f" {phrase} ", padded.find(f" {phrase} ")
        seen, before = 0, 0
        while at >= 0:
            before += padded.count(" ", seen, at)
            seen = at
            places.append((before, label))
            at = padded.find(needle, at + 1)
    matches = scanner.search(joined)
    if matches:
        spans = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
        word, seen, before = {}, 0, 0
        for at in sorted({x for m in matches for x in (m.start, m.end)}):  # one running count of the words before
            before += joined.count(" ", seen, at)
            word[at], seen = before, at
        matches = [Match(m.label, spans[word[m.start]][0], spans[word[m.end]][1], m.errors, m.length) for m in matches]
    return Scan(len(words), sorted(places), matches)


_LOWER = {c: c + 32 for c in range(65, 91)}
_scanners: dict[tuple, Scanner] = {}


def scanner_of(notices: Sequence[tuple[str, str]], every: int) -> Scanner:
    key = tuple(notices), every
    if key not in _scanners:
        _scanners[key] = Scanner(notices, every)
    return _scanners[key]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, notices: Sequence[tuple[str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES, every: int = EDIT_EVERY) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, start, end, errors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(notices, every)
        for batch in batches:
            scans = [scan(x.as_py() or "", scanner, phrases) for x in batch.column(1)]
            columns = list(zip(*(s.row() for s in scans))) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            spans = [[{"label": m.label, "start": m.start, "end": m.end, "errors": m.errors} for m in s.matches] for s in scans]
            span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(spans, pa.list_(span))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    kinds = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, errors: int>>"
    return source.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
