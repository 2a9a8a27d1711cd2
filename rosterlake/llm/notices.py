"""License scans: short notices found with a bounded number of edits.

Texts and notices are reduced to lower-case words with one blank around each. A notice that may have k edits
is split into k + 1 pieces: k edits cannot touch them all, so every place within the bound holds a piece as
it is. One automaton finds the pieces of all notices in a text; where a piece stands says where its notice
would begin, give or take k characters. In that window the regex library looks for the notice with at most k
edits (insertions, deletions, substitutions), prefers the fewest, and says where it stands and how many there
are. No other part of a text is searched by patterns.

Short phrases are notices too. Their words of up to SHORT characters must stand as they are, and every notice
begins and ends at a blank, so `limit license` is not `mit license`. A phrase of the base list without edits is a base
place; what has edits, and every other notice, is the method's own.

Defined results
* Null text and text without words: no words, no places, score 0, empty lists.
* Every place of a base phrase is found, also where places share a word. Places of one notice with the same
  span count once; of overlapping places of one notice with edits, the one with the fewest edits stays,
  then the first.
* Words are numbered from 0; a place holds first and last word, and characters of the text, end exclusive.
* score: the largest share of a notice's characters that is not edited, over all places.
* Texts of any length are read whole; repeated rows repeat. An empty table gives no rows.
* The column `notices` is replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import

#: What a word is, once A-Z is lower-cased: digits, letters, and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words of a short phrase that may not be edited have up to so many characters.
SHORT = 4
#: One edit is allowed for so many characters of a notice, and at most MOST_EDITS.
CHARS_PER_EDIT, MOST_EDITS = 16, 4


@dataclass(frozen=True)
class Notice:
    """Words to look for. Base phrases keep short words whole; long notices may differ anywhere."""

    label: str
    words: str
    base: bool = False
    phrase: bool = False

    @property
    def text(self) -> str:
        return f" {' '.join(WORD.findall(self.words.translate(LOWER)))} "

    @property
    def edits(self) -> int:
        return min(MOST_EDITS, max(1, len(self.text) // CHARS_PER_EDIT))

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): edits + 1 parts of about the same length."""
        n, parts = len(self.text), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def pattern(self) -> regex.Pattern:
        """The notice with its bounded edits, the fewest first; both ends at a blank."""
        if not self.phrase:
            return regex.compile(f"(?b) (?:{self.text[1:-1]}){{e<={self.edits}}} ")
        # Each long word may take all the edits; their sum is checked where the pattern has matched.
        made = [f"(?:{w}){{e<={self.edits}}}" if len(w) > SHORT else w for w in self.text.split()]
        return regex.compile(f"(?b) {' '.join(made)} ")


#: The base phrases and their labels (fixed values).
BASE = (
    Notice("mit", "mit license", base=True, phrase=True),
    Notice("apache", "apache license", base=True, phrase=True),
    Notice("gpl", "general public license", base=True, phrase=True),
)
#: Opening words of public licenses and of their short notices (fixed values).
SHORT_NOTICES = (
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Notice("apache", "Licensed under the Apache License, Version 2.0"),
    Notice("apache", "you may not use this file except in compliance with the License"),
    Notice("gpl", "under the terms of the GNU General Public License as published by"),
    Notice("lgpl", "lesser general public license", phrase=True),
    Notice("agpl", "affero general public license", phrase=True),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    Notice("mpl", "subject to the terms of the Mozilla Public License"),
    Notice("mpl", "mozilla public license", phrase=True),
    Notice("epl", "eclipse public license", phrase=True),
    Notice("boost", "boost software license", phrase=True),
    Notice("unlicense", "This is free and unencumbered software released into the public domain"),
    Notice("cc", "creative commons attribution", phrase=True),
    Notice("cc", "licensed under cc by", phrase=True),
    Notice("cc", "licensed under a creative commons attribution"),
)
NOTICES = BASE + SHORT_NOTICES

_PLACE = pa.struct([
    ("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("likeness", pa.float64()),
    ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
])
_TYPE = pa.struct([("n_words", pa.int64()), ("places", pa.list_(_PLACE))])
_SCHEMA = (
    "struct<n_words: bigint, places: array<struct<label: string, base: boolean, edits: int, likeness: double,"
    " first_word: bigint, last_word: bigint, start: bigint, end: bigint>>>"
)


class Finder:
    """The automaton of all pieces, and the patterns."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.texts = [n.text for n in notices]
        self.edits = [n.edits for n in notices]
        self.patterns = [n.pattern() for n in notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                pieces.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()
        self.seen: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def candidates(self, words: str) -> set[tuple[int, int]]:
        """(notice, where it would begin), for every piece that stands in the words."""
        return {(i, end + 1 - n - offset) for end, (n, at) in self.automaton.iter(words) for i, offset in at}

    def verified(self, notice: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of the notice in a window, if it is there within the bound."""
        key = (notice, window)
        if key not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            match = self.patterns[notice].search(window)
            edits = sum(match.fuzzy_counts) if match else 0
            self.seen[key] = (match.start(), match.end(), edits) if match and edits <= self.edits[notice] else None
        return self.seen[key]

    def find(self, words: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in the blank-separated words, sorted."""
        found: dict[int, dict[tuple[int, int], int]] = {}
        for i, begin in self.candidates(words):
            k, n = self.edits[i], len(self.texts[i])
            low = max(0, begin - k)
            hit = self.verified(i, words[low : begin + n + k])
            if hit:
                found.setdefault(i, {})[low + hit[0], low + hit[1]] = hit[2]
                # Of two places without edits in one window (a phrase that overlaps itself) the pattern gives one.
                if begin >= 0 and words.startswith(self.texts[i], begin):
                    found[i][begin, begin + n] = 0
        places = []
        for i, spans in found.items():
            places += [(a, b, i, e) for (a, b), e in _apart(spans)]
        return sorted(places)


def _apart(spans: dict[tuple[int, int], int]) -> Iterator[tuple[tuple[int, int], int]]:
    """All spans without edits, and of the others those with the fewest edits that overlap none kept so far.

    Neighbours share a blank, which is no overlap.
    """
    kept: list[tuple[int, int]] = sorted(s for s, e in spans.items() if e == 0)
    yield from ((s, 0) for s in kept)
    longest = max((b - a for a, b in spans), default=0)
    for edits, a, b in sorted((e, a, b) for (a, b), e in spans.items() if e):
        near = bisect_right(kept, (a - longest, 0))
        free = True
        while near < len(kept) and kept[near][0] < b - 1:
            free = free and kept[near][1] - 1 <= a
            near += 1
        if free:
            kept.insert(bisect_right(kept, (a, b)), (a, b))
            yield (a, b), edits


@lru_cache(maxsize=2)
def _finder(notices: tuple[Notice, ...]) -> Finder:
    return Finder(notices)


def places(finder: Finder, text: str | None) -> tuple[int, list[dict]]:
    """(number of words, places of notices in order)."""
    lowered = (text or "").translate(LOWER)
    words = WORD.findall(lowered)
    if not words:
        return 0, []
    joined = f" {' '.join(words)} "
    found = finder.find(joined)
    if not found:
        return len(words), []
    spans = [m.span() for m in WORD.finditer(lowered)]
    begins, at = [], 0
    for w in words:
        begins.append(at)
        at += len(w) + 1
    out = []
    for a, b, i, edits in found:
        notice = finder.notices[i]
        # A place begins at the blank before its first word and ends after the one behind its last.
        first, last = bisect_right(begins, a) - 1, bisect_right(begins, b - 2) - 1
        out.append({
            "label": notice.label, "base": notice.base and edits == 0, "edits": edits, "likeness": 1 - edits / (len(finder.texts[i]) - 2),
            "first_word": first, "last_word": last, "start": spans[first][0], "end": spans[last][1],
        })
    return len(words), out


def scan(df: DataFrame, text: str = "text", *, notices: tuple[Notice, ...] = NOTICES, name: str = "notices") -> DataFrame:
    """df with struct<n_words, places> of its texts."""
    workers_import(df.sparkSession)

    @F.arrow_udf(_SCHEMA)
    def find(texts: pa.Array) -> pa.Array:
        finder = _finder(notices)
        rows = [places(finder, t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([n for n, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.list_(_PLACE))], fields=list(_TYPE)
        )

    return df.withColumn(name, find(F.col(text)))


def summary(scanned: DataFrame, *columns: str, name: str = "notices") -> DataFrame:
    """Counts, labels and score of each scanned row, beside the given columns."""
    all_places = F.col(f"{name}.places")
    base = F.filter(all_places, lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first_word"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    return scanned.select(
        *columns,
        F.col(f"{name}.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(all_places).alias("labels"),
        F.coalesce(F.array_max(F.transform(all_places, lambda p: p["likeness"])), F.lit(0.0)).alias("score"),
        F.array_join(
            F.transform(all_places, lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("label", "start", "end", "edits")])), ","
        ).alias("spans"),
    )
