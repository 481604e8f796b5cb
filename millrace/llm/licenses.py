"""License scan: short notices found with a bounded number of typing errors."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import ahocorasick
import regex
from pyspark.sql import DataFrame

from millrace.llm.tables import map_rows, text_bytes

# Phrases whose words in a row name a license.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Words of short public notices, in small letters.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2 0": "mpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution noncommercial 4 0": "cc-by-nc",
    "creative commons attribution sharealike 4 0": "cc-by-sa",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
# Names as (exact start, rest, label, most errors); a start of three letters has near misses such as "emit".
NAMES = [
    ("mit ", "license", "mit", 1), ("", "apache license", "apache", 1), ("", "general public license", "gpl", 2),
]
ERRORS = 0.1  # most errors, as a share of a notice's characters
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, score double, spans array<string>"
)


def pieces(text: str, count: int) -> list[tuple[int, str]]:
    """The text cut into ``count`` parts of nearly equal length, each with its offset."""
    cuts = [len(text) * i // count for i in range(count + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


BLANK = re.compile(" ")


class Finder:
    """Exact phrases and fuzzy notices in one text.

    A notice with at most k errors, cut into k + 1 parts, holds one part without error. All parts go into one automaton,
    each hit gives a window that the bounded-error expression must match.
    """

    def __init__(self):
        self.phrases = [(phrase.encode().split(), label) for phrase, label in PHRASES.items()]
        self.seeds = ahocorasick.Automaton()
        self.patterns = []
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(NOTICES.items()):
            k = int(len(notice) * ERRORS)
            self.patterns.append((notice, label, k, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            for offset, part in pieces(notice, k + 1):
                found.setdefault(part, []).append((number, offset))
        for part, places in found.items():
            self.seeds.add_word(part, (len(part), places))
        self.seeds.make_automaton()
        self.name_seeds, self.names = ahocorasick.Automaton(), []
        found = {}
        for start, rest, label, k in NAMES:
            for spelt in (0, 1):  # with "licence" one error more is counted
                text = rest.replace("license", "licence") if spelt else rest
                pattern = regex.compile(rf"(?b)(?<![^ ]){regex.escape(start)}(?:{regex.escape(text)}){{e<={k}}}(?![^ ])")
                for offset, part in pieces(text, k + 1):
                    found.setdefault(part, []).append((len(self.names), len(start) + offset))
                self.names.append((len(start) + len(text), label, k, spelt, pattern))
        for part, places in found.items():
            self.name_seeds.add_word(part, (len(part), places))
        self.name_seeds.make_automaton()

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        found, at = [], -1
        while True:
            try:
                at = words.index(b"license", at + 1)
            except ValueError:
                return found
            for phrase, label in self.phrases:
                start = at - len(phrase) + 1
                if start >= 0 and words[start : at + 1] == phrase:
                    found.append((start, label))

    def fuzzy(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of notices in the text of words joined by blanks; the best of overlapping ones."""
        windows = set()
        for end, (size, places) in self.seeds.iter(text):
            for number, offset in places:
                windows.add((end + 1 - size - offset, number))
        found = []
        for at, number in sorted(windows):
            notice, label, k, pattern = self.patterns[number]
            low = max(0, at - k)
            m = pattern.search(text, low, at + len(notice) + k)
            if m:
                found.append((1 - sum(m.fuzzy_counts) / len(notice), m.start(), m.end(), label))
        kept: list[tuple[int, int, str, float]] = []  # in order, none overlapping
        best = sorted(set(found), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3]))
        for score, start, end, label in [*best, *self.misspelt(text)]:
            at = bisect.bisect_left(kept, (start,))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (start, end, label, score))
        return kept

    def misspelt(self, text: str) -> list[tuple[float, int, int, str]]:
        """(score, start, end, label) of names with errors, whole words only."""
        windows = {
            (end + 1 - size - offset, number)
            for end, (size, places) in self.name_seeds.iter(text) for number, offset in places
        }
        found = set()
        for at, number in windows:
            length, label, k, spelt, pattern = self.names[number]
            m = pattern.search(text, max(0, at - k), at + length + 2 * k + 1)
            errors = sum(m.fuzzy_counts) + spelt if m else 0
            # the end of the window is no end of a word; an exact phrase is found without this
            if errors and text[m.end() : m.end() + 1] in ("", " ") and m[0] not in PHRASES:
                found.add((1 - errors / length, m.start(), m.end(), label))
        return sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3]))

    def find(self, text: bytes) -> tuple:
        words = text.lower().translate(WORD_BYTES).split()
        base = self.base(words)
        joined = b" ".join(words).decode()
        fuzzy = self.fuzzy(joined)
        starts = [s for s, _ in base]
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(label for _, _, label, _ in fuzzy)})
        blanks = [m.start() for m in BLANK.finditer(joined)] if fuzzy else []
        spans = [
            f"{label}:{bisect.bisect_left(blanks, s)}:{bisect.bisect_left(blanks, max(s, e - 1)) + 1}:{score:.3f}" for s, e, label, score in fuzzy
        ]
        score = max([1.0 if base else 0.0, *(x[3] for x in fuzzy)])
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), base_labels, labels, score, spans)


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base (places of exact phrases), first_word and last_word (their
    smallest and largest start, words from 0, else null), base_labels, labels (with those of fuzzy notices), score (best
    share of correct characters, 1 for a phrase, 0 without any), spans (label:first word:end word:score of fuzzy notices).

    Letters A-Z are lower-cased; words are runs of digits, letters a-z and characters beyond ASCII. Null and empty texts
    have no words; null ids and repeated rows are scanned like any other; very long texts take time in proportion to their length.
    """

    def make() -> Callable:
        finder = Finder()
        return lambda id, text: (id, *finder.find(text))

    return map_rows(text_bytes(docs, id_col, text_col), make, SCHEMA)
