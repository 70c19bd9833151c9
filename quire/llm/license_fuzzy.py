r"""Fuzzy search for short license notices.

Base places are exact: a phrase's words standing consecutively. The method adds labels of notices
that were retyped or damaged: a notice with up to k edits is split into k + 1 seeds, of which at
least one must survive unharmed (pigeonhole); all seeds of all notices are found in one pass of an
Aho-Corasick automaton, and only around them the regex library matches the notice with at most k
errors and reports its span and edits. Edits may be anywhere but in the words that name the licence,
which must stand as they are, without a word that makes it another ("lesser", "nc"). Notices that
stand next to each other, or share a few characters, are all reported; a match goes only where a
nearer one takes up most of the same place. A match scores 1 - edits / length of its notice.

Words are maximal runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. For the fuzzy
search, a text is its words joined by single spaces.

Defined results: null counts as empty, which has no words, no labels and score 0; whole texts are
searched, of any length; repeated rows are scanned each; ids may be of any type and null; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal

# Fixed values of the contract: phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

@dataclass(frozen=True)
class Notice:
    """A short notice in normalised words, its label, how many edits it may have, the words that must
    stand in it unharmed, and words that it, or what follows it, must not hold."""

    text: str
    label: str
    edits: int
    names: tuple[str, ...] = ()
    others: frozenset[str] = frozenset()


_CC = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
#: Words that say more than a Creative Commons notice does, by what they say.
_CC_WORDS = {"nc": {"nc", "noncommercial", "non"}, "nd": {"nd", "noderivatives", "noderivs", "derivatives", "derivs"}, "sa": {"sa", "sharealike", "share"}}


def _notices() -> tuple[Notice, ...]:
    out = []
    named = {"mit": "mit", "bsd": "bsd", "isc": "isc", "apache": "apache", "mpl": "mozilla public", "lgpl": "gnu lesser general public", "agpl": "gnu affero general public", "gpl": "gnu general public"}
    for label, name in named.items():
        others = frozenset({"lesser", "library", "affero"}) if label == "gpl" else frozenset()
        for verb in ("released", "licensed", "distributed"):
            text = f"{verb} under the {name} license"
            out.append(Notice(text, label, max(3, len(text) // 10), tuple(name.split()), others))
    out.append(Notice("licensed under the apache license version 2 0", "apache", 5, ("apache",)))
    out.append(Notice("this work is licensed under the gnu general public license version 3", "gpl", 7, ("gnu", "general", "public"), frozenset({"lesser", "library", "affero"})))
    out.append(Notice("subject to the terms of the mozilla public license", "mpl", 5, ("mozilla", "public")))
    for more in ((), ("nc",), ("nd",), ("sa",), ("nc", "sa"), ("nc", "nd")):
        label = "-".join(("cc", "by", *more))
        others = frozenset().union(*(_CC_WORDS[k] for k in _CC if k not in more))
        out.append(Notice(" ".join(("licensed under cc by", *more, "4 0")), label, 2, ("cc", "by", *more), others))
        out.append(Notice(" ".join(("licensed under a creative commons attribution", *(_CC[k] for k in more))), label, 5, ("attribution", *(_CC[k] for k in more)), others))
    out.append(Notice("redistribution and use in source and binary forms", "bsd", 5))
    out.append(Notice("permission is hereby granted free of charge", "mit", 5))
    out.append(Notice("permission to use copy modify and or distribute this software", "isc", 6))
    out.append(Notice("all rights reserved", "reserved", 1))
    return tuple(out)


NOTICES = _notices()
#: So many words after a notice may make it another.
AFTER = 3

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ENDS = re.compile(rb"license|(?<![0-9a-z\x80-\xff])by(?![0-9a-z\x80-\xff])")

OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length and where each starts."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    """Automaton of all seeds and a bounded-error pattern for each notice."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        found: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            for at, seed in seeds(n.text, n.edits):
                found.setdefault(seed, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for seed, of in found.items():
            self.automaton.add_word(seed, (len(seed), of))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.edits}}}") for n in notices]
        self.whole: dict[tuple[int, int], regex.Pattern] = {}  # by notice and edits, compiled when needed

    def spans(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices in a text of words joined by spaces."""
        return [(a, b, self.notices[k].label, e) for a, b, k, e in self.found(text)]

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of the notices in a text, each around at least one seed; of two that
        share more than half of the shorter one, the nearer match."""
        near: dict[int, list[int]] = {}
        for end, (n, of) in self.automaton.iter(text):
            for k, at in of:
                near.setdefault(k, []).append(end - n + 1 - at)  # where the notice would start without edits before
        out = []
        for k, starts in near.items():
            notice = self.notices[k]
            windows: list[list[int]] = []
            for s in sorted(starts):  # windows that touch are searched as one
                a, b = max(0, s - notice.edits), min(len(text), s + len(notice.text) + notice.edits)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], b)
                else:
                    windows.append([a, b])
            for a, b in windows:
                if all(text.find(name, a, b) >= 0 for name in notice.names):
                    out += [(x, y, k, e) for x, y, e in self.matches(k, text, a, b)]
        kept: list[tuple[int, int, int, int]] = []
        for span in sorted(out, key=lambda x: (x[3] / (x[1] - x[0]), x[0] - x[1], x)):  # the fewest edits for their length first, then the longest
            if all(2 * (min(span[1], x[1]) - max(span[0], x[0])) <= min(span[1] - span[0], x[1] - x[0]) for x in kept):
                kept.append(span)
        return sorted(kept)

    def matches(self, k: int, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of a notice in a window: the best match, then those before and after it."""
        notice = self.notices[k]
        found, rest = [], [(start, end)]
        while rest:
            a, b = rest.pop()
            m = self.patterns[k].search(text, a, b) if b - a >= len(notice.text) - notice.edits else None
            if m:
                x, y, e = self.tight(k, text, m.start(), m.end(), sum(m.fuzzy_counts))
                if self.named(notice, text, x, y):
                    found.append((x, y, e))
                rest += [(a, x), (y, b)]
        return found

    def named(self, notice: Notice, text: str, a: int, b: int) -> bool:
        """Whether the words at a match name the notice's licence, and none other."""
        a, b = text.rfind(" ", 0, a + 1) + 1, text.find(" ", b - 1) if " " in text[b - 1 :] else len(text)
        words = text[a:b].split()
        if not notice.others.isdisjoint((*words, *text[b : b + 64].split()[:AFTER])):
            return False
        left = iter(words)
        return all(name in left for name in notice.names)  # in this order

    def tight(self, k: int, text: str, a: int, b: int, edits: int) -> tuple[int, int, int]:
        """A match without characters at its edges that save no edit: those belong to its neighbours."""
        if edits:
            if (k, edits) not in self.whole:
                self.whole[k, edits] = regex.compile(f"(?:{regex.escape(self.notices[k].text)}){{e<={edits}}}")
            fits = self.whole[k, edits].fullmatch
            while b - a > 1 and fits(text, a + 1, b):
                a += 1
            while b - a > 1 and fits(text, a, b - 1):
                b -= 1
        return a, b, edits


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of the exact phrases."""
    found = []
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                found.append((at, label))
    return sorted(found)


def scan_text(text: str | None, searcher: Searcher) -> tuple:
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    words = _WORD.findall(low)
    base = base_places(words) if _ENDS.search(low) else []
    flat = b" ".join(words).decode("utf-8", "replace")
    found = [(a, b, searcher.notices[k], e) for a, b, k, e in searcher.found(flat)]
    own = {label for _, label in base}
    score = max([1.0] * bool(base) + [1.0 - e / len(n.text) for _, _, n, e in found], default=0.0)
    starts = [w for w, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {n.label for _, _, n, _ in found})), score, ",".join(f"{n.label}:{a}:{b}:{e}" for a, b, n, e in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (label:start:end:edits in the joined words) for every row."""
    own = docs.schema[id_col].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(notices)
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64(), pa.string())
        names = ["_id", *OUT.replace(",", "").split()[::2]]
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            rows = [scan_text(t, searcher) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(frugal(part), f"_id {own}, {OUT}").withColumnRenamed("_id", id_col)
