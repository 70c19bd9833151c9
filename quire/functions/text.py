"""Segmentation and tokens of text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six CJK ranges, abbreviations whose stop ends no sentence, and closing marks.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "fig", "eq", "no", "inc", "ltd", "u.s", "u.k")
CLOSERS = r"""["'”’)\]}》」』】]"""
EDGE_MARKS = r"\-./:+#$@"

ALNUM = r"\p{IsAlphabetic}\p{N}"
SENTINEL = "\x01"


def _either_case(word: str) -> str:
    return "".join(rf"\{c}" if c == "." else f"[{c}{c.upper()}]" for c in word)


_BEFORE = rf"(?<![{ALNUM}._-])"
_ABBREVIATED = "|".join(map(_either_case, ABBREVIATIONS))
_MORE = rf"[.!?。！？]*{CLOSERS}*"
# (?=\.) comes before what looks back, which then is tried at stops only
BOUNDARY = (
    rf"(?U)([。！？]{_MORE}|[!?]{_MORE}(?=\s|\z)"
    rf"|(?=\.)(?<!{_BEFORE}(?:{_ABBREVIATED})(?=\.(?!\z)))(?<!{_BEFORE}[A-Za-z](?=\.\s*\p{{IsUppercase}}))\.(?!\.){_MORE}(?=\s|\z))"
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.transform(F.array(value), body)[0]


#: Stands for a sentinel that a text holds already: nothing is lost or shifted, as one character takes one's place.
_OTHER = "\x02"


def sentence_pieces(text: Column) -> Column:
    """A text in pieces that follow each other without gaps, each ending with a sentence. A text that
    holds the sentinel itself is cut by the same bounds, and its pieces keep it."""
    bare = F.replace(text, F.lit(SENTINEL), F.lit(_OTHER))
    cut = lambda t: F.split(F.regexp_replace(t, BOUNDARY, f"$1{SENTINEL}"), SENTINEL)
    lengths = lambda pieces: F.transform(pieces, lambda x: F.char_length(x))
    ends = lambda sizes: F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n))
    again = lambda sizes: let(ends(sizes), lambda e: F.transform(sizes, lambda n, i: F.substring(text, F.get(e, i) - n + 1, n)))
    return F.when(text.contains(SENTINEL), let(lengths(cut(bare)), again)).otherwise(cut(text))


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def leading(text: Column) -> Column:
    """How many white-space characters a text begins with."""
    return F.char_length(F.regexp_extract(text, r"(?U)^(\s*)", 1))


_KEPT = rf"a-z0-9{EDGE_MARKS}{ALNUM}{CJK}"
#: From the first to the last character of a run without white space that isn't an edge's.
SEGMENT = rf"(?U)[{_KEPT}](?:\S*[{_KEPT}])?"
RUN = rf"[a-z0-9_{ALNUM}]+"


def tokens(text: Column) -> Column:
    """The distinct lexical tokens of a text: whole technical segments, then their parts, and unigrams
    and bigrams of CJK runs. Texts without CJK, by far most, take two passes of a regular expression."""
    low = F.lower(text)
    segments = F.regexp_extract_all(low, F.lit(SEGMENT), F.lit(0))
    none = F.array().cast("array<string>")

    def plain(segs: Column) -> Column:
        return F.array_union(F.filter(segs, lambda s: s.rlike(rf"[a-z0-9{ALNUM}]")), F.regexp_extract_all(F.array_join(segs, " "), F.lit(RUN), F.lit(0)))

    def of_run(run: Column) -> Column:
        n = F.char_length(run)
        ones = F.filter(F.split(run, ""), lambda c: c != "")
        twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(none)
        return F.when(run.rlike(rf"^[{CJK}]"), F.concat(ones, twos)).otherwise(F.array(run))

    def of_segment(seg: Column) -> Column:
        whole = F.when(~seg.rlike(rf"[{CJK}]") & seg.rlike(rf"[{ALNUM}]"), F.array(seg)).otherwise(none)
        runs = F.regexp_extract_all(seg, F.lit(rf"([{CJK}]+|[{ALNUM}_&&[^{CJK}]]+)"), F.lit(0))
        return F.concat(whole, F.flatten(F.transform(runs, of_run)))

    mixed = F.array_distinct(F.flatten(F.transform(F.array_distinct(segments), of_segment)))
    return F.when(text.rlike(rf"[{CJK}]"), mixed).otherwise(let(segments, plain))


def fallback_class(paragraph: Column) -> Column:
    """code_block, table or prose_or_unknown of a paragraph that no native block describes."""

    def of_lines(solid: Column) -> Column:
        first, last = trim_unicode(F.get(solid, F.lit(0))), trim_unicode(F.get(solid, F.size(solid) - 1))
        fenced = (first.startswith("```") & last.startswith("```")) | (first.startswith("~~~") & last.startswith("~~~"))
        indented = F.forall(solid, lambda x: x.startswith("\t") | x.startswith("    "))
        return F.when(fenced | indented, "code_block").when(F.coalesce(table(solid), F.lit(False)), "table").otherwise("prose_or_unknown")

    def table(solid: Column) -> Column:
        second = F.get(solid, F.lit(1))
        cells = F.split(F.regexp_replace(trim_unicode(second), r"^\||\|$", ""), r"\|")
        ruled = let(cells, lambda c: (F.size(c) >= 2) & F.forall(c, lambda x: trim_unicode(x).rlike(r"^:?-{3,}:?$")))
        return F.when(F.get(solid, F.lit(0)).contains("|") & second.contains("|"), ruled).otherwise(F.lit(False))

    return let(F.filter(F.split(paragraph, "\n"), lambda x: x.rlike(r"(?U)\S")), of_lines)
