r"""Exact Jaccard self-join on word shingles by prefix filters under several global token orders.

Two sets can only reach a similarity of t if, under any one order of all tokens, their prefixes
(the first n - ceil(t n) + 1 tokens) share a token. Under the first order, tokens are dealt out and
documents that share one meet; a pair must then share a prefix token under each further order too,
and only pairs that pass all filters, and don't differ too much
within their prefixes, are verified on their whole sets. All orders put tokens that
many documents have last, and the first order puts those of rare words first, by counts over the
whole corpus (tables of fixed size of hashed counters; counters may overestimate, and any order
gives the same links).

A group of near copies is not expanded into all its pairs. Documents with equal sets are one class.
Among classes that share a token and are of like size, each is first paired with a few centres only
(ROUNDS times, with other centres); verified links are joined to components, and what is left to
compare are pairs of classes that share a token but not a component. No link between components is
lost: members of a token outside its largest component are compared with all, inside a join that lets
through only pairs that the token's places in both prefixes, sizes and bits of parity allow. Where that
would be more than DENSE pairs for each row, members of crowded tokens are dealt again by the tokens in
which they differ from a centre, of which linked ones must share one that is among the first of both
(see Corpus._differences). What that doesn't thin out is compared pair by pair too.

Words are told by 62 bits of polynomials modulo a prime, shingles by 64 bits of those, and equal sets
by 128 bits. Links are verified on other hashes, of the shingles' own bytes, and exact in integers:
100 * intersection >= threshold * union.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with
nothing (component: their own id); fewer words than a shingle's are one shingle; ids may be of any type
that can be compared; a null id belongs to its component, whose smallest id is null only if all are;
repeated rows each give a row; an empty table gives an empty result; extra columns are ignored by
`components` and kept by `keep_first`.
"""

from __future__ import annotations

import functools
import math
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import label
from .shared import cut, discard, frugal, if_small, last_only, one_of_each, salted_left_join, small_batches, text_key, without

#: Counters of the corpus-wide token counts: 2 ** SKETCH_BITS, in so many blocks.
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
#: Global token orders, and centres for each token and round.
ORDERS, CENTRES, ROUNDS = 3, 4, 2
#: Bits of the parity filter: in the last join, and for single pairs (sets of more tokens have more). Powers of two.
BITS, WIDE = 512, 2048
#: Tokens that prefixes share are found, and pairs verified, in parts one after another, each of a PART_OF-th of the
#: corpus's tokens or of PART_LEAST tokens, so that what is shuffled at once is a fraction of the input.
PART_OF, PART_LEAST = 4, 8_000_000
#: Members of a key are compared pair by pair while that makes at most DENSE pairs for each row. Where it
#: makes more, members of keys with more than LIGHT members outside their largest component are dealt
#: again by what tells them from a centre, LEVELS times at most and as long as that halves the pairs.
DENSE, LIGHT, LEVELS = 64, 16, 4
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _ODD[0]
    x = (x ^ (x >> _U(29))) * _ODD[1]
    return x ^ (x >> _U(32))


def _draws(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + _U(seed)) * _ODD[2])


#: Words are hashed in pieces of about so many bytes.
PIECE = 1 << 18
#: A prime modulus (modulo a power of two, words as short as 1024 letters can be built that collide
#: under any base) and two bases.
PRIME = (1 << 31) - 1
BASES = (1_021_834_919, 1_719_436_253)
_P, _P_BITS = _U(PRIME), _U(31)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = _draws(256, 7) % _P
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, but for a multiple of PRIME that the rest may be too large by."""
    return (x & _P) + (x >> _P_BITS)


def _rest(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, _rest(out * _U(pow(base, len(out), PRIME)))))
    return out[:n]


class Words:
    """62-bit hashes of the words of texts, all words of a piece at once: running sums of a byte's value
    times a power of each base, differences of which are the words' polynomials modulo PRIME."""

    def __init__(self):
        self._grow(2 * PIECE)

    def _grow(self, n: int) -> None:
        self.powers = [(_powers(b, n), _powers(pow(b, -1, PRIME), n)) for b in BASES]

    def piece(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words start, and their hashes."""
        a = np.frombuffer(raw, np.uint8)
        if len(a) > len(self.powers[0][0]):
            self._grow(len(a))
        gap = np.concatenate(([True], _SPACE[a], [True]))
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        first, last = edge[::2], edge[1::2]
        letters, both = _LETTER[a], []
        for power, inverse in self.powers:
            total = np.concatenate(([_U(0)], np.cumsum(_fold(letters * power[: len(a)]), dtype=np.uint64)))
            both.append(_rest(_rest(total[last] - total[first]) * inverse[first]))
        return first, mix(((both[0] << _P_BITS) | both[1]) + _ODD[3] * (last - first).astype(np.uint64))

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The hashes of each text's words."""
        out, held, size = [], [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                first, h = self.piece(b"\n".join(held))
                bounds = np.cumsum([0] + [len(x) + 1 for x in held])
                at = np.searchsorted(first, bounds)
                out.extend(h[i:j] for i, j in zip(at, at[1:], strict=False))
                held, size = [], 0

        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            if len(raw) > PIECE:
                flush()
                out.append(self._long(raw))
            else:
                held.append(raw)
                size += len(raw)
                if size >= PIECE:
                    flush()
        flush()
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        """A text of several pieces, cut at white space."""
        found, at = [], 0
        while at < len(raw):
            m = _CUT.search(raw, at + PIECE)
            end = m.start() if m else len(raw)
            found.append(self.piece(raw[at:end])[1])
            at = end
        return np.concatenate(found)


_CUT = re.compile(rb"[\x20\x09-\x0D]")


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each place's shingle."""
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i])
    return out


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of a text's words, ascending."""
    return np.unique(_rolled(h, width)) if len(h) else h


def rated(h: np.ndarray, width: int, word_levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingles() and how common each one's words are together."""
    if not len(h):
        return h, h
    s, at = np.unique(_rolled(h, width), return_index=True)
    common = np.concatenate(([0], np.cumsum(word_levels[_cells(h)], dtype=np.int64)))
    return s, (common[at + min(width, len(h))] - common[at]).astype(np.uint64)


def prefix_size(n: int, percent: int) -> int:
    """How many tokens a set of n must share one of: n - ceil(n * percent / 100) + 1."""
    return n - (n * percent + 99) // 100 + 1


def prefix(s: np.ndarray, common: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set under an order, in that order. Under every order, tokens that the corpus
    holds far more often than chance come last. Then order 0 has tokens of rare words first, and each order
    goes by a hash of its own; tokens that tie go by themselves."""
    if not len(s):
        return s
    size = prefix_size(len(s), percent)
    rank = rank_of(s, levels, order)
    if order == 0:
        rank |= common << _U(44)
    if size < len(s):
        near = rank <= np.partition(rank, size - 1)[size - 1]  # with all that tie with the last
        s, rank = s[near], rank[near]
    return s[np.lexsort((s, rank))]


def parity(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BITS bits and WIDE or more, at least one for each token, as of fewer, half are set in any large set. Each is
    the parity of how many tokens hash to it: two sets differ in at least as many tokens as these differ in
    bits. The few are the many, folded."""
    wide = max(WIDE, 1 << (len(s) - 1).bit_length())
    odd = (np.bincount((mix(s) & _U(wide - 1)).astype(np.int64), minlength=wide) & 1).astype(np.uint8)
    few = odd.reshape(-1, BITS).sum(axis=0, dtype=np.uint8) & 1
    return np.packbits(few).view(np.int64), np.packbits(odd).view(np.int64)


def rank_of(s: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens in an order, without what order 0 puts in between."""
    return (levels[_cells(s)].astype(np.uint64) << _U(56)) | (mix(s + _ODD[order]) >> _U(20))


def most_apart(n: int, m: int, percent: int) -> int:
    """In how many tokens sets of n and m may differ that reach the threshold."""
    return n + m - 2 * ((percent * (n + m) + 99 + percent) // (100 + percent))


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs; the first is its class."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) if len(s) else (0, 0)


def class_of(keys: tuple[int, int], clash: frozenset) -> int:
    """The class of a set: sets whose first 64 bits are those of another set are told by all 128."""
    return keys[0] ^ keys[1] if keys[0] in clash else keys[0]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def exact_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of the bytes of a text's shingles, which owe nothing to the words' own hashes."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    k = min(width, len(words))
    found = {xxhash.xxh3_64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)} if k else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def word_levels(total: np.ndarray) -> np.ndarray:
    """Counters of words as eighths of powers of two."""
    return np.round(8 * np.log2(1.0 + total)).clip(0, 255).astype(np.uint8)


def levels(total: np.ndarray) -> np.ndarray:
    """Counters as 8-bit levels: 0 up to about the load of chance, then powers of two of it."""
    load = 2 * max(1.0, total.mean())
    return np.clip(np.ceil(np.log2(np.maximum(total, 1) / load)), 0, 255).astype(np.uint8)


#: Rows of a batch that are worked on at once.
ROWS = 1000


def _small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few sets."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _rows(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: id, size of the set and 128 bits of it of every document; kind 1: each task's token counts."""
    cells = 1 << SKETCH_BITS
    per = cells // SKETCH_BLOCKS
    names = ["kind", "id", "tkey", "n", "class", "more", "block", "counts"]
    schema = f"kind int, id {docs.schema['id'].dataType.simpleString()}, tkey long, n long, class long, more long, block int, counts binary"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, id_type = Words(), np.zeros((2, cells), np.int64), None
        for b in _small(batches):
            id_type, m = b.schema.field(0).type, b.num_rows
            each = words.of(b.column(2).to_pylist())
            sets = [shingles(h, width) for h in each]
            if sets:
                total[0] += np.bincount(_cells(np.concatenate(sets)), minlength=cells)
                total[1] += np.bincount(_cells(np.concatenate(each)), minlength=cells)
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if total.any():
            flat, m = total.ravel(), 2 * SKETCH_BLOCKS
            packed = [zlib.compress(flat[k * per : (k + 1) * per].astype("<i8").tobytes(), 1) for k in range(m)]
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, id_type), *[pa.nulls(m, pa.int64())] * 4, pa.array(range(m), pa.int32()), pa.array(packed, pa.binary())], names)

    return docs.mapInArrow(frugal(part), schema)


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c.as_py()), "<i8") for c in table["counts"])
    return pa.table({"block": table["block"][:1], "salt": table["salt"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def corpus_counts(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks, of shingles and of words, added up in two levels; the driver gets
    tables of fixed size."""
    some = rows.where("kind = 1").select("block", "counts").withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(32)).cast("int"))
    for salt in (F.col("salt"), F.lit(0)):
        some = some.withColumn("salt", salt).groupBy("block", "salt").applyInArrow(_add, "block int, salt int, counts binary")
    per = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    total = np.zeros(2 << SKETCH_BITS, np.int64)
    for block, counts in some.select("block", "counts").collect():
        total[block * per : (block + 1) * per] = np.frombuffer(zlib.decompress(counts), "<i8")
    return total.reshape(2, -1)


def _prefixes(docs: DataFrame, width: int, percent: int, held) -> DataFrame:
    """class, size, parity bits and prefix under the first order of the sets that aren't empty."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (high, rare, clash), many = Words(), held.value, pa.list_(pa.int64())
        for b in _small(batches):
            both = [rated(h, width, rare) for h in words.of(b.column(2).to_pylist()) if len(h)]
            odd = [parity(s) for s, _ in both]
            first = pa.array([prefix(s, c, high, 0, percent).view(np.int64) for s, c in both], many)
            yield pa.RecordBatch.from_arrays([pa.array([class_of(set_keys(s), clash) for s, _ in both], pa.int64()), pa.array([len(s) for s, _ in both], pa.int32()), *[pa.array([p[k] for p in odd], many) for k in (0, 1)], first], ["class", "n", "bits", "wide", "p0"])

    return docs.mapInArrow(frugal(part), "class long, n int, bits array<long>, wide array<long>, p0 array<long>")


def _further(docs: DataFrame, width: int, percent: int, held) -> DataFrame:
    """class, size, and prefix under each further order."""
    orders = range(1, ORDERS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (high, _, clash), many = Words(), held.value, pa.list_(pa.int64())
        for b in _small(batches):
            sets = [shingles(h, width) for h in words.of(b.column(2).to_pylist()) if len(h)]
            cols = [pa.array([prefix(s, s, high, k, percent).view(np.int64) for s in sets], many) for k in orders]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(set_keys(s), clash) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), *cols], ["class", "n", *[f"p{k}" for k in orders]])

    return docs.mapInArrow(frugal(part), "class long, n int, " + ", ".join(f"p{k} array<long>" for k in orders))


def _sets(docs: DataFrame, width: int, held, exact: bool) -> DataFrame:
    """class and its set: of shingles' hashes as everywhere here, or exact_set()."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, clash = Words(), held.value[2]
        for b in _small(batches):
            texts = b.column(2).to_pylist()
            both = [(shingles(h, width), t) for h, t in zip(words.of(texts), texts, strict=True) if len(h)]
            sets = [exact_set(t, width) if exact else s for s, t in both]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(set_keys(s), clash) for s, _ in both], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "tokens"])

    return docs.mapInArrow(frugal(part), "class long, tokens array<long>")


def _with_both(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both classes, as x_ and y_."""
    left = of.select(F.col("class").alias("_a"), *[F.col(c).alias(f"x_{c}") for c in columns])
    right = of.select(F.col("class").alias("_b"), *[F.col(c).alias(f"y_{c}") for c in columns])
    return pairs.join(left, pairs["a"] == F.col("_a")).join(right, F.col("b") == F.col("_b")).drop("_a", "_b")


def _unsigned(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).view(np.uint64)


class Corpus:
    """What pairs are tested against: documents that stand for their class, and each class's size and parity
    bits (marks). Prefixes under further orders, and sets, are made again from the texts of what is left."""

    def __init__(self, docs: DataFrame, reps: DataFrame, marks: DataFrame, width: int, percent: int, once, held):
        self.held = held
        self.many, tokens = marks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()  # what a join with them reads counts towards its tasks
        self.part = max(PART_LEAST, tokens // PART_OF)
        self.docs, self.reps, self.marks, self.width, self.percent, self.once = docs, reps, marks, width, percent, once

    def near(self, pairs: DataFrame) -> DataFrame:
        """pairs that pass the parity filter, and how many tokens both have together (size)."""
        named = cut(self._classes(pairs), "named", 2 * pairs.count())
        marks = self.marks.select("class", "n", "wide").join(if_small(named, 1_000_000), "class", "left_semi")
        near = _with_both(pairs, marks, ["n", "wide"]).where(_close_wide(self.percent, "x_n", "y_n", "x_wide", "y_wide"))
        return cut(near.select("a", "b", (F.col("x_n") + F.col("y_n")).cast("long").alias("size")), "near", pairs.count() + self.many)

    def filtered(self, near: DataFrame) -> DataFrame:
        """Of near pairs, a written table, those that share a prefix token under every further order, and differ
        little enough where both prefixes reach: up to the lesser of their last places, all tokens of
        both sets are known."""
        percent, held, orders = self.percent, self.held, range(1, ORDERS)

        def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = held.value[0]
            for b in batches:
                keep = []
                for i in range(len(b)):
                    most, ok = most_apart(b.column(2)[i].as_py(), b.column(2 + ORDERS)[i].as_py(), percent), True
                    for k in orders:
                        x, y = (rank_of(_unsigned(b.column(c), i), levels, k) for c in (2 + k, 2 + ORDERS + k))
                        both = np.intersect1d(x, y)
                        reach = min(x.max(), y.max())
                        apart = (x <= reach).sum() + (y <= reach).sum() - 2 * (both <= reach).sum()
                        ok = ok and len(both) > 0 and apart <= most
                    keep.append(bool(ok))
                yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

        names = ["n", *[f"p{k}" for k in orders]]
        some = cut(self.once(_further(self.texts_of(near), self.width, percent, held)), "further")
        return _with_both(near, some, names).select("a", "b", *[f"{p}_{c}" for p in "xy" for c in names]).mapInArrow(frugal(further), "a long, b long")

    @staticmethod
    def _classes(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        """A document of each class that pairs, a written table, name."""
        wanted = cut(self.reps.join(self._classes(pairs), "class", "left_semi"), "wanted", 2 * pairs.count() + self.many)
        return of_rows(self.docs, wanted)

    def sets(self, pairs: DataFrame, exact: bool) -> DataFrame:
        """The sets of the classes that pairs, a written table, name, read again from their texts."""
        return cut(self.once(_sets(self.texts_of(pairs), self.width, self.held, exact)), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets reach the threshold."""
        return last_only(pairs.sparkSession, lambda: self._links(pairs))

    def _links(self, pairs: DataFrame) -> DataFrame:
        """Joins with prefixes and sets repeat those of a class for each of its pairs: pairs go in parts of so many
        tokens."""
        near = self.near(pairs)
        parts = -(-near.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // self.part)
        if parts <= 1:
            return self._verified(near.select("a", "b"))
        at = lambda i: near.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i).select("a", "b")
        found = [last_only(pairs.sparkSession, functools.partial(self._verified, at(i))) for i in range(parts)]
        return cut(functools.reduce(DataFrame.union, found), "links", near.count())

    def _verified(self, near: DataFrame) -> DataFrame:
        passed = cut(self.filtered(near), "passed", near.count() + self.many)  # both are counts of written tables
        sets, percent = self.sets(passed, exact=True), self.percent

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for i in range(len(b)):
                    x, y = (_unsigned(b.column(k), i) for k in (2, 3))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

        return cut(_with_both(passed, sets, ["tokens"]).mapInArrow(frugal(verify), "a long, b long"), "links")

    def others(self, met: DataFrame, labels: DataFrame) -> DataFrame:
        """All pairs (a < b) of classes in different components that may be linked, from the keys they share."""
        return last_only(met.sparkSession, lambda: self._others(met, labels))

    def _others(self, met: DataFrame, labels: DataFrame) -> DataFrame:
        most, found = DENSE * met.count(), []
        at = _mixed(met.withColumn("side", F.lit(0)), labels)
        for level in range(LEVELS):
            light = F.col("others") <= LIGHT
            pairs = at.where(~light).agg(F.coalesce(F.sum("others"), F.lit(0))).first()[0]
            if pairs <= most:
                break
            to = self._to_centres(at.where(~light).select("token", "class"))
            after = _mixed(self._differences(to), labels)
            if 2 * after.agg(F.coalesce(F.sum("others"), F.lit(0))).first()[0] > pairs:
                break
            found += [cut(self._in_keys(at.where(light)), "in-keys"), to.select("a", "b")]
            at = after
        found.append(cut(self._in_keys(at), "in-keys"))
        return cut(functools.reduce(DataFrame.union, found).distinct(), "others")

    def _in_keys(self, at: DataFrame) -> DataFrame:
        """Pairs of a key's members in different components, one of which isn't the key's largest; members
        of keys with very many rows are dealt over several tasks."""
        at = at.join(self.marks.select("class", "bits"), "class")
        salts = F.ceil(F.col("all") / 50_000).cast("int")
        big = at.withColumn("salt", F.pmod(F.xxhash64("class"), salts).cast("int"))
        few = at.where("label <> main").select(F.explode(F.sequence(F.lit(0), salts - 1)).alias("_s"), *[F.col(c).alias(f"_{c}") for c in ("token", "class", "n", "pos", "label", "bits", "side")])
        same = (F.col("token") == F.col("_token")) & (F.col("salt") == F.col("_s")) & (F.col("label") != F.col("_label")) & ((F.col("label") == F.col("main")) | (F.col("class") < F.col("_class")))
        of_use = ((F.col("side") == 0) | (F.col("side") != F.col("_side"))) & _near(self.percent, "n", "_n") & _early(self.percent, "n", "_n", "pos", "_pos") & _close(self.percent, BITS, "n", "_n", "bits", "_bits")
        return big.join(few, same & of_use).select(F.least("class", "_class").alias("a"), F.greatest("class", "_class").alias("b")).distinct()

    def _to_centres(self, heavy: DataFrame) -> DataFrame:
        """class, centre, and both as a pair (a, b): one member of each key is its centre, by a hash, so
        that keys with much the same members have the same one."""
        centre = heavy.groupBy("token").agg(F.min_by("class", F.xxhash64("class", F.lit("centre"))).alias("centre"))
        to = heavy.join(centre, "token").where("class <> centre").select("class", "centre").distinct()
        return cut(to.withColumn("a", F.least("class", "centre")).withColumn("b", F.greatest("class", "centre")), "to-centres")

    def _differences(self, to: DataFrame) -> DataFrame:
        """(token, class, n, pos, side): the members of keys dealt again by how they differ from a centre; pos
        is 1, as keys' places say nothing here.

        For sets x, y and their centre c, x and y differ in |X| + |Y| - 2 |X and Y| tokens, X and Y being
        their differences from c. If they differ in at most k, X and Y share o = (|X| + |Y| - k) / 2 tokens
        or more. Where o <= 0, both are linked to c by the triangle inequality, and so already joined
        through c. Else the first |X| - o + 1 tokens of X and |Y| - o + 1 of Y, under any one order, share
        one. The order of a centre has what a member adds first, which few others do. Of two members in
        different components, at most one is linked to c. Keys of side 0 are for pairs of which neither
        is, those of sides 1 (is) and 2 (isn't) for the rest: each bounds the other's difference, and so o."""
        held, percent = self.held, self.percent
        sets = self.sets(to, exact=False)
        own = to.join(sets, "class").withColumnRenamed("tokens", "x")
        both = salted_left_join(own, sets.select(F.col("class").alias("centre"), F.col("tokens").alias("y")), ["centre"], F.col("class"))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            high = held.value[0]
            for b in _small(batches, 200):
                out = [differing(_unsigned(b.column(2), i), _unsigned(b.column(3), i), b.column(1)[i].as_py(), high, percent) for i in range(len(b))]
                keys, sides = (np.concatenate([o[k] for o in out]) for k in (0, 1))
                times = [len(o[0]) for o in out]
                classes, sizes = np.repeat(b.column(0).to_numpy(), times), np.repeat([len(b.column(2)[i]) for i in range(len(b))], times)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sides, pa.int32())], ["token", "class", "n", "side"])

        dealt = cut(both.select("class", "centre", "x", "y").mapInArrow(frugal(part), "token long, class long, n int, side int"), "differences")
        return _once_each(_of_several(dealt.withColumn("pos", F.lit(1))))


def differing(x: np.ndarray, c: np.ndarray, centre: int, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sides of a set: the first tokens of its difference from a centre (see _differences)."""
    parts = []
    for s, of in ((x, c), (c, x)):
        s = s[np.isin(s, of, assume_unique=True, invert=True)]
        parts.append(s[np.lexsort((s, rank_of(s, levels, 0)))])
    both = np.concatenate(parts)
    n, m, d = len(x), len(c), len(both)
    most = n * (100 - percent) // percent  # in how many tokens x and what is linked to it differ at most
    linked = (100 - percent) * (n + m) >= (100 + percent) * d
    short = min(d, most + 1, max(0, ((100 + percent) * d + (100 - percent) * (n - m)) // (2 * (100 + percent)) + 1))
    long = min(d, (d - 1 + most) // 2 + 1)
    if linked:
        taken = [(short, 1)]
    elif (100 + percent) * (d - most) > (100 - percent) * (100 * n // percent + 1 + m):  # too far for what is linked to c
        taken = [(short, 0)]
    else:
        taken = [(short, 0), (long, 2)]
    salt = [mix(np.array([centre], np.int64).view(np.uint64) + _ODD[min(side, 1)]) for _, side in taken]
    keys = [mix(both[:k] ^ q) for (k, _), q in zip(taken, salt, strict=True)]
    return np.concatenate(keys), np.concatenate([np.full(len(q), side, np.int32) for q, (_, side) in zip(keys, taken, strict=True)])


def of_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs (id, tkey, text) that rows (rid, rkey, ...) names."""
    r = rows.select("rid", "rkey")
    return docs.join(if_small(r, 1_000_000), docs["id"].eqNullSafe(F.col("rid")) & (docs["tkey"] == F.col("rkey")), "left_semi")


def classes_and_links(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, labels). rows: id, tkey, n, class. labels: class and the label of its component, for
    classes with links."""
    with small_batches(docs.sparkSession):
        return _classes_and_links(docs, width, percent, id_col, text_col)


def _classes_and_links(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("id"), text_key(text).alias("tkey"), text.alias("text"))
    both = cut(_rows(d, width), "shingle-rows")
    of_shingles, of_words = corpus_counts(both)
    rows = cut(both.where("kind = 0").select("id", "tkey", "n", "class", "more"), "rows")
    discard(both)  # tasks' counts are most of it

    def representatives(rows: DataFrame) -> DataFrame:
        first = rows.where("n > 0").groupBy("class").agg(F.min(F.struct("id", "tkey")).alias("r"), F.min("more").alias("lo"), F.max("more").alias("hi"))
        return cut(first.select("class", F.col("r.id").alias("rid"), F.col("r.tkey").alias("rkey"), (F.col("lo") != F.col("hi")).alias("clash")), "representatives")

    reps = representatives(rows)
    clash = frozenset(r[0] for r in reps.where("clash").select("class").collect())  # one in ten at 10 ** 10 classes
    if clash:
        rows = rows.withColumn("class", F.when(F.col("class").isin(*clash), F.col("class").bitwiseXOR(F.col("more"))).otherwise(F.col("class")))
        reps = representatives(rows)
    held = spark.sparkContext.broadcast((levels(of_shingles), word_levels(of_words), clash))  # 2 ** SKETCH_BITS bytes each
    repeated = rows.groupBy("id", "tkey").count().where("count > 1").limit(1).count() > 0  # rows equal in id and text
    once = (lambda x: x.dropDuplicates(["class"])) if repeated else (lambda x: x)
    prefixes = cut(once(_prefixes(of_rows(d, reps), width, percent, held)), "prefixes")
    held_by = _shared_tokens(prefixes)
    marks = cut(prefixes.select("class", "n", "bits", "wide"), "marks")
    discard(prefixes)
    met = _met(held_by, percent)
    discard(held_by)
    corpus = Corpus(d, reps, marks, width, percent, once, held)
    links, labels, tested = None, None, None
    for k in range(ROUNDS):
        pairs = cut(_star_pairs(met, _centres(met, k), labels, percent), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = corpus.links(pairs)
        links = found if links is None else links.union(found)
        labels = label(links)
    rest = cut(corpus.others(met, labels).join(tested, ["a", "b"], "left_anti"), "rest")
    return rows.drop("more"), label(links.union(corpus.links(rest)))


def _shared_tokens(prefixes: DataFrame) -> DataFrame:
    """(token, class, n, pos) of prefixes' tokens that several classes have: a class has each once. Tokens are dealt
    to a few parts by a hash; only one part's rows are in shuffle files at a time."""
    met = prefixes.select("class", "n", F.posexplode("p0").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    rows = prefixes.agg(F.coalesce(F.sum(F.size("p0")), F.lit(0))).first()[0]
    parts, found = max(1, min(PART_OF, -(-rows // PART_LEAST))), []
    for i in range(parts):
        some = met.where(F.pmod(F.xxhash64("token"), F.lit(parts)) == i) if parts > 1 else met
        shared = cut(some.groupBy("token").count().where("count > 1").select("token"), "shared")
        found.append(cut(some.join(shared, "token"), "shared-tokens"))
        discard(shared)
    return functools.reduce(DataFrame.union, found)


def _met(shared: DataFrame, percent: int) -> DataFrame:
    """(token, class, n, pos) of keys that tell which classes may be linked, from the rows of tokens that
    several have. Tokens of the same members go before keys are dealt by size, which doubles them: the first
    token that two classes share is the first of all with its members, and stays."""
    return last_only(shared.sparkSession, lambda: _once_each(_of_several(cut(_by_size(_once_each(shared), percent), "by-size"))))


def _by_size(met: DataFrame, percent: int) -> DataFrame:
    """met with keys of a token and a range of sizes: sets whose sizes are within the threshold of each
    other share one of the two ranges that each is dealt to."""
    at = F.floor(F.log(F.col("n")) / (1.001 * math.log(100 / min(percent, 99)))).cast("int")
    return met.select(F.explode(F.array(at, at + 1)).alias("_r"), "token", "class", "n", "pos").select(F.xxhash64("token", "_r").alias("token"), "class", "n", "pos")


def _of_several(met: DataFrame) -> DataFrame:
    """The rows of keys that several classes share."""
    several = met.groupBy("token").count().where("count > 1").select("token")
    return cut(met.join(several, "token", "left_semi"), "several")


def _once_each(met: DataFrame) -> DataFrame:
    """met with one key of all that the same members have: others would only repeat their pairs. That is
    the first of them under order 0, as it is in all members. Equal members are told by their number and
    128 bits of exclusive or."""
    own = [c for c in met.columns if c not in ("token", "pos")]
    members = met.groupBy("token").agg(F.count("*").alias("many"), F.min("pos").alias("pos"), *[F.bit_xor(F.xxhash64(*own, F.lit(f"member {i}"))).alias(f"m{i}") for i in (1, 2)])
    chosen = cut(members.groupBy("many", "m1", "m2").agg(F.min(F.struct("pos", "token")).alias("k")).select("k.token"), "chosen")
    return cut(met.join(if_small(chosen, 1_000_000), "token", "left_semi"), "met")


def _centres(met: DataFrame, k: int) -> DataFrame:
    """For each key that several classes have, a few of them: the ends of their order by size and by hashes."""
    by, own = lambda i: F.xxhash64("class", F.lit(i)), F.struct("class", "n", "pos")
    first = [F.min_by(own, F.struct("n", "class")), F.max_by(own, F.struct("n", "class"))] if k == 0 else []
    picks = first + [F.min_by(own, by(CENTRES * k + i)) for i in range(CENTRES - len(first))]
    return met.groupBy("token").agg(F.count("*").alias("many"), F.array_distinct(F.array(*picks)).alias("centres")).where("many > 1")


def _near(percent: int, n: str, m: str):
    """The size filter: neither set has less than its share of the other."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _with_label(d: DataFrame, labels: DataFrame | None, column: str, out: str) -> DataFrame:
    if labels is None:
        return d.withColumn(out, F.col(column))
    l = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return d.join(if_small(l, 1_000_000), F.col(column) == F.col("_n"), "left").withColumn(out, F.coalesce("_l", column)).drop("_n", "_l")


def _star_pairs(met: DataFrame, tokens: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a < b) of a class and a centre of one of its keys, not yet in one component."""
    at = met.join(tokens, "token").select("class", "n", "pos", F.explode("centres").alias("c"))
    at = at.select("class", "n", "pos", F.col("c.class").alias("centre"), F.col("c.n").alias("m"), F.col("c.pos").alias("at"))
    at = at.where((F.col("class") != F.col("centre")) & _near(percent, "n", "m") & _early(percent, "n", "m", "pos", "at")).select("class", "centre").distinct()
    at = _with_label(_with_label(at, labels, "class", "la"), labels, "centre", "lb").where("la <> lb" if labels is not None else "true")
    return at.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()


def _shared(percent: int, n: str, m: str):
    """How many tokens sets of n and m must share."""
    return F.floor(((F.col(n) + F.col(m)) * percent + (99 + percent)) / (100 + percent))


def _early(percent: int, n: str, m: str, i: str, j: str):
    """The filter on places: if the token at places i and j is the first that two sets share, they share at
    most what follows it in both. Linked sets pass it at the first token that they share."""
    return F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) + 1 >= _shared(percent, n, m)


def _close(percent: int, bits: int, n: str, m: str, x: str, y: str):
    """The parity filter: with n + m tokens, sets that reach the threshold differ in so many at most."""
    apart = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(bits // 64)]
    return functools.reduce(operator.add, apart) <= F.col(n) + F.col(m) - 2 * _shared(percent, n, m)


def _close_wide(percent: int, n: str, m: str, x: str, y: str):
    """_close() for WIDE bits or more: where one has more than the other, they are folded to as many."""
    few, none = F.least(F.size(x), F.size(y)), F.lit(0).cast("long")
    folded = lambda bits, i: F.aggregate(F.sequence(i, F.size(bits) - 1, few), none, lambda a, j: a.bitwiseXOR(F.get(bits, j)))
    apart = F.aggregate(F.sequence(F.lit(0), few - 1), F.lit(0), lambda a, i: a + F.bit_count(folded(F.col(x), i).bitwiseXOR(folded(F.col(y), i))))
    as_usual = F.greatest(F.size(x), F.size(y)) == WIDE // 64
    return F.when(as_usual, _close(percent, WIDE, n, m, x, y)).otherwise(apart <= F.col(n) + F.col(m) - 2 * _shared(percent, n, m))


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of keys whose members are in several components, with their labels, the label that most
    of a key's rows have (main), and how many rows the key has (all) and have other labels (others).
    Keys with sides but 0 are of use only if members of both sides have them."""
    at = cut(_with_label(met, labels, "class", "label"), "labelled")
    by = at.groupBy("token", "label").agg(F.count("*").alias("many"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    top = by.groupBy("token").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.sum("many").alias("all"), F.max("many").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    top = top.where("all > most and (hi = 0 or lo < hi)").select("token", "main", "all", (F.col("all") - F.col("most")).alias("others"))
    return cut(at.join(top, "token"), "mixed")


def components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, tkey (of the text), n_shingles, component_id and component (a hash; null without
    shingles) for every row of docs."""
    rows, labels = classes_and_links(docs, width, percent, id_col, text_col)
    # classes of several rows or with links; what is in neither is its own component
    c = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("first_id"), F.count("*").alias("many"))
    c = _with_label(cut(c, "classes"), labels, "class", "label")
    joined = c.join(labels.select("node"), c["class"] == F.col("node"), "left").where("many > 1 or node is not null").select("class", "label", "first_id")
    joined = cut(joined, "joined")
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = cut(salted_left_join(joined, least, ["label"], F.col("class")).select("class", "label", "component_id", F.lit(True).alias("known")), "component-of")
    out = salted_left_join(rows, of, ["class"], F.coalesce(F.xxhash64("id"), F.lit(0)))
    known = (F.col("n") > 0) & F.col("known")
    mine, component = F.when(known, F.col("component_id")).otherwise(F.col("id")), F.when(F.col("n") > 0, F.coalesce("label", "class"))
    return out.select(F.col("id").alias(id_col), "tkey", F.col("n").alias("n_shingles"), mine.alias("component_id"), component.alias("component"))


def report(docs: DataFrame, width: int = 3, percent: int = 90, **how) -> DataFrame:
    return components(docs, width, percent, **how).drop("tkey", "component")


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest id (null sorting last; of equal
    ids that of the smallest hash of its text; of rows equal in both one); columns unchanged."""
    c = cut(components(docs, width, percent, id_col, text_col), "components")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("tkey").alias("tkey"))
    first = c.where("component is not null").groupBy("component").agg(F.count("*").alias("many"), F.min(rank).alias("first")).where("many > 1")
    first = cut(first.select("component", "first"), "first-of")
    c = salted_left_join(c, first, ["component"], F.col("tkey"))
    named = lambda d: d.select(id_col, F.col("tkey").alias("_key"))
    losers = cut(named(c.where(F.col("first").isNotNull() & (rank != F.col("first")))).distinct(), "near-copies")
    again = cut(named(c.where(F.col("first").isNotNull() & rank.eqNullSafe(F.col("first")))).groupBy(id_col, "_key").count().where("count > 1").drop("count"), "repeated")
    key = text_key(F.col(text_col))
    return one_of_each(without(docs, losers, id_col, key), again, id_col, key)
