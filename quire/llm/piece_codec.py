"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (no generated classes). Its pieces, scores and flags rebuild
a tokenizer: normaliser (precompiled character map, marker for spaces, dummy prefix), unigram
scores or, for a BPE model, merges ranked by the scores of the pieces they make, and byte fallback
for characters without a piece. Batches are encoded without the library's own threads.

Where no piece holds the space marker after another character, texts are cut before markers, which
no merge can cross; each word then is encoded once and remembered.

Parity with the model's own processor is verified over whole texts: by `parity`, and by the query for
every row.

Defined results: null gives no ids and decodes to the empty text; the empty text likewise; texts are
encoded whole at any length; symbols that look like control pieces are ordinary text; repeated
rows are encoded each; ids may be of any type and null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .shared import frugal, release

MARK = "▁"

# Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fewer_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of a message's fields: varints, 32-bit floats, 64-bit words and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield number, struct.unpack("<d" if wire == 1 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {wire} in the model")


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.fewer_spaces, m.escape_spaces = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """All ways to make a piece of two, those of better pieces first; the model joins in this order."""
    rank = {p: -s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
    pairs = []
    for at, (p, _, kind) in enumerate(m.pieces):
        if kind == NORMAL:
            pairs += [(rank[p], at, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [(a, b) for *_, a, b in sorted(pairs)]


def crossed(m: Model) -> bool:
    """Whether a piece holds the space marker after another character, so that words can't be told apart."""
    return any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER))


def normaliser(m: Model, first: bool = True, last: bool = True) -> normalizers.Normalizer:
    """What the model does to a text, or to a part of it that is its first or last."""
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.fewer_spaces:  # spaces only: other white space is text, unless the map makes it spaces
        edges = "|".join([r"\A +"] * first + [r" +\z"] * last)
        steps += [normalizers.Replace(Regex(" {2,}"), " ")] + [normalizers.Replace(Regex(edges), "")] * bool(edges)
    if m.escape_spaces:
        steps += [normalizers.Prepend(MARK)] * (m.dummy_prefix and first) + [normalizers.Replace(" ", MARK)]
        steps += [normalizers.Replace(Regex(rf"{MARK}+\z"), "")] * (m.fewer_spaces and last)  # markers that the text itself ends with go too
    return normalizers.Sequence(steps)


def build(m: Model, bare: bool = False) -> Tokenizer:
    """The model's tokenizer; a bare one takes words as they are. User pieces are cut out by the codec."""
    unknown = next(i for i, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN)
    if m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback))
    elif m.kind == BPE:
        t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        raise ValueError("only unigram and BPE models are known")
    if bare:
        return t
    t.normalizer = normaliser(m)
    if not crossed(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * m.dummy_prefix)
    return t


#: Words whose ids are remembered take about so many bytes, in two halves, and are at most so long. With 20 MB,
#: 44 % of the words that were encoded in 8,000 long texts had been encoded before.
CACHED_BYTES, CACHED_CHARS = 256 << 20, 48
#: What Python keeps for a word besides its characters and ids.
ENTRY_BYTES = 200
#: So many words go to the library at once, and so many as one text where they can be told apart again.
AT_ONCE, TOGETHER = 10_000, 500
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _packed(ids: list[int]) -> bytes:
    """ids as little-endian 32-bit words."""
    words = array("i", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Codec:
    """Encodes and decodes batches of texts.

    Where merges can't cross a marker, a batch is cut into words; the library encodes those that
    aren't remembered, all at once. Else it encodes the texts. `checked` compares the ids of every
    whole text with those of the model's own processor."""

    def __init__(self, data: bytes, checked: bool = False):
        self.model = m = parse_model(data)
        self.user = {p: k for k, (p, _, kind) in enumerate(m.pieces) if kind == USER and p}
        self.user_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        self.by_word = not crossed(m) and not self.user
        self.plain = m.dummy_prefix and m.escape_spaces and not m.charsmap and not m.fewer_spaces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.own = None
        if checked:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.parts = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        return build(self.model)

    @functools.cached_property
    def bare(self) -> Tokenizer:
        return build(self.model, bare=True)

    @functools.cached_property
    def joined(self) -> Tokenizer:
        """Takes words, each after its marker, in one text."""
        t = build(self.model, bare=True)
        t.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        return t

    @functools.cached_property
    def opens(self) -> np.ndarray:
        return np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(raw, "<i4").tolist() for raw in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit words."""
        if self.user:
            return [self._with_user_pieces(t) for t in texts]
        if not self.by_word:
            return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.held > CACHED_BYTES // 2:  # words that come again are kept, rarer ones go
            self.known, self.older, self.held = {}, self.known, 0
        cut = [self._words(t) for t in texts]
        words = list(chain.from_iterable(cut))
        raws = list(map(self.known.get, words))
        missing = {w for w, raw in zip(words, raws, strict=True) if raw is None}
        if missing:
            found = {w: self.older[w] for w in missing & self.older.keys()} if self.older else {}
            fresh = list(missing.difference(found))
            for k in range(0, len(fresh), AT_ONCE):
                some = fresh[k : k + AT_ONCE]
                found.update(zip(some, self._of_words(some), strict=True))
            raws = [found[w] if raw is None else raw for w, raw in zip(words, raws, strict=True)]
            for w in [w for w in fresh if len(w) > CACHED_CHARS]:
                del found[w]
            self.known.update(found)
            self.held += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        each = iter(raws)
        return [b"".join(itertools.islice(each, len(c))) for c in cut]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Each word's ids. Words of a plain model go to the library as texts of many, and their ids are cut
        before pieces that open with a marker, which only a word's first does. Where that doesn't give as
        many parts as words, as without a piece for the marker, each goes on its own."""
        if not self.plain:
            return self._singly(words)
        bare = [w for w in words if MARK not in w]
        parts = [bare[k : k + TOGETHER] for k in range(0, len(bare), TOGETHER)]
        out: list[bytes] = []
        for e, part in zip(self.joined.encode_batch_fast([MARK + MARK.join(p) for p in parts], add_special_tokens=False), parts, strict=True):
            ids = np.array(e.ids, "<i4")
            at = (4 * np.append(np.flatnonzero(self.opens[ids]), len(ids))).tolist()
            if len(at) == len(part) + 1 and at[0] == 0:
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in itertools.pairwise(at)]
            else:
                out += self._singly([MARK + w for w in part])
        if len(bare) == len(words):
            return out
        rest = [w for w in words if MARK in w]
        found = dict(zip(bare, out, strict=True))
        found.update(zip(rest, self._singly([w if w.startswith(MARK) else MARK + w for w in rest]), strict=True))
        return [found[w] for w in words]

    def _singly(self, words: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.bare.encode_batch_fast(words, add_special_tokens=False)]

    def _words(self, text: str) -> list[str]:
        """A text's words. Of a plain model every word begins with a marker, which is left out here where a
        word begins with just one; a text with single spaces inside then needs no pattern."""
        if not self.plain:
            return _WORDS.findall(normaliser(self.model).normalize_str(text))
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        words = _WORDS.findall(MARK + text.replace(" ", MARK))
        return [w[1:] if len(w) > 1 and w[1] != MARK else w for w in words]

    def _with_user_pieces(self, text: str) -> bytes:
        """A text's ids where user pieces stand in it as they are; what lies between them is normalised as
        parts of one text."""
        if not text:
            return b""
        parts, ids = self.user_pattern.split(text), []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.user[part])
            else:
                plain = normaliser(self.model, k == 0, k == len(parts) - 1).normalize_str(part)
                if not plain and not k and len(parts) > 1 and self.model.dummy_prefix and self.model.escape_spaces:
                    plain = MARK  # the marker stands before a user piece too
                ids += self.bare.encode(plain, add_special_tokens=False).ids
        return _packed(ids)

    def agrees(self, texts: list[str], raw: list[bytes]) -> list[bool]:
        """Whether the model's own processor gives each whole text these ids."""
        if hasattr(self.own, "encode_as_numpy"):  # without a list of Python's integers
            return [self.own.encode_as_numpy(t).astype("<i4", copy=False).tobytes() == b for t, b in zip(texts, raw, strict=True)]
        return [_packed(a) == b for a, b in zip(self.own.encode(texts, num_threads=1), raw, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The pieces' bytes one after another, as the tokenizer's decoder has it but several times faster."""
        drop = 1 if self.model.dummy_prefix else 0
        out = []
        for i in ids:
            text = b"".join(map(self.parts.__getitem__, i)).decode("utf-8", "replace")
            out.append(text[drop:] if text.startswith(" ") else text)
        return out


def parity(data: bytes, texts: list[str]) -> list[bool]:
    """Whether each text has the ids that the model's own processor gives it."""
    codec = Codec(data, checked=True)
    return codec.agrees(texts, codec.encode_raw(texts))


_held: dict[tuple[bytes, bool], Codec] = {}
_stage: int | None = None


def codec_of(data: bytes, checked: bool) -> Codec:
    """The codec of a model, built once in each worker: workers are reused, and some 11 MB of every
    further one that is built were seen not to come back. It starts without remembered words, but for those of
    the same stage's earlier tasks where these were kept. The library
    encodes in the worker's own thread: handing over to others only costs time where each core has a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (hashlib.sha256(data).digest(), checked)
    if key not in _held:
        _held.clear()
        _held[key] = Codec(data, checked)
    global _stage
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage is None or stage != _stage:
        _held[key].forget()
    _stage = stage
    return _held[key]


OUT = "n_tokens long, ids_crc32 long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"
BATCH_CHARS, BATCH_ROWS = 1 << 19, 250
#: Freed memory is given back after so many slices.
RELEASE_EVERY = 32


def _slices(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts that have about `limit` characters together."""
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t)
        if n >= limit:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """ids and texts of a few rows at a time."""
    done = 0
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            some = batch.slice(k, BATCH_ROWS)
            texts = [t or "" for t in some.column(1).to_pylist()]
            for a, b in _slices(texts):
                yield some.column(0).slice(a, b - a), texts[a:b]
                if (done := done + 1) % RELEASE_EVERY == 0:
                    release()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int) and decoded text of every row of docs."""
    data = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())  # one model, of fixed size
    own = docs.schema[id_col].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, checked=False)
        for at, texts in _runs(batches):
            ids = codec.encode(texts)
            yield pa.RecordBatch.from_arrays([at, pa.array(ids, pa.list_(pa.int32())), pa.array(codec.decode(ids), pa.string())], ["_id", "ids", "decoded"])
        codec.forget()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(frugal(part), f"_id {own}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = False) -> DataFrame:
    """For every row the number of its ids, their digests (as little-endian 32-bit words), the digest
    of the decoded text, whether that is the text, and whether the model's processor agrees. keep_words: workers
    remember words between tasks of a stage, and after it until they end or the next stage that encodes."""
    data = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    own = docs.schema[id_col].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, checked=True)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        names = ["_id", *OUT.replace(",", "").split()[::2]]
        for at, texts in _runs(batches):
            rows, raws = [], codec.encode_raw(texts)
            for t, raw, same in zip(texts, raws, codec.agrees(texts, raws), strict=True):
                back = codec.decode([np.frombuffer(raw, "<i4").tolist()])[0]
                rows.append((len(raw) // 4, zlib.crc32(raw), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t, same))
            yield pa.RecordBatch.from_arrays([at, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)
        if not keep_words:
            codec.forget()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).mapInArrow(frugal(part), f"_id {own}, {OUT}").withColumnRenamed("_id", id_col)
