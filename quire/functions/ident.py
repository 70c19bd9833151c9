"""Identities: framed hashes and names, as native column expressions.

Frames: a number is 8 bytes big-endian, a string its byte length then its bytes, an optional string
one byte that says whether it follows. The domain strings are this library's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DOMAIN = "quire-normalized-document/v1"
UNIT_DOMAIN = "quire-text-unit/v1"
SEGMENTATION = "quire-segments/3"
NORMALIZATION = "quire-normalization/7"


def binary(text: Column | str) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("binary")


def u64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def framed(text: Column) -> Column:
    return F.concat(u64(F.octet_length(text)), binary(text))


def framed_optional(text: Column) -> Column:
    return F.when(text.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), framed(text)))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(binary(content), 256))


def document_id(source: Column, content_hash: Column) -> Column:
    return F.concat(F.lit("doc:sha256:"), F.sha2(F.concat(binary(source), F.unhex(F.lit("00")), binary(content_hash)), 256))


def section_frame(section_id: Column, parent_id: Column, title: Column, level: Column, content: Column, child_count: Column) -> Column:
    """A section's bytes in its document's hash; children follow in preorder."""
    return F.concat(binary("section"), F.unhex(F.lit("00")), framed(section_id), framed_optional(parent_id), framed(title), F.unhex(F.lpad(F.hex(level.cast("int")), 2, "0")), framed(content), u64(child_count))


def joined(frames: Column) -> Column:
    """The frames one after another: their hex digits are joined once, so that work grows with the bytes."""
    return F.unhex(F.array_join(F.transform(frames, lambda f: F.hex(f)), ""))


def block_frame(section_id: Column, block_index: Column, source_order: Column, kind: Column, start: Column, end: Column) -> Column:
    """A block's bytes in its document's hash; blocks follow in source order."""
    return F.concat(binary("block"), F.unhex(F.lit("00")), framed(section_id), u64(block_index), u64(source_order), framed(kind), u64(start), u64(end))


def block_map(frames: Column) -> Column:
    """The part of a document's hash that its block map makes; null frames stand for a document without one."""
    present = F.concat(binary("blocks:present"), u64(F.size(frames)), joined(frames))
    return F.when(frames.isNull(), binary("blocks:absent")).otherwise(present)


def normalized_hash(roots: Column, frames: Column, blocks: Column | None = None) -> Column:
    """The hash of a document from its number of roots, its section frames in preorder and its block map."""
    return F.concat(F.lit("nd1:"), F.sha2(F.concat(binary(HASH_DOMAIN), F.unhex(F.lit("00")), u64(roots), joined(frames), binary("blocks:absent") if blocks is None else blocks), 256))


def unit_id(document: Column, normalized: Column, section: Column, kind: str, ordinals: list[Column], start: Column, end: Column) -> Column:
    parts = [binary(UNIT_DOMAIN), framed(document), framed(normalized), framed(section), framed(F.lit(kind)), *map(u64, [*ordinals, start, end]), framed(F.lit(SEGMENTATION))]
    return F.concat(F.lit("tu1:"), F.sha2(reduce(lambda a, b: F.concat(a, b), parts), 256))


def slug(title: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("section"))


def fallback_title(metadata: Column, source: Column) -> Column:
    return F.coalesce(F.try_element_at(metadata, F.lit("file_stem")), F.try_element_at(metadata, F.lit("file_name")), source)


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, chars: int = 320) -> Column:
    return F.left(text, F.lit(chars))
