"""From raw resources to tables of documents, sections and blocks.

Parsers run over Arrow batches, by media type; text/plain needs none and stays native. A resource
that can't be parsed, or exceeds a limit, becomes a row of `rejected` with its code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import ident

from .archive import parse_docx, parse_epub
from .html import parse_html
from .model import ParseError, Parsed, Section
from .openapi import parse_openapi
from .pdf import parse_pdf
from .plain import parse_markdown, parse_text

Parser = Callable[[bytes, str, dict[str, str]], Parsed]

PARSERS: dict[str, Parser] = {
    "text/plain": parse_text,
    "text/markdown": parse_markdown,
    "text/html": parse_html,
    "application/xhtml+xml": parse_html,
    "application/pdf": parse_pdf,
    "application/epub+zip": parse_epub,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": parse_docx,
    "application/vnd.oai.openapi": parse_openapi,
    "application/vnd.oai.openapi+json": parse_openapi,
    "application/json": parse_openapi,
    "application/yaml": parse_openapi,
    "application/x-yaml": parse_openapi,
    "text/yaml": parse_openapi,
}


@dataclass(frozen=True)
class Limits:
    # The default limits of a document.
    document_bytes: int = 134_217_728
    sections: int = 20_000
    depth: int = 32
    characters: int = 16_000_000


#: A batch of parsed resources is given on when it is made from so many bytes, or has so many rows.
OUT_BYTES, OUT_ROWS = 8 << 20, 1000

_SECTION = "struct<section_id:string,parent_id:string,title:string,level:int,content:string,native_location:string,anchor:string,chapter:string,page:int,depth:int,ancestor_ids:array<string>,child_count:int,subtree_size:int>"
_BLOCK = "struct<section_id:string,block_index:int,source_order:int,kind:string,range_start:bigint,range_end:bigint,native_location:string>"
_PARSED = f"source string, content_hash string, media_type string, title string, metadata map<string,string>, sections array<{_SECTION}>, has_blocks boolean, blocks array<{_BLOCK}>, error_code string, error string"


def media_type(name: str) -> str:
    return name.partition(";")[0].strip().lower()


def placed(sections: list[Section]) -> list[dict]:
    """Sections in preorder as rows with their place in the tree: depth, ancestors, children, and how many
    sections lie at and below them."""
    at, rows = {}, []
    for s in sections:
        up = at.get(s.parent_id)
        above = [] if up is None else [*rows[up]["ancestor_ids"], s.parent_id]
        at.setdefault(s.section_id, len(rows))
        rows.append(asdict(s) | {"depth": len(above) + 1, "ancestor_ids": above, "child_count": 0, "subtree_size": 1})
    for s, row in zip(reversed(sections), reversed(rows), strict=True):
        if (up := at.get(s.parent_id)) is not None and rows[up] is not row:
            rows[up]["child_count"] += 1
            rows[up]["subtree_size"] += row["subtree_size"]
    return rows


def parse_one(data: bytes, source: str, kind: str, metadata: dict[str, str], limits: Limits, parsers: dict[str, Parser]) -> dict:
    row = {"title": None, "metadata": list(metadata.items()), "sections": [], "has_blocks": False, "blocks": [], "error_code": None, "error": None}
    parser = parsers.get(media_type(kind))
    if len(data) > limits.document_bytes:
        return row | {"error_code": "RESOURCE_LIMIT", "error": "too many bytes"}
    if parser is None:
        return row | {"error_code": "PARSE_FAILED", "error": f"unsupported media type {kind}"}
    try:
        p = parser(data, source, metadata)
    except (ParseError, RecursionError, ValueError, KeyError, AttributeError, TypeError) as e:
        return row | {"error_code": "PARSE_FAILED", "error": str(e)[:500]}
    if len(p.sections) > limits.sections or sum(len(s.content) for s in p.sections) > limits.characters:
        return row | {"error_code": "RESOURCE_LIMIT", "error": "too many sections or characters"}
    sections = placed(p.sections)
    if max((s["depth"] for s in sections), default=0) > limits.depth:
        return row | {"error_code": "RESOURCE_LIMIT", "error": "too many levels"}
    return row | {"title": p.title, "metadata": list(p.metadata.items()) or list(metadata.items()), "sections": sections, "has_blocks": p.blocks is not None, "blocks": [asdict(b) for b in p.blocks or []]}


def parse(resources: DataFrame, limits: Limits | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """One row for each of resources(source, media_type, bytes, metadata)."""
    limits, parsers = limits or Limits(), parsers or PARSERS
    schema = resources.sparkSession.createDataFrame([], _PARSED).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for k in range(b.num_rows):  # a row at a time, as one may have up to limits.document_bytes
                r = b.slice(k, 1).to_pylist()[0]
                made = parse_one(r["bytes"] or b"", r["source"], r["media_type"] or "", dict(r["metadata"] or {}), limits, parsers)
                rows.append({"source": r["source"], "content_hash": r["content_hash"], "media_type": r["media_type"]} | made)
                held += len(r["bytes"] or b"")
                if held >= OUT_BYTES or len(rows) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    some = resources.select("source", "media_type", "bytes", "metadata", F.concat(F.lit("sha256:"), F.sha2("bytes", 256)).alias("content_hash"))
    return some.mapInArrow(part, schema)


def documents(parsed: DataFrame) -> DataFrame:
    good = parsed.where("error_code is null").withColumn("document_id", ident.document_id(F.col("source"), F.col("content_hash")))
    return good.select("document_id", "source", "title", "media_type", "content_hash", "metadata", "has_blocks", F.size("sections").alias("section_count"))


def sections(parsed: DataFrame) -> DataFrame:
    good = parsed.where("error_code is null").withColumn("document_id", ident.document_id(F.col("source"), F.col("content_hash")))
    return good.select("document_id", F.posexplode("sections").alias("dfs_order", "s")).select("document_id", "dfs_order", "s.*")


def blocks(parsed: DataFrame) -> DataFrame:
    good = parsed.where("error_code is null").withColumn("document_id", ident.document_id(F.col("source"), F.col("content_hash")))
    return good.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_code is not null").select("source", "media_type", "error_code", "error")
