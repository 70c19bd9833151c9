"""What a parser returns, and helpers that all parsers share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    """A resource that can't be parsed; it becomes a row with an error code, not a failed job."""


@dataclass
class Section:
    section_id: str
    parent_id: str | None
    title: str
    level: int
    content: str
    native_location: str | None = None
    anchor: str | None = None
    chapter: str | None = None
    page: int | None = None


@dataclass
class Block:
    section_id: str
    block_index: int
    source_order: int
    kind: str
    range_start: int
    range_end: int
    native_location: str | None = None


@dataclass
class Parsed:
    title: str
    sections: list[Section]
    blocks: list[Block] | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def slug(title: str) -> str:
    made = re.sub(r"-+", "-", "".join(c if c.isalnum() else "-" for c in title.strip().lower())).strip("-")
    return made or "section"


class Outline:
    """Gives sections their parents and ids as headings come in document order."""

    def __init__(self, prefix: str = "section://"):
        self.prefix = prefix
        self.open: list[tuple[int, str, str]] = []  # level, title slug path, id
        self.seen: dict[str, int] = {}

    def add(self, title: str, level: int) -> tuple[str, str | None]:
        """(id, parent id): below the nearest heading before of a smaller level."""
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        path = (self.open[-1][1] + "/" if self.open else "") + slug(title)
        parent = self.open[-1][2] if self.open else None
        made = self.unique(path)
        self.open.append((level, path, made))
        return made, parent

    def unique(self, path: str) -> str:
        base = self.prefix + path
        n = self.seen[base] = self.seen.get(base, 0) + 1
        return base if n == 1 else f"{base}-{n}"


def fallback_title(metadata: dict[str, str], source: str) -> str:
    return metadata.get("file_stem") or metadata.get("file_name") or source


def utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ParseError("the document isn't UTF-8") from e
