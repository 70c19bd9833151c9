"""Plain text and Markdown."""

from __future__ import annotations

import re

from .model import Outline, Parsed, Section, fallback_title, utf8

_HEADING = re.compile(r"(#{1,6})(?:\s+(.*))?$", re.S)


def parse_text(data: bytes, source: str, metadata: dict[str, str]) -> Parsed:
    title = fallback_title(metadata, source)
    return Parsed(title, [Section("section://document", None, title, 1, utf8(data))])


def heading(line: str) -> tuple[int, str] | None:
    """(level, title) of an ATX heading; closing marks go, an empty title is none."""
    m = _HEADING.match(line.strip())
    title = (m[2] or "").strip().rstrip("#").strip() if m else ""
    return (len(m[1]), title) if title else None


def headings(text: str) -> list[tuple[int, int, int, str]]:
    """(line start, line end, level, title) of headings outside fences."""
    found, fence, at = [], None, 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.strip()
        mark = bare[:3] if bare[:3] in ("```", "~~~") else None
        if mark and fence in (None, mark):
            fence = None if fence else mark
        elif fence is None and (h := heading(line)):
            found.append((at, at + len(line), *h))
        at += len(line)
    return found


def parse_markdown(data: bytes, source: str, metadata: dict[str, str]) -> Parsed:
    text = utf8(data)
    found = headings(text)
    title = next((t for *_, level, t in found if level == 1), fallback_title(metadata, source))
    if not found:
        return Parsed(title, [Section("section://document", None, title, 1, text)])
    outline, out = Outline(), []
    if before := text[: found[0][0]].strip():
        out.append(Section(outline.unique("preamble"), None, "Preamble", 1, before))
    for (_, end, level, name), after in zip(found, [*(f[0] for f in found[1:]), len(text)], strict=True):
        section_id, parent = outline.add(name, level)
        out.append(Section(section_id, parent, name, level, text[end:after].strip()))
    return Parsed(title, out)
