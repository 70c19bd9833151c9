"""PDF: text of pages that use simple fonts, with the standard library alone.

Reads objects and Flate streams by scanning the file, follows the page tree, and takes the strings
that text operators show. Outlines become sections by page ranges; else each page is a section.
Encrypted files and composite fonts aren't read; without any text the document is refused."""

from __future__ import annotations

import re
import zlib

from .model import Outline, Parsed, ParseError, Section, fallback_title

# The default limits.
MAX_PAGES, MAX_PAGE_BYTES = 2_000, 16 << 20

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\b(?:Tj|TJ|Td|TD|T\*|ET)(?![A-Za-z])|['\"](?=\s)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(raw[1:-1].decode().replace(" ", "").replace("\n", "").ljust(2, "0"))
    else:
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _refs(value: bytes) -> list[int]:
    return [int(a) for a in re.findall(rb"(\d+)\s+\d+\s+R", value)]


def _entry(body: bytes, key: bytes) -> bytes | None:
    m = re.search(rb"/" + key + rb"\b\s*(\[.*?\]|<<.*?>>|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\d+\s+\d+\s+R|/?[^\s/<>\[\]()]+)", body, re.S)
    return m[1] if m else None


def page_text(stream: bytes) -> str:
    out, held = [], []
    for m in _SHOWN.finditer(stream):
        x = m[0]
        if x[:1] in b"(<":
            held.append(_string(x))
        else:
            if x in (b"Td", b"TD", b"T*", b"ET", b"'", b'"') and out and out[-1] != "\n":
                out.append("\n")
            out += held
            held = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def parse_pdf(data: bytes, source: str, metadata: dict[str, str], max_pages: int = MAX_PAGES) -> Parsed:
    if data[:5] != b"%PDF-":
        raise ParseError("not a PDF")
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    catalog = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    if catalog is None or b"/Encrypt" in data:
        raise ParseError("the PDF has no readable catalog")
    pages: list[int] = []

    seen: set[int] = set()  # a node that is met again is a cycle, or shared
    due = _refs(_entry(catalog, b"Pages") or b"")[::-1]
    while due and len(pages) <= max_pages:
        n = due.pop()
        if n in seen:
            continue
        seen.add(n)
        if kids := _entry(objects.get(n, b""), b"Kids"):
            due += _refs(kids)[::-1]
        elif n in objects:
            pages.append(n)
    if len(pages) > max_pages:
        raise ParseError("the PDF has too many pages")
    texts, failed = [], 0
    for n in pages:
        raw = b""
        for k in _refs(_entry(objects[n], b"Contents") or b""):
            body = objects.get(k, b"")
            if m := _STREAM.search(body):
                try:
                    raw += (zlib.decompressobj().decompress(m[1], MAX_PAGE_BYTES) if b"FlateDecode" in body[: m.start()] else m[1]) + b"\n"
                except zlib.error:
                    failed += 1
        texts.append(page_text(raw))
    if not any(texts):
        raise ParseError("no text in the PDF; recognising images isn't supported")
    info = next((objects.get(k, b"") for k in _refs((re.search(rb"/Info\s+\d+\s+\d+\s+R", data) or [b""])[0])), b"")
    title = _string(t).strip() if (t := _entry(info, b"Title")) and t[:1] in b"(<" else ""
    title = title or fallback_title(metadata, source)
    entries: list[tuple[int, str, int]] = []  # level, title, page

    number = {n: k for k, n in reversed(list(enumerate(pages, 1)))}
    met: set[int] = set()  # outline items may refer to each other in a circle
    due = [(k, 1) for n in _refs(_entry(catalog, b"Outlines") or b"") for k in _refs(_entry(objects.get(n, b""), b"First") or b"")[:1]][::-1]
    while due:
        n, level = due.pop()
        if n in met or n not in objects:
            continue
        met.add(n)
        body = objects[n]
        name, dest = _entry(body, b"Title"), _refs(_entry(body, b"Dest") or _entry(body, b"D") or b"")
        if name and dest and dest[0] in number:
            entries.append((level, _string(name).strip(), number[dest[0]]))
        due += [(k, level) for k in _refs(_entry(body, b"Next") or b"")[:1]]
        due += [(k, level + 1) for k in _refs(_entry(body, b"First") or b"")[:1]]
    meta = dict(metadata) | {"page_count": str(len(pages)), "failed_pages": str(failed)}
    made, out = Outline(), []
    if not entries:
        return Parsed(title, [Section(f"section://page-{k}", None, f"Page {k}", 1, t, f"page:{k}", page=k) for k, t in enumerate(texts, 1)], None, meta)
    for i, (level, name, page) in enumerate(entries):
        section_id, parent = made.add(name, level)
        below = [p for lv, _, p in _descendants(entries, i) if lv == level + 1]
        after = next((p for lv, _, p in entries[i + 1 :] if lv <= level), None)
        last = min(below) - 1 if below else (after - 1 if after is not None and after > page else page if after is not None else len(pages))
        said = "\n\n".join(t for t in texts[page - 1 : last] if t) if last >= page else ""
        out.append(Section(section_id, parent, name, level, said, f"page:{page}", page=page))
    return Parsed(title, out, None, meta)


def _descendants(entries: list[tuple[int, str, int]], at: int) -> list[tuple[int, str, int]]:
    out = []
    for e in entries[at + 1 :]:
        if e[0] <= entries[at][0]:
            break
        out.append(e)
    return out
