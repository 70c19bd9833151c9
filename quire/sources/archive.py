"""Documents in ZIP archives: DOCX and EPUB, with limits on entries and decompressed bytes."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html import unescape
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.parsers import expat

from .html import parse_html
from .model import Block, Outline, Parsed, ParseError, Section, fallback_title

# The default limits.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 10_000, 16 << 20, 64 << 20


class Archive:
    def __init__(self, data: bytes, max_entries: int = MAX_ENTRIES, max_entry: int = MAX_ENTRY_BYTES, max_total: int = MAX_TOTAL_BYTES):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ParseError("the archive can't be read") from e
        self.names = {i.filename: i for i in self.zip.infolist()}
        self.max_entry, self.left = max_entry, max_total
        if len(self.zip.infolist()) > max_entries:
            raise ParseError("the archive has too many entries")

    def read(self, name: str) -> bytes | None:
        info = self.names.get(name)
        if info is None:
            return None
        most = min(self.max_entry, self.left)
        if info.file_size > most:
            raise ParseError(f"{name} is too large")
        with self.zip.open(info) as f:
            data = f.read(most + 1)  # the declared size may lie
        if len(data) > most:
            raise ParseError(f"{name} is too large")
        self.left -= len(data)
        return data


def resolve(base: str, href: str) -> tuple[str, str | None] | None:
    """(entry path, fragment) of a reference within an archive; None where it leaves it."""
    path, _, fragment = href.partition("#")
    path = path.partition("?")[0]
    parts = [] if path.startswith("/") else [p for p in posixpath.dirname(base).split("/") if p]
    if path.startswith("/") or "\\" in path or "://" in path:
        return None
    if not path:
        return base, fragment or None
    for raw in path.split("/"):
        part = unquote(raw)
        if "/" in part or "\\" in part or "\0" in part:
            return None
        if part == "..":
            if not parts:
                return None
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts), unquote(fragment) if fragment else None


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml(data: bytes | None, name: str) -> ElementTree.Element:
    if data is None:
        raise ParseError(f"{name} is missing")
    try:
        _refuse_entities(data, name)
        return ElementTree.fromstring(data)
    except (ElementTree.ParseError, expat.ExpatError) as e:
        raise ParseError(f"{name} isn't well-formed") from e


def _refuse_entities(data: bytes, name: str) -> None:
    """A document that declares entities of its own may expand to any size."""

    def declared(*_: object) -> None:
        raise ParseError(f"{name} declares entities")

    parser = expat.ParserCreate()
    parser.EntityDeclHandler = declared
    parser.Parse(data, True)


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


_IDS = re.compile(rb"""\b(?:id|name)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)


def ids_of(raw: bytes) -> set[str]:
    """The values of all id and name attributes of an HTML text."""
    return {unescape((a or b).decode("utf-8", "replace")) for a, b in _IDS.findall(raw)}


def _find(root: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((x for x in root.iter() if local(x.tag) == name), None)


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def parse_docx(data: bytes, source: str, metadata: dict[str, str]) -> Parsed:
    archive = Archive(data)
    body = xml(archive.read("word/document.xml"), "word/document.xml")
    title = None
    if (core := archive.read("docProps/core.xml")) is not None:
        node = _find(xml(core, "docProps/core.xml"), "title")
        title = (node.text or "").strip() if node is not None else None
    outline, sections, first = Outline(), [], None
    for n, p in enumerate((x for x in body.iter() if local(x.tag) == "p"), 1):
        said = "".join(x.text or "" for x in p.iter() if local(x.tag) == "t").strip()
        if not said:
            continue
        style = _find(p, "pStyle")
        name = "".join((_attr(style, "val") or "").split()).lower() if style is not None else ""
        if name[:-1] == "heading" and name[-1:] in set("123456"):
            section_id, parent = outline.add(said, int(name[-1]))
            sections.append(Section(section_id, parent, said, int(name[-1]), "", f"docx:paragraph:{n}"))
            first = first or said
            continue
        if not sections:
            sections.append(Section(outline.unique("preamble"), None, "Preamble", 1, "", f"docx:paragraph:{n}"))
        sections[-1].content += ("\n\n" if sections[-1].content else "") + said
    title = title or first or fallback_title(metadata, source)
    return Parsed(title, sections or [Section("section://document", None, title, 1, "")])


READABLE = ("application/xhtml+xml", "text/html")


def package(archive: Archive) -> tuple[str, ElementTree.Element]:
    node = _find(xml(archive.read("META-INF/container.xml"), "META-INF/container.xml"), "rootfile")
    path = _attr(node, "full-path") if node is not None else None
    if not path:
        raise ParseError("the container names no package")
    return path, xml(archive.read(path), path)


def manifest_of(path: str, opf: ElementTree.Element) -> dict[str, dict]:
    out = {}
    for x in opf.iter():
        if local(x.tag) == "item" and _attr(x, "id"):
            at = resolve(path, _attr(x, "href") or "")
            out[_attr(x, "id")] = {"path": at and at[0], "media": _attr(x, "media-type") or "", "properties": (_attr(x, "properties") or "").split()}
    return out


def _nav_list(node: ElementTree.Element, depth: int, parent: int | None, out: list[dict]) -> None:
    for li in (x for x in node if local(x.tag) == "li"):
        link = next((x for x in li if local(x.tag) in ("a", "span")), None)
        out.append({"order": len(out), "depth": depth, "parent": parent, "label": " ".join("".join(link.itertext()).split()) if link is not None else "", "href": _attr(link, "href") if link is not None else None})
        me = len(out) - 1
        for ol in (x for x in li if local(x.tag) == "ol"):
            _nav_list(ol, depth + 1, me, out)


def _ncx_points(node: ElementTree.Element, depth: int, parent: int | None, out: list[dict]) -> None:
    for p in (x for x in node if local(x.tag) == "navPoint"):
        label, content = _find(p, "text"), next((x for x in p if local(x.tag) == "content"), None)
        out.append({"order": len(out), "depth": depth, "parent": parent, "label": " ".join((label.text or "").split()) if label is not None else "", "href": _attr(content, "src") if content is not None else None})
        _ncx_points(p, depth + 1, len(out) - 1, out)


def navigation(archive: Archive, path: str, opf: ElementTree.Element, manifest: dict[str, dict]) -> tuple[str | None, str | None, list[dict], list[str]]:
    """(kind, entry, nodes, diagnostics): the first usable EPUB 3 table of contents, else the NCX."""
    notes: list[str] = []
    navs = [m for m in manifest.values() if "nav" in m["properties"]]
    if len(navs) > 1:
        notes.append("multiple_epub_nav_resources")
    for m in navs:
        data = archive.read(m["path"]) if m["path"] else None
        if data is None:
            notes.append("unreadable_epub_nav")
            continue
        try:
            root = xml(data, m["path"])
        except ParseError:
            notes.append("malformed_epub_nav")
            continue
        toc = next((x for x in root.iter() if local(x.tag) == "nav" and "toc" in (_attr(x, "type") or "").split()), None)
        nodes: list[dict] = []
        for ol in (x for x in (toc if toc is not None else []) if local(x.tag) == "ol"):
            _nav_list(ol, 1, None, nodes)
        if nodes:
            return "epub_nav", m["path"], nodes, notes
        notes.append("epub_nav_has_no_toc_nodes")
    spine = _find(opf, "spine")
    wanted = _attr(spine, "toc") if spine is not None else None
    ncx = manifest.get(wanted) if wanted else None
    if wanted and ncx is None:
        notes.append("missing_spine_ncx_reference")
    ncx = ncx or next((m for m in manifest.values() if m["media"] == "application/x-dtbncx+xml"), None)
    if ncx and ncx["path"]:
        data = archive.read(ncx["path"])
        if data is None:
            notes.append("unreadable_epub_ncx")
        else:
            try:
                nodes = []
                top = _find(xml(data, ncx["path"]), "navMap")
                _ncx_points(top if top is not None else ElementTree.Element("none"), 1, None, nodes)
                if nodes:
                    return "ncx", ncx["path"], nodes, notes
                notes.append("epub_ncx_has_no_navpoints")
            except ParseError:
                notes.append("malformed_epub_ncx")
    return None, None, [], [*notes, "navigation_unavailable"]


def _check(sections: list[Section]) -> None:
    """Sections have ids of their own, and parents that come before them; so there are no circles."""
    seen: set[str] = set()
    for s in sections:
        if s.section_id in seen or (s.parent_id is not None and s.parent_id not in seen):
            raise ParseError(f"the structure of {s.section_id} is unsound")
        seen.add(s.section_id)


def parse_epub(data: bytes, source: str, metadata: dict[str, str]) -> Parsed:
    """Spine items in order as HTML; labels of the table of contents name sections at their starts."""
    import json

    archive = Archive(data)
    path, opf = package(archive)
    manifest = manifest_of(path, opf)
    spine = _find(opf, "spine")
    refs = [(_attr(x, "idref"), (_attr(x, "linear") or "yes") != "no") for x in (spine if spine is not None else []) if local(x.tag) == "itemref"]
    if not refs:
        raise ParseError("the spine is empty")
    sections: list[Section] = []
    blocks: list[Block] = []
    first_of: dict[str, str] = {}
    anchors: dict[tuple[str, str], str] = {}
    facts, ids = [], {}
    for n, (ref, linear) in enumerate(refs, 1):
        item = manifest.get(ref)
        status = "missing_manifest" if item is None else "unsupported_media" if item["media"] not in READABLE else "parsed"
        raw = archive.read(item["path"]) if status == "parsed" and item["path"] else None
        facts.append({"spine_index": n, "idref": ref, "linear": linear, "status": status if raw is not None or status != "parsed" else "missing_resource"})
        if raw is None:
            continue
        ids[item["path"]] = ids_of(raw)
        got = parse_html(raw, item["path"], {})
        renamed = {s.section_id: f"section://epub-{n}/{s.section_id.removeprefix('section://')}" for s in got.sections}
        for s in got.sections:
            s.section_id, s.parent_id = renamed[s.section_id], renamed.get(s.parent_id)
            s.chapter = f"spine-{n}"
            s.native_location = f"epub:{item['path']}" + (f"#{s.anchor}" if s.anchor else "")
            if s.anchor:
                anchors.setdefault((item["path"], s.anchor), s.section_id)
        first_of.setdefault(item["path"], got.sections[0].section_id)
        for b in got.blocks or []:
            blocks.append(Block(renamed[b.section_id], b.block_index, len(blocks), b.kind, b.range_start, b.range_end, f"epub:{item['path']}"))
        sections += got.sections
    if not sections:
        raise ParseError("no spine item can be read")
    kind, entry, nodes, notes = navigation(archive, path, opf, manifest)
    by_id = {s.section_id: s for s in sections}
    owner: dict[str, int] = {}
    media_of: dict[str, str] = {}
    for m in manifest.values():
        media_of.setdefault(m["path"], m["media"])
    for node in nodes:
        at = resolve(entry, node["href"]) if node["href"] else None
        media = media_of.get(at[0], "") if at else ""
        node["path"], node["fragment"] = at or (None, None)
        if not node["href"]:
            node["status"] = "unlinked"
        elif at is None:
            node["status"] = "invalid_path"
        elif at[0] not in archive.names:
            node["status"] = "missing_resource"
        elif media not in READABLE:
            node["status"] = "unsupported_resource"
        elif at[1] is None:
            node["status"] = "resolved_document"
        else:
            if at[0] not in ids:  # each entry is read once
                raw = archive.read(at[0]) or b""
                ids[at[0]] = ids_of(raw) if _is_utf8(raw) else None
            held = ids[at[0]]
            node["status"] = "malformed_resource" if held is None else "resolved_fragment" if at[1] in held else "missing_fragment"
        target = None
        if node["status"] == "resolved_fragment":
            target = anchors.get(at)
            notes += [] if target else ["navigation_fragment_not_section_boundary"]
        elif node["status"] in ("resolved_document", "missing_fragment"):
            target = first_of.get(at[0])
            notes += ["navigation_missing_fragment_document_fallback"] if node["status"] == "missing_fragment" else []
        if target in owner:
            notes.append("duplicate_navigation_target")
            target = None
        if target and not node["label"]:
            notes.append("empty_navigation_label")
            target = None
        node["section_id"] = target
        if target:
            owner[target] = node["order"]
    order = {s.section_id: k for k, s in enumerate(sections)}
    mapped = [order[node["section_id"]] for node in nodes if node["section_id"]]
    notes += ["navigation_order_conflicts_spine_order" for a, b in zip(mapped, mapped[1:], strict=False) if b < a]
    for section_id, k in owner.items():
        by_id[section_id].title = nodes[k]["label"]
        up = nodes[k]["parent"]
        while up is not None and nodes[up].get("section_id") is None:
            up = nodes[up]["parent"]
        parent = nodes[up]["section_id"] if up is not None else None
        if parent is None and nodes[k]["parent"] is not None:
            notes.append("navigation_parent_unmapped")
        if parent == section_id:
            notes.append("self_parent_section")
        elif parent and order[parent] > order[section_id]:
            notes.append("navigation_parent_conflicts_source_order")
        elif parent:
            by_id[section_id].parent_id = parent
    if owner:
        for s in sections:
            s.level = by_id[s.parent_id].level + 1 if s.parent_id else 1
    _check(sections)
    node = _find(opf, "title")
    title = (node.text or "").strip() if node is not None else ""
    meta = dict(metadata) | {"epub_spine": json.dumps(facts), "epub_navigation": json.dumps({"kind": kind, "nodes": nodes}), "epub_diagnostics": json.dumps(notes)}
    return Parsed(title or fallback_title(metadata, source), sections, blocks, meta)
