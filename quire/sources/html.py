"""HTML: a small tree of the document, then its headings and text blocks in order."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .model import Block, Outline, Parsed, Section, fallback_title, utf8

# Elements dropped as noise, elements without content, and kinds of text blocks.
NOISE = {"script", "style", "nav", "footer", "aside", "noscript", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KINDS = {"p": "paragraph", "blockquote": "blockquote", "li": "list_item", "pre": "preformatted", "table": "table"}
HEADINGS = {f"h{n}": n for n in range(1, 7)}

#: An open <p> ends where one of these starts.
_ENDS_P = {"p", "div", "ul", "ol", "table", "blockquote", "pre", "section", "article", "main", "header", "footer", "nav", "aside", "form", "hr", *HEADINGS}
#: What an element of a kind closes, up to one of the elements that hold it.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.kids))

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def first(self, tag: str) -> Node | None:
        return next((x for x in self.walk() if isinstance(x, Node) and x.tag == tag), None)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        node = self.at
        while node is not self.root and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close({"p"}, {"table", "td", "th", "li", "blockquote", "button"} - {tag})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def collapse(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _clean(node: Node) -> None:
    for x in list(node.walk()):
        if isinstance(x, Node):
            x.kids = [k for k in x.kids if isinstance(k, str) or k.tag not in NOISE]


def _block_text(node: Node) -> str:
    if node.tag == "pre":
        return node.text().strip()
    if node.tag == "table":
        cells = [collapse(x.text()) for x in node.walk() if isinstance(x, Node) and x.tag in ("td", "th")]
        return " ".join(c for c in cells if c)
    return collapse(node.text())


def parse_html(data: bytes, source: str, metadata: dict[str, str]) -> Parsed:
    tree = Tree()
    tree.feed(utf8(data))
    tree.close()
    meta = dict(metadata)
    if (t := tree.root.first("title")) is not None and (title := collapse(t.text())):
        meta["html_title"] = title
    for x in tree.root.walk():
        if isinstance(x, Node) and x.tag == "link" and "canonical" in (x.attrs.get("rel") or "").lower().split() and x.attrs.get("href"):
            meta.setdefault("canonical_href", x.attrs["href"])
    _clean(tree.root)
    top = next((n for n in map(tree.root.first, ("main", "article", "body")) if n is not None), tree.root)
    items: list[tuple[int, str, str | None]] = []  # level (0: block), text, kind or anchor
    stack = [(k, False) for k in reversed(top.kids)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, str):
            continue
        if node.tag in HEADINGS:
            if said := collapse(node.text()):
                items.append((HEADINGS[node.tag], said, node.attrs.get("id")))
        elif node.tag in KINDS and not inside:
            if said := _block_text(node):
                items.append((0, said, KINDS[node.tag]))
        stack.extend((k, inside or node.tag in KINDS) for k in reversed(node.kids))
    doc_title = next((said for level, said, _ in items if level == 1), None) or meta.get("html_title") or fallback_title(metadata, source)
    if not items:
        return Parsed(doc_title, [Section("section://document", None, doc_title, 1, collapse(top.text()))], [], meta)
    outline, sections, blocks = Outline(), [], []
    if not any(level for level, *_ in items):
        sections.append(Section("section://document", None, doc_title, 1, ""))
    elif not items[0][0]:
        sections.append(Section(outline.unique("preamble"), None, "Preamble", 1, ""))
    for level, said, more in items:
        if level:
            section_id, parent = outline.add(said, level)
            sections.append(Section(section_id, parent, said, level, "", f"#{more}" if more else None, more))
            continue
        s = sections[-1]
        start = len(s.content) + 2 if s.content else 0
        s.content += ("\n\n" if s.content else "") + said
        own = sum(b.section_id == s.section_id for b in blocks[-1:]) and blocks[-1].block_index
        blocks.append(Block(s.section_id, (own or 0) + 1, len(blocks), more, start, start + len(said)))
    return Parsed(doc_title, sections, blocks, meta)
