"""The document reader against golden values and slow models in plain Python."""

import io
import json
import os
import random
import re
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import ident, text
from quire.operators import blocks, epub_checks, lexical, paging, streams, tree, units
from quire.plans import cache, config, queries
from quire.plans.memory import MemoryStore
from quire.plans.ports import budgeted, stacked, watched
from quire.plans.store import Store, normalized_hashes
from quire.plans.verbs import IndexFailed, InvalidRequest, Library, NotFound
from quire.sources import files, router
from quire.sources.archive import ids_of, parse_docx, parse_epub, resolve
from quire.sources.html import parse_html
from quire.sources.model import ParseError
from quire.sources.openapi import parse_openapi
from quire.sources.pdf import parse_pdf
from quire.sources.plain import heading, parse_markdown
from quire.streaming import cursors

SECTION = "document_id string, section_id string, parent_id string, dfs_order int, title string, level int, content string"


def sections(spark, *contents):
    return spark.createDataFrame([("d", f"s{k}", None, k, "T", 1, c) for k, c in enumerate(contents)], SECTION)


@pytest.mark.parametrize(
    ("content", "found"),
    [
        ("Öl🙂x\n\nzwei\n", [(0, 4, "Öl🙂x"), (6, 10, "zwei")]),
        (" left pad \nand on \n\n \t\n\tlast", [(0, 18, " left pad \nand on "), (23, 28, "\tlast")]),
        ("\t\n\n \r\n", []),
        ("u\r\nv\r\n\r\nw\r\n", [(0, 4, "u\r\nv"), (8, 9, "w")]),
        ("a\n　\nb", [(0, 1, "a"), (4, 5, "b")]),
    ],
)
def test_paragraphs(spark, content, found):
    s = sections(spark, content)
    p = units.paragraphs(s)
    assert [(r.range_start, r.range_end, r.text) for r in p.orderBy("source_order").collect()] == found
    cov = units.paragraph_coverage(s, p).first()
    assert cov.paragraph_chars + cov.separator_chars == cov.owner_chars == len(content)


@pytest.mark.parametrize(
    ("content", "n"),
    [
        ("Prof. Lind met J. Ruiz at 9.30. They left, took maps etc. and slept.", 2),
        ("Edit conf/a.cfg or lib.so. Then v2.0 shipped. Fine", 3),
        ("Is a!=b here? Open https://x.example/?k=1 now! Good.", 3),
        ("nothing ends this line", 1),
        ("雨が降る。風も吹く！Sun later.", 3),
        ("One\x01 two. Three\x01.", 2),
        ('He said "stop." Then (it ended.) Really', 3),
    ],
)
def test_sentences(spark, content, n):
    s = sections(spark, content)
    p = units.paragraphs(s)
    q = units.sentences(p)
    got = q.orderBy("source_order").collect()
    assert len(got) == n, [r.text for r in got]
    assert all(content[r.range_start : r.range_end] == r.text for r in got)
    cov = units.sentence_coverage(p, q).first()
    assert cov.sentence_chars + cov.separator_chars + cov.coarse_only_chars == cov.paragraph_chars


def test_content_classes(spark):
    s = sections(spark, "```\nx = 1\n```\n\nk | v\n:--- | ---:\n1 | 2\n\nPlain words here. More of them.\n\n    far in\n\n~~~\n\nk | v\nno rule")
    got = [r.content_class for r in units.paragraphs(s).orderBy("source_order").collect()]
    assert got == ["code_block", "table", "prose_or_unknown", "code_block", "code_block", "prose_or_unknown"]


def slow_tokens(t):
    """Tokens one character at a time."""
    cjk = lambda c: any(a <= ord(c) <= b for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF)))
    word = lambda c: c.isalpha() or c.isnumeric()
    out = set()
    for raw in t.lower().split():
        keep = [k for k, c in enumerate(raw) if word(c) or cjk(c) or c in "-./:+#$@"]
        seg = raw[keep[0] : keep[-1] + 1] if keep else ""
        if any(map(word, seg)) and not any(map(cjk, seg)):
            out.add(seg)
        run = ""
        for c in seg + " ":
            if run and (not (word(c) or c == "_") or cjk(c) != cjk(run[-1])):
                out |= {*run, *(run[k : k + 2] for k in range(len(run) - 1))} if cjk(run[0]) else {run}
                run = ""
            if word(c) or c == "_":
                run += c
    return out


def test_tokens(spark):
    draw = random.Random(1)
    parts = ["build-plan/7", "net::tcp", "snake_case", "_x_", "山川海", "é", "C#", "a@b.c", "--", "(", ")", '"', "9", "Über", ",", "#tag", "日x", "_"]
    texts = ["".join(draw.choice(parts) + draw.choice([" ", "", "\n", "　"]) for _ in range(draw.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", text.tokens(F.col("t")).alias("got")).collect():
        assert len(r.got) == len(set(r.got)) and set(r.got) == slow_tokens(texts[r.k]), texts[r.k]


def test_headings():
    assert heading("### Part ###") == (3, "Part")
    assert heading("# F#") == (1, "F")
    assert heading("##x") is None
    assert heading("##") is None
    p = parse_markdown(b"intro\n\n# Alpha\nbody\n~~~\n# inside\n~~~\n### Beta\n\nmore\n# Alpha\n", "m", {})
    assert [(s.section_id, s.parent_id) for s in p.sections] == [("section://preamble", None), ("section://alpha", None), ("section://alpha/beta", "section://alpha"), ("section://alpha-2", None)]
    assert p.title == "Alpha" and p.sections[1].content == "body\n~~~\n# inside\n~~~"


def test_html_blocks():
    page = b"<html><body><nav>menu</nav><h1>Top</h1><p>red <i>green</i><p>blue<blockquote><p>Said so.</p><p>Twice.</p></blockquote><ol><li>first<li>second</ol><pre> k\n v </pre><table><tr><td>7<td>8</table></body>"
    p = parse_html(page, "h", {})
    assert p.sections[0].content == "red green\n\nblue\n\nSaid so.Twice.\n\nfirst\n\nsecond\n\nk\n v\n\n7 8"
    assert [b.kind for b in p.blocks] == ["paragraph", "paragraph", "blockquote", "list_item", "list_item", "preformatted", "table"]
    assert all(p.sections[0].content[b.range_start : b.range_end].strip() for b in p.blocks)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)
    return out.getvalue()


W = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"


def test_docx():
    doc = f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='Heading 2'/></w:pPr><w:r><w:t>Name</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>te</w:t><w:t>xt</w:t></w:r></w:p></w:body></w:document>"
    p = parse_docx(zipped([("word/document.xml", doc)]), "d", {})
    assert (p.title, [(s.title, s.level, s.content) for s in p.sections]) == ("Name", [("Name", 2, "text")])


def test_entities_are_refused():
    bomb = f"<!DOCTYPE x [<!ENTITY a 'aaaa'><!ENTITY b '&a;&a;&a;'>]><w:document {W}><w:body><w:p><w:r><w:t>&b;</w:t></w:r></w:p></w:body></w:document>"
    with pytest.raises(ParseError, match="entities"):
        parse_docx(zipped([("word/document.xml", bomb)]), "d", {})
    assert parse_docx(zipped([("word/document.xml", f"<!DOCTYPE x><w:document {W}/>")]), "d", {"file_stem": "s"}).title == "s"


def book(nav, chapters, spine="<itemref idref='a'/>"):
    items = "".join(f"<item id='{k}' href='{k}.xhtml' media-type='application/xhtml+xml'/>" for k, _ in chapters)
    return zipped([
        ("META-INF/container.xml", "<container><rootfiles><rootfile full-path='O/p.opf'/></rootfiles></container>"),
        ("O/p.opf", f"<package><metadata><title>Tome</title></metadata><manifest><item id='n' href='nav.xhtml' media-type='application/xhtml+xml' properties='nav'/>{items}</manifest><spine>{spine}</spine></package>"),
        ("O/nav.xhtml", f"<html xmlns:e='x'><nav e:type='toc'><ol>{nav}</ol></nav></html>"),
        *((f"O/{k}.xhtml", c) for k, c in chapters),
    ])


def test_epub():
    nav = "<li><a href='a.xhtml'>Start</a><ol><li><a href='b.xhtml#k'>Deep</a></li><li><a href='../../away'>Gone</a></li></ol></li>"
    chapters = [("a", "<html><body><h1>A</h1><p>x</p></body></html>"), ("b", "<html><body><h1 id='k'>B</h1><p>y</p></body></html>")]
    p = parse_epub(book(nav, chapters, "<itemref idref='a'/><itemref idref='b' linear='no'/><itemref idref='z'/>"), "e", {})
    assert [(s.title, s.parent_id, s.level) for s in p.sections] == [("Start", None, 1), ("Deep", "section://epub-1/a", 2)]
    assert '"invalid_path"' in p.metadata["epub_navigation"] and '"missing_manifest"' in p.metadata["epub_spine"]
    assert resolve("O/a.xhtml", "..%2Fx") is None
    assert resolve("O/a.xhtml", "b%20c.xhtml#f") == ("O/b c.xhtml", "f")


def test_epub_reads_an_entry_once():
    """Two hundred targets in one large chapter aren't two hundred readings; text that looks like an id is none."""
    chapter = "<html><body>" + "".join(f"<h2 id='t{k}'>H{k}</h2><p>{'word ' * 400}</p>" for k in range(200)) + "<p>says 'ghost' only</p></body></html>"
    nav = "".join(f"<li><a href='a.xhtml#t{k}'>N{k}</a></li>" for k in range(200)) + "<li><a href='a.xhtml#ghost'>G</a></li>"
    nodes = json.loads(parse_epub(book(nav, [("a", chapter)]), "e", {}).metadata["epub_navigation"])["nodes"]
    assert [n["status"] for n in nodes] == ["resolved_fragment"] * 200 + ["missing_fragment"]
    assert ids_of(b"<a name=\"x&amp;y\"><p ID = 'z'>") == {"x&y", "z"}


def epubs(spark, data):
    r = spark.createDataFrame([("e", "application/epub+zip", data, None)], "source string, media_type string, bytes binary, metadata map<string,string>")
    p = router.parse(r).cache()
    secs, b = router.sections(p), router.blocks(p)
    paras = units.paragraphs(secs, b)
    return epub_checks.Epubs(router.documents(p), secs, b, paras, units.sentences(paras))


def codes(found):
    return sorted((r.severity[0], r.code) for r in found.collect())


def test_epub_checks(spark):
    """A sound book has degradations of its source only; spoilt tables have the errors that were made."""
    nav = "<li><a href='b.xhtml#k'>Deep</a></li><li><a href='a.xhtml'>Start</a></li><li><a href='a.xhtml#nope'>X</a></li><li><span>Part</span><ol><li><a href='../../away'>Gone</a></li></ol></li>"
    chapters = [("a", "<html><body><h1>A</h1><p>One. Two.</p><pre>x = 1.</pre></body></html>"), ("b", "<html><body><h1 id='k'>B</h1><p>y</p></body></html>")]
    e = epubs(spark, book(nav, chapters, "<itemref idref='a'/><itemref idref='b' linear='no'/><itemref idref='z'/>"))
    assert codes(epub_checks.findings(e)) == sorted([("d", c) for c in ("navigation_target_missing_fragment", "navigation_target_invalid_path", "navigation_node_unlinked", "spine_missing_manifest_item", "navigation_missing_fragment_document_fallback", "duplicate_navigation_target", "navigation_order_conflicts_spine_order")])
    v = epub_checks.verdicts(e.documents, epub_checks.findings(e)).first()
    assert (v.errors, v.degradations, v.sound) == (0, 7, True)
    c = epub_checks.coverage(e).first()
    assert (c.spine_items, c.linear_items, c.non_linear_items, c.nodes, c.resolved_nodes, c.mapped_nodes, c.sections, c.blocks, c.sentences) == (3, 2, 1, 5, 2, 2, 2, 3, 3)
    spoilt = {
        "paragraph_exact_slice_mismatch": ("paragraphs", "text", F.lit("z")), "sentence_outside_parent_paragraph": ("sentences", "range_end", F.col("range_end") + 5), "epub_block_native_location_mismatch": ("blocks", "native_location", F.lit("epub:other")),
        "unknown_section_parent": ("sections", "parent_id", F.lit("section://none")), "structure_source_order_gap": ("sections", "dfs_order", F.col("dfs_order") + 1), "section_unknown_spine_index": ("sections", "chapter", F.lit("spine-9")),
    }
    for code, (table, name, value) in spoilt.items():
        bad = epub_checks.Epubs(**(vars(e) | {table: getattr(e, table).withColumn(name, value)}))
        assert ("e", code) in codes(epub_checks.findings(bad)), code
    ring = spark.createDataFrame([("d", "a", "b"), ("d", "b", "a"), ("d", "c", "a"), ("d", "r", None), ("d", "s", "r")], "document_id string, section_id string, parent_id string")
    assert sorted(r.section_id for r in epub_checks.circular(ring).collect()) == ["a", "b", "c"]


def pdf(*objects):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate(objects, 1))


def stream(said):
    return b"<</Length 9>>\nstream\nBT (%s) Tj ET\nendstream\n" % said


def test_openapi_and_pdf():
    p = parse_openapi(b"openapi: 3.0.0\ninfo: {title: Shop}\npaths:\n  /carts:\n    put: {summary: Store}\n", "o", {})
    assert [s.title for s in p.sections] == ["Overview", "/carts", "PUT /carts"]
    assert p.sections[2].native_location == "#/paths/~1carts/put"
    one = pdf(b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Contents 4 0 R>>", stream(b"Greetings"))
    assert [(s.title, s.content) for s in parse_pdf(one, "p", {}).sections] == [("Page 1", "Greetings")]


def test_pdf_outlines_and_cycles():
    """Outline entries make sections; items, pages and children that refer to each other in circles end."""
    head = (b"<</Type/Catalog/Pages 2 0 R/Outlines 7 0 R>>", b"<</Type/Pages/Kids[3 0 R 5 0 R 2 0 R]/Count 2>>", b"<</Type/Page/Contents 4 0 R>>", stream(b"first"), b"<</Type/Page/Contents 6 0 R>>", stream(b"second"))
    sound = pdf(*head, b"<</First 8 0 R>>", b"<</Title(One)/Dest[3 0 R]/Next 9 0 R>>", b"<</Title(Two)/Dest[5 0 R]>>")
    assert [(s.title, s.content, s.page) for s in parse_pdf(sound, "p", {}).sections] == [("One", "first", 1), ("Two", "second", 2)]
    circle = pdf(*head, b"<</First 8 0 R>>", b"<</Next 9 0 R>>", b"<</Title(Two)/Dest[5 0 R]/Next 8 0 R/First 9 0 R>>")
    assert [s.title for s in parse_pdf(circle, "p", {}).sections] == ["Two"]
    with pytest.raises(ParseError, match="pages"):
        parse_pdf(sound, "p", {}, max_pages=1)


def test_router_rejects_without_failing(spark):
    r = spark.createDataFrame([("a", "text/plain; charset=utf-8", b"ok", None), ("b", "text/plain", b"\xff", None), ("c", "image/png", b"", None)], "source string, media_type string, bytes binary, metadata map<string,string>")
    p = router.parse(r).cache()
    assert {x.source for x in router.documents(p).collect()} == {"a"}
    assert {x.source for x in router.rejected(p).collect()} == {"b", "c"}


def test_block_problems(spark):
    s = sections(spark, "abcdef")
    b = spark.createDataFrame([("d", "s0", 1, 0, "paragraph", 0, 3), ("d", "s0", 2, 1, "paragraph", 2, 5)], "document_id string, section_id string, block_index int, source_order int, kind string, range_start long, range_end long")
    assert blocks.problems(b, s).first().error == "overlap"


def test_documents_with_other_blocks_hash_otherwise(spark):
    """Two documents that differ only in their block maps, or in having one, have different hashes."""
    pages = [("x", "<h1>T</h1><p>one two</p>"), ("x2", "<h1>T</h1><pre>one two</pre>"), ("x3", "<h1>T</h1><p>one two</p>")]
    r = spark.createDataFrame([(s, "text/html", h.encode(), None) for s, h in pages], "source string, media_type string, bytes binary, metadata map<string,string>")
    p = router.parse(r).cache()
    docs = router.documents(p)
    got = {x.source: x.normalized_hash for x in normalized_hashes(router.sections(p), router.blocks(p), docs).join(docs, "document_id").collect()}
    bare = {x.source: x.normalized_hash for x in normalized_hashes(router.sections(p)).join(docs, "document_id").collect()}
    assert got["x"] == got["x3"] != got["x2"] and len(set(bare.values())) == 1 and bare["x"] not in got.values()


def test_cursors():
    t = cursors.encode(cursors.READ, {"position": 3, "document": "d"})
    assert cursors.decode(cursors.READ, t, {"document": "d"})["position"] == 3
    for bad in (t[:-2], t.replace("qr-", "qu-"), "x"):
        with pytest.raises(cursors.CursorError):
            cursors.decode(cursors.READ, bad)
    with pytest.raises(cursors.CursorError):
        cursors.decode(cursors.READ, t, {"document": "other"})


def test_sources(tmp_path, spark):
    assert not files.is_public_url("http://127.0.0.1/") and not files.is_public_url("http://u:p@example.com/") and files.is_public_url("https://example.com/a")
    with pytest.raises(files.BlockedSource):
        files.allowed("/etc/passwd", [str(tmp_path)])
    top, away = tmp_path / "in", tmp_path / "out"
    top.mkdir(), away.mkdir()
    (top / "a b.md").write_text("# A")
    (top / "b.bin").write_text("x")
    (away / "c.md").write_text("# secret")
    os.symlink(away / "c.md", top / "link.md")
    os.symlink(away, top / "folder")
    assert [r.name for r in files.list_documents(spark, [str(top)]).collect()] == ["a b.md"]
    assert files.scan(spark, [str(top)], max_bytes=2).count() == 0


def test_urls_by_column(spark):
    """The column's verdicts agree with the scalar check, but for IPv6, which only that knows."""
    urls = ["http://a.example/", "HTTPS://A.example./x", "http://user@a.example/", "http://10.0.0.1/", "http://100.64.1.1", "http://8.8.8.8:80/", "http://0177.0.0.1/", "http://1.2.3/", "http://256.1.1.1/", "http://localhost:9/", "http://x.internal", "ftp://a.example", "http:///x", "http://[2606:4700::1]/", "  http://b.example  ", "http://192.0.2.7/", "http://198.19.0.1/", "http://239.1.1.1", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", files.url_verdict(F.col("u")).alias("v")).collect():
        known = bool(r.u) and files.is_public_url(r.u)
        odd = r.u and ("[" in r.u or r.u in ("http://0177.0.0.1/", "http://1.2.3/", "http://256.1.1.1/"))
        assert (r.v == "ok") == known or (odd and r.v == "closed_host"), r


def library(spark, tmp_path, text_, store=None):
    docs = tmp_path / "docs"
    docs.mkdir(exist_ok=True)
    (docs / "g.md").write_text(text_)
    return Library(spark, store or Store(spark, str(tmp_path / "store"), buckets=2), [str(docs)]), docs


GUIDE = "# Garden\n\nBees need flowers. They fly far.\n\n```\nplant(tulip)\n```\n\nWater plants daily in dry summers.\n\n## Tools\n\nA spade, a rake.\n\n## Pests\n\nSlugs eat lettuce.\n\n# End\n\nDone here.\n"


def test_library_end_to_end(tmp_path, spark):
    lib, docs = library(spark, tmp_path, GUIDE)
    (doc,) = lib.open_document(str(docs / "g.md")).collect()
    assert lib.open_document(str(docs / "g.md")).count() == 1
    hits = lib.search_document(doc.document_id, "dry plants").collect()
    assert [h.kind for h in hits] == ["paragraph", "sentence"] and [h.location for h in hits] == ["search-unit:3", "search-unit:3#sentence:1"]
    assert hits[0].source == doc.source and lib.read_document(doc.document_id, locator=hits[0].locator.asDict())["content"] == "Water plants daily in dry summers."
    assert [h.section_id for h in lib.search_document(doc.document_id, "spade rake", rank="sections").collect()] == ["section://garden/tools"]
    assert lib.store.invariants().count() == 0
    got, cursor = [], None
    while True:
        page = lib.get_text_units(doc.document_id, "section://garden", max_items=2, cursor=cursor)
        got += [(r["text"], r["effective_kind"], r["content_class"]) for r in page["items"]]
        cursor = page["next_cursor"]
        if page["complete"]:
            break
    assert got == [("Bees need flowers.", "sentence", "unknown"), ("They fly far.", "sentence", "unknown"), ("```\nplant(tulip)\n```", "paragraph", "non_prose"), ("Water plants daily in dry summers.", "sentence", "unknown")]
    assert page["section_complete"] and page["coverage"]["represented_sentences"] == 3 and page["coverage"]["coarse_non_prose_items"] == 1
    whole = lib.read_document(doc.document_id, "section://garden")["content"]
    first = lib.read_document(doc.document_id, "section://garden", max_chars=20)
    rest = lib.read_document(doc.document_id, "section://garden", max_chars=20_000, cursor=first["next_cursor"])
    assert first["content"] + rest["content"] == whole and re.search(r"^# Garden\n\n.*## Pests\n\nSlugs eat lettuce\.$", whole, re.S)
    assert [r.title for r in lib.get_document_structure(doc.document_id).orderBy("dfs_order").collect()] == ["Garden", "Tools", "Pests", "End"]
    with pytest.raises(InvalidRequest):
        lib.search_document(doc.document_id, "x", limit=51)
    (docs / "g.md").write_text("# Garden\n\nNew.\n")
    assert lib.open_document(str(docs / "g.md")).count() == 2  # the new content is another document


def test_anchors_and_context(tmp_path, spark):
    lib, docs = library(spark, tmp_path, GUIDE, MemoryStore(spark))
    (doc,) = lib.open_document(str(docs / "g.md")).collect()
    d, top = doc.document_id, "section://garden"
    items = lib.get_text_units(d, top)["items"]
    after = lib.get_text_units(d, top, anchor=items[1]["locator"], max_items=1)
    assert [r["text"] for r in after["items"]] == [items[2]["text"]] and not after["section_complete"]
    last = lib.get_text_units(d, top, cursor=after["next_cursor"])
    assert [r["text"] for r in last["items"]] == [items[3]["text"]] and last["complete"] and not last["section_complete"]
    back = lib.get_text_units(d, top, direction="backward", anchor=items[2]["locator"])
    assert sorted(r["text"] for r in back["items"]) == sorted(r["text"] for r in items[:2])
    with pytest.raises(InvalidRequest):
        lib.get_text_units(d, "section://end", anchor=items[0]["locator"])
    with pytest.raises(InvalidRequest):
        lib.get_text_units(d, top, kind="paragraph", anchor=items[0]["locator"])
    with pytest.raises(NotFound):
        lib.get_text_units(d, "section://nowhere")
    skip = lib.get_text_units(d, top, kind="paragraph", policy="eligible_only")
    assert len(skip["items"]) == 2 and skip["complete"] and not skip["section_complete"] and skip["coverage"]["intentionally_skipped"] == 1
    near = lib.get_context(d, locator=items[2]["locator"] | {}, unit="paragraph")["items"]
    assert [(r["role"], r["content_class"]) for r in near] == [("before", "prose_or_unknown"), ("anchor", "code_block"), ("after", "prose_or_unknown")]
    near = lib.get_context(d, locator=items[1]["locator"], unit="sentence", before=1, after=1)["items"]
    assert [r["role"] for r in near] == ["before", "anchor", "after"] and near[2]["degradation"].startswith("requested_sentence_context")
    with pytest.raises(InvalidRequest):
        lib.get_context(d, locator=items[1]["locator"], unit="section")
    with pytest.raises(InvalidRequest):
        lib.get_context(d, locator=items[1]["locator"], unit="sentence", max_chars=5)
    box = lib.get_context(d, locator=items[1]["locator"], relation="container", unit="paragraph")["items"]
    assert [(r["role"], r["content"]) for r in box] == [("container", "Bees need flowers. They fly far.")]
    with pytest.raises(InvalidRequest):
        lib.get_context(d, top, relation="container", unit="paragraph")
    box = lib.get_context(d, locator=items[1]["locator"], relation="container", unit="section", max_chars=10)
    assert box["content"] == "# Garden\n\n"[:10] and box["truncated"]
    titles = lambda relation, at: [r["title"] for r in lib.get_context(d, at, relation=relation)["items"]]
    assert titles("ancestors", "section://garden/tools") == ["Garden"] and titles("children", top) == ["Tools", "Pests"]
    assert titles("siblings", top) == ["End"] and titles("owner_section", top) == ["Garden"]
    around = lib.get_context(d, "section://garden/pests")
    assert [r["title"] for r in around["items"]] == ["Tools", "Pests", "End"] and around["content"].startswith("## Tools\n\nA spade")
    whole = items[0]["locator"] | {"paragraph_index": None, "sentence_index": None, "segmentation": None}
    with pytest.raises(InvalidRequest, match="range"):
        lib.get_context(d, locator=whole)


def test_hits_that_do_not_agree_are_refused(tmp_path, spark):
    lib, docs = library(spark, tmp_path, GUIDE, MemoryStore(spark))
    (doc,) = lib.open_document(str(docs / "g.md")).collect()
    lib.store.held["lexical_units"] = lib.store.held["lexical_units"].withColumn("range_end", F.col("range_end") + 1)
    with pytest.raises(IndexFailed):
        lib.search_document(doc.document_id, "slugs")
    lib.store.held["indexed"] = lib.store.held["indexed"].limit(0)  # the index is missing, and is built again
    assert lib.search_document(doc.document_id, "slugs").count() == 2


def test_search_scores_use_the_whole_store(spark):
    units_ = [("a", "s", 0, "section", "A", ["a"]), ("a", "s", 1, "paragraph", "x", ["ladder", "works"]), ("b", "s", 0, "section", "B", ["b"]), ("b", "s", 1, "paragraph", "y", ["nothing", "of", "it", "here"])]
    whole = spark.createDataFrame(units_, "document_id string, section_id string, source_order int, kind string, text string, tokens array<string>")
    q = spark.createDataFrame([(0, "ladder"), (1, "absent word")], "query_id int, query string")
    (hit,) = lexical.rank_bm25(whole.where("document_id = 'a'"), q, whole=whole).collect()
    assert hit.score == pytest.approx(lexical.bm25_score(lexical.idf(4, 1), 2, 2.0))


def test_neighbours_and_ranks(spark):
    s = tree.enrich(spark.createDataFrame([("d", "a", None, 0, "A", 1, "x"), ("d", "b", "a", 1, "B", 2, "y"), ("d", "c", None, 2, "C", 1, "")], SECTION))
    assert {(r.anchor_id, r.section_id) for r in tree.neighbours(s).collect()} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c")}
    assert tree.outline(s, budget=2).where("truncated").count() == 2
    assert abs(lexical.bm25_score(lexical.idf(10, 2), 5, 5) - 1 / (1 + lexical.idf(10, 2))) < 1e-12


def test_trees_of_a_million_sections(spark):
    """No limit on sections but those of a document, and two trees at once don't mix."""
    n, per = 1_200_000, 300
    place, doc = F.col("id") % per, F.floor(F.col("id") / per).cast("string")
    parent = F.when(place == 0, None).when(place % 3 == 1, F.lit("s0")).otherwise(F.concat(F.lit("s"), (place - 1).cast("string")))
    s = spark.range(n).select(doc.alias("document_id"), F.concat(F.lit("s"), place.cast("string")).alias("section_id"), parent.alias("parent_id"), place.cast("int").alias("dfs_order"))
    got = tree.enrich(s).agg(F.count("*"), F.sum("subtree_size"), F.sum("depth"), F.max("depth"), F.sum("child_count")).first()
    depth = [1] + [2 + (k - 1) % 3 for k in range(1, per)]
    assert tuple(got) == (n, sum(depth) * n // per, sum(depth) * n // per, 4, (per - 1) * n // per)


def test_deep_trees_against_a_walk(spark):
    draw = random.Random(9)
    rows = []
    for d in range(30):
        path = []
        for k in range(draw.randint(1, 40)):
            path = path[: draw.randint(0, len(path))]
            rows.append((str(d), f"s{k}", path[-1] if path else None, k, "T", 1, "x"))
            path = [*path, f"s{k}"]
    got = {(r.document_id, r.section_id): r for r in tree.enrich(spark.createDataFrame(rows, SECTION)).collect()}
    up = {(d, s): p for d, s, p, *_ in rows}

    def line(d, s):
        return [] if up[d, s] is None else [*line(d, up[d, s]), up[d, s]]

    for (d, s), r in got.items():
        assert r.ancestor_ids == line(d, s) and r.depth == len(line(d, s)) + 1
        assert r.child_count == sum(a == d and p == s for (a, _), p in up.items()) and r.subtree_size == 1 + sum(a == d and s in line(a, b) for a, b in up)


def test_streams_against_plain_python(spark):
    s = sections(spark, "One here. Two here.\n\n```\ncode\n```\n\nThree. Four.", "    only code", "")
    p = units.paragraphs(s)
    q = units.sentences(p)
    items = streams.stream(p, q)
    assert [(r["section_id"], r["index"], r["effective_kind"]) for r in items.orderBy("section_id", "index").collect()] == [*(("s0", k, "paragraph" if k == 2 else "sentence") for k in range(5)), ("s1", 0, "paragraph")]
    c = {r.section_id: r for r in streams.coverage(s, p, q).collect()}
    assert c["s0"].represented_sentences == 4 and c["s0"].non_prose_paragraphs == 1 and c["s2"].paragraph_count == 0 and all(r.source_complete for r in c.values())
    got = streams.anchored(items, items.where("index = 1"), 9, 14, forward=True).collect()
    assert [r["index"] for r in got] == [2]
    with pytest.raises(ValueError, match="kind"):
        streams.stream(p, q, "word")
    with pytest.raises(ValueError, match="page"):
        paging.check_page(0, 10)


def test_caches(spark, tmp_path):
    rows = [("a", "text/plain", b"one", None), ("b", "text/plain", b"two", None)]
    r = spark.createDataFrame(rows, "source string, media_type string, bytes binary, metadata map<string,string>")
    first = cache.parse_through(r, str(tmp_path / "parsed"))
    again = cache.parse_through(r.unionByName(r.where("source = 'a'").withColumn("bytes", F.lit(b"new"))), str(tmp_path / "parsed"))
    assert first.count() == 2 and again.count() == 3
    assert cache.parse_through(r, str(tmp_path / "parsed"), normalization="another").count() == 2
    held = cache.Table(spark, str(tmp_path / "raw"), cache.RAW)
    assert held.rows().count() == 0
    key = lambda s: spark.range(1).select(cache.raw_key(F.lit(s), F.lit(None).cast("string"))).first()[0]
    body = [(key(s), s, s, "text/plain", b"x", tag, None, None) for s, tag in (("u1", "e1"), ("u2", None))]
    held.put(spark.createDataFrame(body, cache.RAW))
    asked = spark.createDataFrame([("u1", None, False), ("u2", None, False), ("u3", None, False), ("u1", None, True), ("u1", "me", False)], "source string, profile string, force boolean")
    got = sorted((x.source, x.profile or "", x.action) for x in cache.revalidation(asked, held.rows()).collect())
    assert got == [("u1", "", "conditional"), ("u1", "", "fetch"), ("u1", "me", "fetch"), ("u2", "", "reuse"), ("u3", "", "fetch")]
    answers = spark.createDataFrame([(304, *body[0][:5], "e2", None, None), (200, "k9", "u9", "u9", "text/plain", b"y", None, None, None), (500, "k8", "u8", "u8", None, None, None, None, None)], "status int, " + cache.RAW)
    assert sorted((x.source, x.etag, bytes(x.bytes)) for x in cache.settled(answers, held.rows()).collect()) == [("u1", "e2", b"x"), ("u9", None, b"y")]


def test_ports_and_settings(spark):
    df = spark.createDataFrame([(b"abc",), (b"abcdef",)], "bytes binary")
    assert stacked(budgeted(3), watched("budget"))(df).count() == 1
    made = config.Settings.read({"QUIRE_ROOTS": " /a, ,/b ", "QUIRE_MAX_DEPTH": "5"})
    assert made.roots == ("/a", "/b") and made.limits.depth == 5 and made.limits.sections == 20_000
    with pytest.raises(ValueError, match="QUIRE_MAX_DEPTH"):
        config.Settings.read({"QUIRE_MAX_DEPTH": "-1"})
    assert config.bearer("Bearer a.b-c=") == "a.b-c=" and config.bearer("Basic x") is None
    assert config.profile_variable("my-team") == "QUIRE_TOKEN_MY_TEAM"


def test_frames_join_in_order(spark):
    got = spark.range(1).select(F.hex(ident.joined(F.array(F.lit(b"ab"), F.lit(b""), F.lit(b"c"))))).first()[0]
    assert got == b"abc".hex().upper()


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_runs_from_another_folder(tmp_path):
    """Workers get the package from the driver, wherever that was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '1').getOrCreate(); print('rows', e.queries()['section_catalog'](s, '/root/testdata/sf0.001').count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 107" in done.stdout, done.stderr[-2000:]


def test_classes_of_whole_paragraphs(spark, tmp_path):
    """Every paragraph of a text is classified by its own lines, wherever it stands."""
    long = "Prose that goes on for far more than forty characters in its first line.\nAnd on.\n\n"
    texts = [(4, long + "```\ncode\n```\n\na | b\n--- | ---\n1 | 2\n\n    indented\n    more\n\nEnd."), (8, "x | y of a first line of more than forty characters here\n--- | ---\n1 | 2"), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", "See:\n\n~~~\nrun\n~~~"), (1, 4, "assistant", "Done.")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = queries.paragraph_classes(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.document_id, r.paragraph_index)):
        got.setdefault(r.document_id, []).append(r.content_class)
    prose = "prose_or_unknown"
    assert sorted(got.values()) == sorted([[prose, "code_block", "table", "code_block", prose], ["table"], [prose, "code_block", prose]])


def test_abbreviations_in_a_row_end_no_sentence(spark):
    s = sections(spark, "Ci la no. No. El ga. Y ya")
    assert [r.text for r in units.sentences(units.paragraphs(s)).orderBy("source_order").collect()] == ["Ci la no. No. El ga.", "Y ya"]


def test_a_title_may_end_in_a_reference_without_a_semicolon():
    assert parse_html(b"<title>des&amp;&amp</title><p>x</p>", "memory:p", {}).metadata["html_title"] == "des&&"
