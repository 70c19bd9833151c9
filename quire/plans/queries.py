"""Queries of the library over the driver's tables, one for each operator or a few."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ident, text
from quire.operators import blocks, lexical, locate, paging, streams, tree, units
from quire.sources import files, router

from . import corpus, store

Query = Callable[[SparkSession, str], DataFrame]


def ingest_document_identity(spark, d):
    return corpus.plain_documents(spark, d).select("doc_id", "document_id", "content_hash", "title", F.char_length("text").cast("long").alias("chars"))


def normalized_hash_flat(spark, d):
    docs = corpus.plain_documents(spark, d)
    return docs.select("doc_id", "document_id").join(corpus.hashes(corpus.plain_sections(docs)), "document_id").select("doc_id", "normalized_hash")


def normalized_hash_tree(spark, d):
    s = corpus.chat_sections(spark, d)
    return corpus.hashes(s).join(s.select("document_id", "source").distinct(), "document_id").select("source", "normalized_hash")


def section_catalog(spark, d):
    s = corpus.chat_sections(spark, d)
    return s.select("source", "section_id", "parent_id", F.col("dfs_order").cast("long").alias("dfs_order"), F.col("level").cast("long").alias("level"), "title", F.char_length("content").cast("long").alias("chars"), F.col("depth").cast("long").alias("depth"), F.col("child_count").cast("long").alias("child_count"), F.col("subtree_size").cast("long").alias("subtree_size"))


def section_count_budget(spark, d):
    s = corpus.chat_sections(spark, d)
    at = blocks.over_budget(s, max_sections=6, max_depth=32, max_chars=4000).join(s.select("document_id", "source").distinct(), "document_id")
    return at.select("source", F.col("section_count").cast("long").alias("section_count"), F.col("max_depth").cast("long").alias("max_depth"), F.col("chars").cast("long").alias("chars"), "over")


def outline_depth_limited(spark, d):
    s = corpus.chat_sections(spark, d)
    return tree.outline(s, max_depth=1).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", "title", "truncated")


def outline_first_n(spark, d):
    s = corpus.chat_sections(spark, d)
    return tree.outline(s, budget=3).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", F.col("rank").cast("long").alias("rank"), "truncated")


def ancestors(spark, d):
    s = corpus.chat_sections(spark, d)
    return tree.ancestors(s).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", F.col("position").cast("long").alias("position"), "ancestor_id")


def children(spark, d):
    s = corpus.chat_sections(spark, d)
    return tree.children(s).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", "child_id")


def siblings(spark, d):
    s = corpus.chat_sections(spark, d)
    return tree.siblings(s).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", "sibling_id")


def section_neighbours(spark, d):
    s = corpus.chat_sections(spark, d)
    return tree.neighbours(s, 1, 1).join(s.select("document_id", "source").distinct(), "document_id").select("source", "anchor_id", F.col("offset").cast("long").alias("offset"), "role", "section_id")


def render_section_tree(spark, d):
    s = corpus.chat_sections(spark, d)
    return tree.render(s, s.where("parent_id is null").select("document_id", "section_id")).join(s.select("document_id", "source").distinct(), "document_id").select("source", "content")


def read_page(spark, d):
    docs = corpus.plain_documents(spark, d)
    page = docs.select("doc_id", paging.text_page(F.col("text"), F.lit(500), 300).alias("p"))
    return page.select("doc_id", "p.content", F.col("p.end").cast("long").alias("end_at"), F.col("p.total").cast("long").alias("total"), "p.complete")


def paragraph_units(spark, d):
    p = units.paragraphs(corpus.joined_chats(spark, d))
    return p.select("document_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), F.col("source_order").cast("long").alias("source_order"), "range_start", "range_end", "text", "content_class")


def paragraph_coverage(spark, d):
    s = corpus.joined_chats(spark, d)
    return units.paragraph_coverage(s, units.paragraphs(s)).select("document_id", "owner_chars", "paragraph_count", "paragraph_chars", "separator_chars", "fallback_chars")


def paragraph_ids(spark, d):
    s = corpus.joined_chats(spark, d)
    return units.with_paragraph_ids(units.paragraphs(s), corpus.hashes(s)).select("document_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), "unit_id")


def exact_slice_roundtrip(spark, d):
    s = corpus.joined_chats(spark, d)
    p = units.paragraphs(s).join(s.select("document_id", "section_id", "content"), ["document_id", "section_id"])
    cut = F.substring("content", F.col("range_start").cast("int") + 1, (F.col("range_end") - F.col("range_start")).cast("int"))
    return p.groupBy("document_id").agg(F.count("*").alias("paragraphs"), F.count(F.when(cut == F.col("text"), 1)).alias("exact"))


def paragraph_content_class(spark, d):
    """Classes of all documents' paragraphs, and of conversations' turns as prose, fences, tables and indented lines."""
    both = (corpus.plain_sections(corpus.plain_documents(spark, d)).drop("doc_id"), corpus.joined_chats(spark, d))
    docs, chats = (units.paragraphs(s).groupBy("document_id", "content_class").agg(F.count("*").alias("paragraphs"), F.sum(F.col("range_end") - F.col("range_start")).alias("chars")) for s in both)
    return docs.unionByName(chats)


def paragraph_classes(spark, d):
    """Classes of all paragraphs of all documents and conversations, as they stand in their texts."""
    both = (corpus.plain_sections(corpus.plain_documents(spark, d)).drop("doc_id"), corpus.joined_chats(spark, d))
    docs, chats = (units.paragraphs(s).select("document_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), "range_start", "range_end", "content_class") for s in both)
    return docs.unionByName(chats)


def _plain_units(spark, d):
    docs = corpus.plain_documents(spark, d)
    secs = corpus.plain_sections(docs)
    paras = units.paragraphs(secs)
    return docs, secs, paras, units.sentences(paras)


def sentence_units(spark, d):
    docs, _, _, sents = _plain_units(spark, d)
    return sents.join(docs.select("document_id", "doc_id"), "document_id").select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), "range_start", "range_end", "text")


def sentence_coverage(spark, d):
    docs, _, paras, sents = _plain_units(spark, d)
    at = units.sentence_coverage(paras, sents).join(docs.select("document_id", "doc_id"), "document_id")
    return at.select("doc_id", "paragraph_chars", "sentence_count", "sentence_chars", "separator_chars", "coarse_only_chars")


def token_postings(spark, d):
    docs = corpus.plain_documents(spark, d)
    return docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))


def document_frequency(spark, d):
    return token_postings(spark, d).groupBy("token").agg(F.count("*").alias("df"))


def lexical_candidates(spark, d):
    docs, secs, paras, sents = _plain_units(spark, d)
    at = lexical.candidates(secs, paras, sents).join(docs.select("document_id", "doc_id"), "document_id")
    return at.select("doc_id", F.col("source_order").cast("long").alias("source_order"), "kind", "snippet", F.size("tokens").cast("long").alias("n_tokens"))


def _queries(spark, d):
    """The first two words of each benchmark item."""
    b = corpus.table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)).alias("query"))


def _search(rank, score_digits=None):
    def run(spark, d):
        docs, secs, paras, sents = _plain_units(spark, d)
        ids = docs.select("document_id", "doc_id")
        hits = rank(lexical.candidates(secs, paras, sents), _queries(spark, d)).join(ids, "document_id")
        return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "kind", "doc_id", F.col("source_order").cast("long").alias("source_order"), F.round("score", 6).alias("score"))

    return run


def search_all_tokens(spark, d):
    docs, secs, paras, sents = _plain_units(spark, d)
    hits = lexical.matches(lexical.candidates(secs, paras, sents), _queries(spark, d)).join(docs.select("document_id", "doc_id"), "document_id")
    return hits.groupBy("query_id", "kind").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


search_rank_phrase = _search(lexical.rank_phrase)
search_rank_bm25 = _search(lexical.rank_bm25)


def text_unit_page(spark, d):
    """The second page of ten sentences of each document, within 600 characters."""
    docs, _, _, sents = _plain_units(spark, d)
    items = sents.select("document_id", (F.col("source_order")).alias("index"), "text")
    got = paging.page(items, ["document_id"], F.lit(10), 10, 600)
    return got.join(docs.select("document_id", "doc_id"), "document_id").select("doc_id", F.col("index").cast("long").alias("position"), "text")


def text_unit_page_backward(spark, d):
    docs, _, _, sents = _plain_units(spark, d)
    items = sents.select("document_id", (F.col("source_order")).alias("index"), "text")
    got = paging.page(items, ["document_id"], F.lit(15), 5, 400, forward=False)
    return got.join(docs.select("document_id", "doc_id"), "document_id").select("doc_id", F.col("index").cast("long").alias("position"), "text")


def atomic_item_budget(spark, d):
    docs, _, _, sents = _plain_units(spark, d)
    got = paging.atomic_budget(sents.select("document_id", "text"), ["document_id"], 2000)
    return got.join(docs.select("document_id", "doc_id"), "document_id").select("doc_id", F.col("longest").cast("long").alias("longest"), F.col("total").cast("long").alias("total"), "fits")


def _chats(spark, d):
    """sections, paragraphs, sentences and documents (with hashes) of the joined conversations."""
    s = corpus.joined_chats(spark, d)
    docs = s.select("document_id", ident.content_hash(F.col("content")).alias("content_hash")).join(corpus.hashes(s), "document_id")
    paras = units.paragraphs(s)
    return s, paras, units.sentences(paras), docs


_LONGS = {"index", "paragraph_index", "sentence_index", "anchor_index", "anchor_sentence_index", "offset", "source_order"}


def _flat(df, *names):
    return df.select(*[F.col(n).cast("long").alias(n) if n in _LONGS else F.col(n) for n in names])


def locator_resolution(spark, d):
    """Locators of sections, ranges, paragraphs and sentences, sound and spoilt in several ways."""
    s, paras, sents, docs = _chats(spark, d)
    none = F.lit(None)
    found = [
        sents.select("document_id", "section_id", "paragraph_index", "sentence_index", "range_start", "range_end", (F.col("paragraph_index") + F.col("sentence_index")).alias("k")),
        paras.select("document_id", "section_id", "paragraph_index", none.cast("int").alias("sentence_index"), "range_start", "range_end", (F.col("paragraph_index") * 5 + F.length("text")).alias("k")),
        s.select("document_id", "section_id", none.cast("int").alias("paragraph_index"), none.cast("int").alias("sentence_index"), F.lit(3).cast("long").alias("range_start"), F.char_length("content").cast("long").alias("range_end"), F.char_length("content").alias("k")),
        s.select("document_id", "section_id", none.cast("int").alias("paragraph_index"), none.cast("int").alias("sentence_index"), none.cast("long").alias("range_start"), none.cast("long").alias("range_end"), (F.char_length("content") * 3).alias("k")),
    ]
    at = found[0]
    for more in found[1:]:
        at = at.unionByName(more)
    case = F.col("k") % 8
    unit = F.col("paragraph_index").isNotNull()
    spoilt = at.join(docs, "document_id").select(
        F.when(case == 1, F.concat(F.lit("no "), F.col("document_id"))).otherwise(F.col("document_id")).alias("document_id"),
        F.when(case == 2, "sha256:other").otherwise(F.col("content_hash")).alias("content_hash"), F.when(case == 3, "nd1:other").otherwise(F.col("normalized_hash")).alias("normalized_hash"),
        F.when(case == 4, "section://none").otherwise(F.col("section_id")).alias("section_id"),
        F.when(unit & (case == 5), F.col("paragraph_index") + 1).otherwise(F.col("paragraph_index")).cast("int").alias("paragraph_index"), "sentence_index",
        "range_start", F.when(case == 6, F.col("range_end") + 1).otherwise(F.col("range_end")).alias("range_end"),
        F.when(unit, F.when(case == 7, "other").otherwise(ident.SEGMENTATION)).alias("segmentation"), "k",
    )
    got = locate.resolve(spoilt, docs, s, paras, sents)
    return got.groupBy("document_id", "kind", "verdict", (F.col("k") % 8).cast("long").alias("spoilt")).agg(F.count("*").alias("locators"))


def sentence_ids(spark, d):
    s, _, sents, docs = _chats(spark, d)
    return _flat(units.with_sentence_ids(sents, docs), "document_id", "paragraph_index", "sentence_index", "source_order", "unit_id")


def text_unit_stream(spark, d):
    """The sentences of conversations, with code and tables whole in their places."""
    _, paras, sents, _ = _chats(spark, d)
    return _flat(streams.stream(paras, sents).fillna(0, ["sentence_index"]), "document_id", "index", "paragraph_index", "sentence_index", "effective_kind", "content_class", "degradation", "range_start", "range_end")


def enumeration_coverage(spark, d):
    s, paras, sents, _ = _chats(spark, d)
    return streams.coverage(s, paras, sents).drop("section_id")


def coverage_policy_skip(spark, d):
    s, paras, sents, _ = _chats(spark, d)
    return streams.coverage(s, paras, sents, "paragraph", "eligible_only").drop("section_id")


def _anchored(forward):
    def run(spark, d):
        _, paras, sents, _ = _chats(spark, d)
        items = streams.stream(paras, sents)
        got = streams.anchored(items, items.where("index % 7 = 3"), 4, 300, forward)
        return _flat(got, "document_id", "anchor_index", "index", "effective_kind", "range_start", "range_end")

    return run


text_units_page_anchored = _anchored(True)
text_units_page_anchored_backward = _anchored(False)


def neighbors_sentence(spark, d):
    _, paras, sents, _ = _chats(spark, d)
    items = streams.stream(paras, sents, labels=streams.CONTEXT)
    return _flat(streams.neighbours(items, 1, 2), "document_id", "anchor_index", "offset", "role", "effective_kind", "degradation", "range_start")


def neighbors_paragraph(spark, d):
    _, paras, sents, _ = _chats(spark, d)
    return _flat(streams.neighbours(streams.stream(paras, sents, "paragraph"), 2, 1), "document_id", "anchor_index", "offset", "role", "content_class", "range_start", "range_end")


def container_paragraph(spark, d):
    _, paras, sents, _ = _chats(spark, d)
    return _flat(streams.container_paragraphs(sents, paras), "document_id", "paragraph_index", "anchor_sentence_index", "range_start", "range_end", "role", "content_class")


def container_section(spark, d):
    s, _, sents, _ = _chats(spark, d)
    at = streams.container_sections(sents, s.select("document_id", "section_id", "title", "content"))
    return at.groupBy("document_id", "title", "role").agg(F.count("*").alias("sentences"), F.max(F.char_length("content")).cast("long").alias("chars"))


def context_budget(spark, d):
    """Which windows of sentences fit into 400 characters."""
    _, paras, sents, _ = _chats(spark, d)
    got = streams.within_budget(streams.neighbours(streams.stream(paras, sents), 1, 1), ["document_id", "anchor_index"], 400)
    return _flat(got, "document_id", "anchor_index", "items", "chars", "fits")


def read_pages_concat(spark, d):
    """All pages of 300 characters of each document, joined again."""
    docs = corpus.plain_documents(spark, d)
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(300))
    pages = docs.select("doc_id", "text", F.explode(starts).alias("at")).select("doc_id", "at", paging.text_page(F.col("text"), F.col("at"), 300).alias("p"))
    whole = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("at", "p.content"))).alias("c"), F.count(F.when(F.col("p.complete"), 1)).alias("complete"))
    return whole.select("doc_id", "pages", "complete", F.sha2(F.array_join(F.transform("c", lambda x: x["content"]), "").cast("binary"), 256).alias("text_sha256"))


def markdown_headings(spark, d):
    s = corpus.deep_sections(spark, d)
    return s.select("source", F.col("dfs_order").cast("long").alias("dfs_order"), F.col("level").cast("long").alias("level"), "title")


def markdown_section_bodies(spark, d):
    s = corpus.deep_sections(spark, d)
    return s.select("source", F.col("dfs_order").cast("long").alias("dfs_order"), "content")


def deep_section_catalog(spark, d):
    """Ids by slugs of the titles' path, numbered where they repeat, and places in the tree."""
    s = corpus.deep_sections(spark, d)
    return s.select("source", "section_id", "parent_id", *[F.col(c).cast("long").alias(c) for c in ("dfs_order", "depth", "child_count", "subtree_size")])


def deep_ancestors(spark, d):
    s = corpus.deep_sections(spark, d)
    return tree.ancestors(s).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", F.col("position").cast("long").alias("position"), "ancestor_id")


def deep_siblings(spark, d):
    s = corpus.deep_sections(spark, d)
    return tree.siblings(s).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", "sibling_id")


def deep_outline(spark, d):
    """The first five sections of two levels of each tree, and whether there are more."""
    s = corpus.deep_sections(spark, d)
    return tree.outline(s, max_depth=2, budget=5).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", F.col("rank").cast("long").alias("rank"), "truncated")


def deep_render(spark, d):
    """Every section with all below it."""
    s = corpus.deep_sections(spark, d)
    return tree.render(s, s.select("document_id", "section_id")).join(s.select("document_id", "source").distinct(), "document_id").select("source", "section_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


def sibling_order(spark, d):
    s = corpus.deep_sections(spark, d)
    return tree.in_source_order(s).select("source", "section_id", F.col("place").cast("long").alias("place"))


def enriched_tree(spark, d):
    """Places in the tree worked out from parents alone, for tables that no parser has made."""
    s = corpus.deep_sections(spark, d).drop("depth", "ancestor_ids", "child_count", "subtree_size")
    at = tree.enrich(s)
    return at.select("source", "section_id", F.size("ancestor_ids").cast("long").alias("ancestors"), *[F.col(c).cast("long").alias(c) for c in ("depth", "child_count", "subtree_size")])


def _spoilt_blocks(spark, d):
    """A block for each paragraph of the conversations; the second of each is spoilt in a way of its own."""
    s, paras, _, _ = _chats(spark, d)
    case = F.when(F.col("paragraph_index") == 2, F.substring("document_id", 6, 20).cast("long") % 9).otherwise(0)
    lo, hi = F.col("range_start"), F.col("range_end")
    b = paras.select(
        "document_id", F.when(case == 2, "section://none").otherwise(F.col("section_id")).alias("section_id"), (F.col("paragraph_index") + F.when(case == 3, 1).otherwise(0)).cast("int").alias("block_index"),
        (F.col("paragraph_index") - 1 + F.when(case == 1, 1000).otherwise(0)).cast("int").alias("source_order"), F.when(case == 4, "picture").otherwise("paragraph").alias("kind"),
        F.when(case == 5, hi + 1).when(case == 7, hi).when(case == 8, lo - 3).otherwise(lo).alias("range_start"), F.when(case == 6, hi + 100_000).otherwise(hi).alias("range_end"),
    )
    return s, paras, b


def block_map_violations(spark, d):
    s, _, b = _spoilt_blocks(spark, d)
    return blocks.problems(b, s).select("document_id", F.col("source_order").cast("long").alias("source_order"), "error")


def block_paragraph_match(spark, d):
    _, paras, b = _spoilt_blocks(spark, d)
    return blocks.exact_matches(b, paras)


def range_overlap_semi(spark, d):
    """Sentences that overlap characters 100 to 200 or 350 to 360, as if these were preformatted or a table."""
    s, _, sents, _ = _chats(spark, d)
    at = s.select("document_id", "section_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).cast("long").alias("range_start"), F.lit(b).cast("long").alias("range_end")) for k, a, b in (("preformatted", 100, 200), ("table", 350, 360), ("paragraph", 0, 90))])).alias("b"))
    got = blocks.overlapping(sents, at.select("document_id", "section_id", "b.*"))
    return _flat(got, "document_id", "paragraph_index", "sentence_index", "range_start", "range_end")


def cjk_tokens(spark, d):
    """Unigrams and bigrams: documents' numbers written as CJK, beside Latin words."""
    docs = corpus.table(spark, d, "documents").select("doc_id", F.concat(F.lit("Id: "), F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三四五六七八九"), F.lit(", read-only; 第一章。")).alias("text"))
    return docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))


def _urls(spark, d):
    """Pages' URLs, and others of a kind by page."""
    case, n = F.col("page_id") % 16, F.col("page_id").cast("string")
    rest = F.regexp_replace("url", r"^[a-z]+://[^/]*", "")
    odd = [("http://127.0.0.1", ""), ("https://10.1.2.3:8080", ""), ("http://user:pw@example.com", ""), ("ftp://example.com", ""), ("https://LOCALHOST", ""), ("http://printer.local", ""), ("https://8.8.8.8", ""), ("http://172.20.0.1", ""), ("http://2130706433", ""), ("https://example.com.", "x"), ("http://[::1]", ""), ("https://host:99/a.PDF?x=.md", "")]
    url = F.col("url")
    for k, (top, _) in enumerate(odd, 1):
        url = F.when(case == k, F.concat(F.lit(top), rest) if "PDF" not in top else F.lit(top)).otherwise(url)
    return corpus.table(spark, d, "pages").select("page_id", url.alias("url"), n.alias("n"))


def url_policy_verdicts(spark, d):
    u = _urls(spark, d)
    return u.select("page_id", "url", files.host_of(F.col("url")).alias("host"), files.url_verdict(F.col("url")).alias("verdict"))


def host_allowlist(spark, d):
    host = files.host_of(F.col("url"))
    return _urls(spark, d).select("page_id", files.host_allowed(host, ["*.example.com", "EXAMPLE.com", "*.example.org"]).alias("allowed"), files.is_http(F.col("url")).alias("http"))


def media_type_routing(spark, d):
    """Media types by suffix and by what a server declares."""
    declared = F.element_at(F.array(F.lit(None).cast("string"), F.lit("Text/HTML; charset=utf-8"), F.lit("application/octet-stream"), F.lit("image/png")), (F.col("page_id") % 4 + 1).cast("int"))
    kind = files.media_type_of_url(F.col("url"), declared)
    return _urls(spark, d).select("page_id", kind.alias("media_type"), files.fetch_allowed(kind).alias("allowed"))


def replace_by_document(spark, d):
    """Every third document in a second version, and every seventh gone."""
    docs = corpus.plain_documents(spark, d).select("doc_id", "document_id", "text")
    ids = docs.where("doc_id % 3 = 0 or doc_id % 7 = 0").select("document_id")
    new = docs.where("doc_id % 3 = 0 and doc_id % 7 <> 0").withColumn("text", F.concat("text", F.lit(" again")))
    return store.replaced(docs, new, ids).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def rebuild_missing_index(spark, d):
    """Documents without an index or with one of another version."""
    docs = corpus.plain_documents(spark, d).select("doc_id", "document_id")
    indexed = docs.where("doc_id % 5 <> 0").select("document_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise("new").alias("versions"))
    return store.stale(docs, indexed, "new").join(docs, "document_id").select("doc_id")


def html_documents(spark, d):
    p = corpus.html_pages(spark, d)
    return router.documents(p).select("source", "title", F.try_element_at("metadata", F.lit("html_title")).alias("html_title"), F.col("section_count").cast("long").alias("section_count"), "has_blocks")


def html_titles(spark, d):
    p = corpus.html_pages(spark, d)
    return router.documents(p).select("source", F.try_element_at("metadata", F.lit("html_title")).alias("html_title"), "content_hash")


def html_sections(spark, d):
    p = corpus.html_pages(spark, d)
    docs = router.documents(p).select("document_id", "source")
    return router.sections(p).join(docs, "document_id").select("source", "dfs_order", "section_id", "parent_id", "title", "level", "content")


def html_paragraphs(spark, d):
    p = corpus.html_pages(spark, d)
    docs = router.documents(p).select("document_id", "source")
    return units.paragraphs(router.sections(p), router.blocks(p)).join(docs, "document_id").select("source", "section_id", "paragraph_index", "range_start", "range_end", "native_kind", "content_class", "text")


def html_block_checks(spark, d):
    """Blocks that are exactly a paragraph, and the first problem of each block map; none is due."""
    p = corpus.html_pages(spark, d)
    docs, secs, b = router.documents(p).select("document_id", "source"), router.sections(p), router.blocks(p)
    exact = blocks.exact_matches(b, units.paragraphs(secs, b))
    wrong = blocks.problems(b, secs).select("document_id", "error")
    return docs.join(exact, "document_id").join(wrong, "document_id", "left").select("source", "exact", "inexact", "error")


def html_coverage(spark, d):
    p = corpus.html_pages(spark, d)
    secs = router.sections(p)
    cov = units.paragraph_coverage(secs, units.paragraphs(secs, router.blocks(p)))
    return cov.join(router.documents(p).select("document_id", "source"), "document_id").drop("document_id")


def json_properties(spark, d):
    """Members of JSON strings through VARIANT."""
    e = corpus.table(spark, d, "events")
    at = e.select(F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
    return at.groupBy("k").agg(F.count("*").alias("events"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        ingest_document_identity, normalized_hash_flat, normalized_hash_tree, section_catalog, section_count_budget, outline_depth_limited, outline_first_n,
        ancestors, children, siblings, section_neighbours, render_section_tree, read_page, read_pages_concat, paragraph_units, paragraph_coverage, paragraph_ids, exact_slice_roundtrip,
        paragraph_content_class, paragraph_classes, sentence_units, sentence_coverage, sentence_ids, token_postings, document_frequency, cjk_tokens, lexical_candidates, search_all_tokens,
        text_unit_page, text_unit_page_backward, atomic_item_budget, locator_resolution, text_unit_stream, enumeration_coverage, coverage_policy_skip, neighbors_sentence, neighbors_paragraph,
        container_paragraph, container_section, context_budget, markdown_headings, markdown_section_bodies, deep_section_catalog, deep_ancestors, deep_siblings, deep_outline, deep_render,
        sibling_order, enriched_tree, block_map_violations, block_paragraph_match, range_overlap_semi, url_policy_verdicts, host_allowlist, media_type_routing, replace_by_document,
        rebuild_missing_index, html_documents, html_titles, html_sections, html_paragraphs, html_block_checks, html_coverage, json_properties,
    )
} | {
    "search_rank_phrase": search_rank_phrase, "search_rank_bm25": search_rank_bm25,
    "text_units_page_anchored": text_units_page_anchored, "text_units_page_anchored_backward": text_units_page_anchored_backward,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest, segmentation, index and ranking in one plan without Python."""
    return search_rank_phrase(spark, sf_dir)
