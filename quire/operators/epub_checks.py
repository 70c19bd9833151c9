"""Checks of parsed EPUB documents against their own facts: navigation, spine, structure, blocks and units.

Every check is a condition over rows of a table, so that all documents are checked at once. A finding is
an error, which makes a document unsound, or a degradation, which says what the source itself lacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as block_checks
from . import units as unit_checks

KEY = ["document_id", "section_id"]
ERROR, DEGRADATION = "error", "degradation"
_SPINE = "array<struct<spine_index:int,idref:string,linear:boolean,status:string>>"
_NODES = "struct<kind:string,nodes:array<struct<order:int,depth:int,parent:int,label:string,href:string,status:string,path:string,fragment:string,section_id:string>>>"

# What a navigation target's or a spine item's status is reported as.
TARGETS = {
    "missing_fragment": "navigation_target_missing_fragment", "missing_resource": "navigation_target_missing_resource", "unsupported_resource": "navigation_target_unsupported_resource",
    "invalid_path": "navigation_target_invalid_path", "malformed_resource": "navigation_target_malformed_resource", "unlinked": "navigation_node_unlinked",
}
SPINE = {"missing_manifest": "spine_missing_manifest_item", "unsupported_media": "spine_unsupported_media"}
RESOLVED = ("resolved_document", "resolved_fragment")
#: Steps to a root after which a section must lie in a circle: more than any document may be deep.
STEPS = 64


@dataclass
class Epubs:
    """The tables of parsed documents; all have document_id."""

    documents: DataFrame
    sections: DataFrame
    blocks: DataFrame
    paragraphs: DataFrame
    sentences: DataFrame


def _meta(name: str) -> Column:
    return F.try_element_at("metadata", F.lit(name))


def spine_facts(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", F.inline(F.from_json(_meta("epub_spine"), _SPINE)))


def nav_nodes(documents: DataFrame) -> DataFrame:
    at = documents.select("document_id", F.from_json(_meta("epub_navigation"), _NODES).alias("n"))
    return at.select("document_id", F.inline("n.nodes")).withColumnRenamed("order", "node")


def _named(plane: str, severity: str, rules: dict[str, Column], at: Column) -> Column:
    """The findings of a row, as an array."""
    found = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(plane).alias("plane"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), at.cast("string").alias("at"))) for code, c in rules.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _findings(rows: DataFrame, plane: str, severity: str, rules: dict[str, Column], at: Column) -> DataFrame:
    return rows.select("document_id", F.inline(_named(plane, severity, rules, at)))


def _place(*of: str):
    return lambda order: F.row_number().over(Window.partitionBy(*of).orderBy(order))


def navigation_findings(documents: DataFrame) -> DataFrame:
    c = F.col
    read = F.from_json(_meta("epub_navigation"), _NODES)
    maps = _findings(documents, "navigation", ERROR, {"missing_navigation_map": _meta("epub_navigation").isNull(), "invalid_navigation_map_json": _meta("epub_navigation").isNotNull() & read["nodes"].isNull()}, F.lit(None))
    nodes = nav_nodes(documents)
    up = nodes.select("document_id", c("node").alias("parent"), c("depth").alias("_up"))
    at = nodes.join(up, ["document_id", "parent"], "left").withColumn("due", _place("document_id")("node") - 1)
    errors = {
        "navigation_source_order_gap": c("node") != c("due"),
        "resolved_document_without_path": c("status").isin(*RESOLVED) & c("path").isNull(),
        "resolved_fragment_without_evidence": (c("status") == "resolved_fragment") & c("fragment").isNull(),
        "navigation_depth_mismatch": c("depth") != F.coalesce(c("_up"), F.lit(0)) + 1,
    }
    more = {code: c("status") == status for status, code in TARGETS.items()}
    notes = documents.select("document_id", F.explode(F.from_json(_meta("epub_diagnostics"), "array<string>")).alias("code"))
    passed = notes.select("document_id", F.lit("navigation").alias("plane"), F.lit(DEGRADATION).alias("severity"), "code", F.lit(None).cast("string").alias("at"))
    return maps.unionByName(_findings(at, "navigation", ERROR, errors, c("node"))).unionByName(_findings(at, "navigation", DEGRADATION, more, c("node"))).unionByName(passed)


def spine_findings(documents: DataFrame, sections: DataFrame) -> DataFrame:
    c = F.col
    facts = spine_facts(documents)
    at = facts.withColumn("due", _place("document_id")("spine_index"))
    out = _findings(at, "spine", ERROR, {"spine_index_gap": c("spine_index") != c("due")}, c("spine_index"))
    out = out.unionByName(_findings(at, "spine", DEGRADATION, {code: c("status") == status for status, code in SPINE.items()}, c("spine_index")))
    parsed = sections.select("document_id", spine_number().alias("spine_index")).where("spine_index is not null").distinct()
    lost = parsed.join(facts.where("status = 'parsed'").select("document_id", "spine_index"), ["document_id", "spine_index"], "left_anti")
    return out.unionByName(_findings(lost, "spine", ERROR, {"parsed_spine_missing_resolution_facts": F.lit(True)}, c("spine_index")))


def spine_number() -> Column:
    """The number of the spine item that a section comes from."""
    return F.regexp_extract("chapter", r"^spine-(\d+)$", 1).try_cast("int")


def circular(sections: DataFrame) -> DataFrame:
    """KEY of sections whose parents never end: they lie on a circle, or below one. Parents are followed
    within a document, of which a map is small."""
    parents = sections.where("parent_id is not null").groupBy("document_id").agg(F.collect_list(F.struct("section_id", "parent_id")).alias("p"))
    parents = parents.select("document_id", F.map_from_entries(F.array_distinct("p")).alias("up"))
    step = lambda at, _: F.try_element_at("up", at)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("section_id"), step)
    return sections.dropDuplicates(KEY).join(parents, "document_id").where(end.isNotNull()).select(*KEY)


def structure_findings(sections: DataFrame, documents: DataFrame) -> DataFrame:
    c = F.col
    whole = Window.partitionBy("document_id").orderBy("dfs_order")
    known = sections.select("document_id", c("section_id").alias("parent_id"), c("dfs_order").alias("_parent_order")).dropDuplicates(["document_id", "parent_id"])
    spine = spine_facts(documents).select("document_id", "spine_index", F.lit(True).alias("_spine"))
    at = sections.withColumn("spine_index", spine_number()).withColumn("due", F.row_number().over(whole) - 1)
    at = at.withColumn("_before", F.max("spine_index").over(whole.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_same", F.count("*").over(Window.partitionBy(*KEY)))
    at = at.join(known, ["document_id", "parent_id"], "left").join(spine.dropDuplicates(["document_id", "spine_index"]), ["document_id", "spine_index"], "left")
    path = F.regexp_extract("native_location", r"^epub:([^#]+)(#.*)?$", 1)
    errors = {
        "unknown_section_parent": c("parent_id").isNotNull() & c("_parent_order").isNull(),
        "duplicate_section_id": c("_same") > 1,
        "structure_source_order_gap": c("dfs_order") != c("due"),
        "structure_spine_order_regression": c("spine_index") < c("_before"),
        "section_unknown_spine_index": c("chapter").isNotNull() & (c("spine_index").isNull() | c("_spine").isNull()),
        "section_native_location_mismatch": c("chapter").isNotNull() & ((path == "") | (c("anchor").isNotNull() & ~c("native_location").endswith(F.concat(F.lit("#"), c("anchor"))))),
        "canonical_parent_not_before_child": c("_parent_order") >= c("dfs_order"),
    }
    out = _findings(at, "structure", ERROR, errors, c("section_id"))
    return out.unionByName(_findings(circular(sections), "structure", ERROR, {"section_parent_cycle": F.lit(True)}, c("section_id")))


def block_findings(e: Epubs) -> DataFrame:
    c = F.col
    out = _findings(e.documents, "blocks", ERROR, {"missing_normalized_block_map": ~c("has_blocks")}, F.lit(None))
    wrong = block_checks.problems(e.blocks, e.sections)
    out = out.unionByName(_findings(wrong, "blocks", ERROR, {"invalid_normalized_block_map": F.lit(True)}, c("error")))
    own = e.sections.select(*KEY, F.regexp_extract("native_location", r"^([^#]*)", 1).alias("_own"))
    at = e.blocks.join(own, KEY)
    out = out.unionByName(_findings(at, "blocks", ERROR, {"epub_block_native_location_mismatch": F.regexp_extract("native_location", r"^([^#]*)", 1) != c("_own")}, c("source_order")))
    bare = e.sections.where(F.col("content").rlike(r"(?U)\S")).join(e.blocks.select(*KEY).distinct(), KEY, "left_anti")
    return out.unionByName(_findings(bare, "blocks", DEGRADATION, {"nonempty_section_without_normalized_blocks": F.lit(True)}, c("section_id")))


def unit_findings(e: Epubs) -> DataFrame:
    c = F.col
    content = e.sections.select(*KEY, "content")
    slice_of = F.substring("content", c("range_start").cast("int") + 1, (c("range_end") - c("range_start")).cast("int"))
    order = Window.partitionBy("document_id").orderBy("source_order")
    p = e.paragraphs.join(content, KEY, "left").withColumn("due", F.row_number().over(order) - 1).withColumn("due_index", F.row_number().over(Window.partitionBy(*KEY).orderBy("range_start")))
    out = _findings(p, "text_units", ERROR, {
        "paragraph_source_order_gap": c("source_order") != c("due"), "paragraph_unknown_owner": c("content").isNull(),
        "paragraph_exact_slice_mismatch": slice_of != c("text"), "paragraph_index_gap": c("paragraph_index") != c("due_index"),
    }, c("source_order"))
    cov = unit_checks.paragraph_coverage(e.sections, e.paragraphs)
    parts = c("native_paragraph_chars") + c("structural_chars") + c("non_prose_chars") + c("fallback_chars")
    out = out.unionByName(_findings(cov, "text_units", ERROR, {"paragraph_coverage_invariant_failed": (parts != c("paragraph_chars")) | (c("separator_chars") < 0)}, c("section_id")))
    parent = e.paragraphs.select(*KEY, "paragraph_index", c("range_start").alias("_lo"), c("range_end").alias("_hi"))
    s = e.sentences.join(content, KEY, "left").join(parent, [*KEY, "paragraph_index"], "left").withColumn("due", F.row_number().over(order) - 1)
    s = s.withColumn("due_index", F.row_number().over(Window.partitionBy(*KEY, "paragraph_index").orderBy("range_start")))
    out = out.unionByName(_findings(s, "text_units", ERROR, {
        "sentence_source_order_gap": c("source_order") != c("due"), "sentence_unknown_owner": c("content").isNull(), "sentence_exact_slice_mismatch": slice_of != c("text"),
        "sentence_missing_parent_paragraph": c("_lo").isNull(), "sentence_outside_parent_paragraph": (c("range_start") < c("_lo")) | (c("range_end") > c("_hi")), "sentence_index_gap": c("sentence_index") != c("due_index"),
    }, c("source_order")))
    cov = unit_checks.sentence_coverage(e.paragraphs, e.sentences)
    out = out.unionByName(_findings(cov, "text_units", ERROR, {"sentence_coverage_invariant_failed": (c("separator_chars") < 0) | ((c("coarse_only_chars") > 0) & (c("sentence_count") > 0))}, c("section_id")))
    inexact = block_checks.exact_matches(e.blocks, e.paragraphs)
    out = out.unionByName(_findings(inexact, "text_units", DEGRADATION, {"native_blocks_not_exact_current_paragraphs": c("inexact") > 0}, c("inexact")))
    over = block_checks.overlapping(e.sentences, e.blocks).groupBy("document_id").agg(F.count("*").alias("n"))
    return out.unionByName(_findings(over, "text_units", DEGRADATION, {"current_sentences_overlap_native_non_prose_blocks": c("n") > 0}, c("n")))


def findings(e: Epubs) -> DataFrame:
    """(document_id, plane, severity, code, at) of everything that is wrong with, or missing from, documents."""
    parts = (navigation_findings(e.documents), spine_findings(e.documents, e.sections), structure_findings(e.sections, e.documents), block_findings(e), unit_findings(e))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Errors and degradations of every document, and whether it is sound."""
    sums = found.groupBy("document_id").agg(F.count(F.when(F.col("severity") == ERROR, 1)).alias("errors"), F.count(F.when(F.col("severity") == DEGRADATION, 1)).alias("degradations"))
    at = documents.select("document_id").join(sums, "document_id", "left").fillna(0, ["errors", "degradations"])
    return at.withColumn("sound", F.col("errors") == 0)


def coverage(e: Epubs) -> DataFrame:
    """What there is of each document, by plane: spine items (linear and not, parsed), navigation nodes by
    status and with a section, sections, blocks and units."""
    c = F.col
    count = lambda x, name: F.count(F.when(x, 1)).alias(name)
    spine = spine_facts(e.documents).groupBy("document_id").agg(F.count("*").alias("spine_items"), count(c("linear"), "linear_items"), count(~c("linear"), "non_linear_items"), count(c("status") == "parsed", "parsed_items"), *[count(c("status") == s, f"spine_{s}") for s in SPINE])
    nodes = nav_nodes(e.documents).groupBy("document_id").agg(F.count("*").alias("nodes"), count(c("status").isin(*RESOLVED), "resolved_nodes"), count(c("section_id").isNotNull(), "mapped_nodes"), *[count(c("status") == s, f"nodes_{s}") for s in TARGETS])
    secs = e.sections.groupBy("document_id").agg(F.count("*").alias("sections"), count(c("parent_id").isNull(), "roots"), F.max("level").alias("deepest"), F.sum(F.char_length("content")).alias("chars"))
    kinds = e.blocks.groupBy("document_id").agg(F.count("*").alias("blocks"), *[count(c("kind") == k, f"{k}_blocks") for k in block_checks.KINDS])
    paras = e.paragraphs.groupBy("document_id").agg(F.count("*").alias("paragraphs"), count(c("native_kind").isNotNull(), "native_paragraphs"))
    sents = e.sentences.groupBy("document_id").agg(F.count("*").alias("sentences"))
    out = e.documents.select("document_id")
    for part in (spine, nodes, secs, kinds, paras, sents):
        out = out.join(part, "document_id", "left")
    return out.fillna(0)
