"""Paragraphs, sentences and their coverage, from sections(document_id, section_id, dfs_order, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ident, text

KEY = ["document_id", "section_id"]
ELIGIBLE = ("prose_or_unknown", "native_paragraph")

#: Native kinds and the class they give a paragraph of exactly their range.
NATIVE_CLASS = {"paragraph": "native_paragraph", "blockquote": "quote", "list_item": "list_item", "preformatted": "preformatted", "table": "table"}


def paragraph_ranges(sections: DataFrame) -> DataFrame:
    """document_id, section_id, dfs_order, start, end, text: runs of lines that aren't blank (gaps and
    islands), each put together again from its lines."""
    lines = sections.select(*KEY, "dfs_order", F.posexplode(F.split("content", "\n")).alias("line", "said"))
    by = Window.partitionBy(*KEY).orderBy("line")
    lines = lines.withColumn("start", F.sum(F.char_length("said") + 1).over(by) - F.char_length("said") - 1)
    lines = lines.withColumn("blank", ~F.col("said").rlike(r"(?U)\S")).withColumn("island", F.sum(F.col("blank").cast("int")).over(by))
    found = lines.where(~F.col("blank")).groupBy(*KEY, "dfs_order", "island").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("line", "said"))).alias("lines"))
    text_of = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["said"]), "\n"), r"\r$", "")
    return found.select(*KEY, "dfs_order", "start", text_of.alias("text")).withColumn("end", F.col("start") + F.char_length("text"))


def number_paragraphs(ranges: DataFrame) -> DataFrame:
    """Ranges with their 1-based index in the section and 0-based order in the document."""
    return ranges.select(
        *KEY, "dfs_order",
        F.row_number().over(Window.partitionBy(*KEY).orderBy("start")).alias("paragraph_index"),
        (F.row_number().over(Window.partitionBy("document_id").orderBy("dfs_order", "start")) - 1).alias("source_order"),
        F.col("start").cast("long").alias("range_start"), F.col("end").cast("long").alias("range_end"), "text",
        *[c for c in ranges.columns if c in ("native_kind",)],
    )


def paragraphs(sections: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """All paragraphs: native blocks where a section has them, gaps between them and other sections by lines."""
    if blocks is None:
        out = number_paragraphs(paragraph_ranges(sections)).withColumn("native_kind", F.lit(None).cast("string"))
    else:
        native = blocks.select(*KEY, F.col("range_start").alias("start"), F.col("range_end").alias("end"), F.col("kind").alias("native_kind"))
        by = Window.partitionBy(*KEY).orderBy("start")
        ends = native.select(*KEY, F.coalesce(F.lag("end").over(by), F.lit(0)).alias("gap_start"), F.col("start").alias("gap_end"))
        tails = native.groupBy(*KEY).agg(F.max("end").alias("gap_start")).join(sections.select(*KEY, F.char_length("content").alias("gap_end")), KEY)
        gaps = ends.unionByName(tails).where("gap_start < gap_end")
        bare = sections.join(native.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit(0).alias("gap_start"), F.char_length("content").alias("gap_end"))
        spans = gaps.unionByName(bare).join(sections.select(*KEY, "dfs_order", "content"), KEY)
        slices = spans.select("document_id", F.concat_ws("\x00", "section_id", F.col("gap_start").cast("string")).alias("section_id"), "dfs_order", F.substring("content", F.col("gap_start").cast("int") + 1, (F.col("gap_end") - F.col("gap_start")).cast("int")).alias("content"))
        found = paragraph_ranges(slices)
        base = F.element_at(F.split("section_id", "\x00"), -1).cast("long")
        fallback = found.select("document_id", F.element_at(F.split("section_id", "\x00"), 1).alias("section_id"), "dfs_order", (F.col("start") + base).alias("start"), (F.col("end") + base).alias("end"), "text", F.lit(None).cast("string").alias("native_kind"))
        slice_of = F.substring("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
        own = native.join(sections.select(*KEY, "dfs_order", "content"), KEY).select(*KEY, "dfs_order", "start", "end", slice_of.alias("text"), "native_kind")
        out = number_paragraphs(own.unionByName(fallback))
    classes = F.create_map(*[F.lit(x) for pair in NATIVE_CLASS.items() for x in pair])
    return out.withColumn("content_class", F.coalesce(classes[F.col("native_kind")], text.fallback_class(F.col("text"))))


def with_paragraph_ids(units: DataFrame, normalized: DataFrame) -> DataFrame:
    """Paragraphs with unit ids; normalized(document_id, normalized_hash)."""
    at = units.join(normalized.select("document_id", "normalized_hash"), "document_id")
    c = F.col
    return at.withColumn("unit_id", ident.unit_id(c("document_id"), c("normalized_hash"), c("section_id"), "paragraph", [c("paragraph_index")], c("range_start"), c("range_end")))


def sentences(paras: DataFrame) -> DataFrame:
    """Sentences of eligible paragraphs, with ranges in their section."""
    c = F.col
    p = paras.where(c("content_class").isin(*ELIGIBLE)).select(*KEY, "dfs_order", "paragraph_index", c("range_start").alias("base"), F.posexplode(text.sentence_pieces(c("text"))).alias("k", "piece"))
    by = Window.partitionBy(*KEY, "paragraph_index").orderBy("k")
    p = p.withColumn("at", F.sum(F.char_length("piece")).over(by) - F.char_length("piece")).withColumn("text", text.trim_unicode(c("piece"))).where("text <> ''")
    start = c("base") + c("at") + text.leading(c("piece"))
    p = p.withColumn("range_start", start.cast("long")).withColumn("range_end", (start + F.char_length("text")).cast("long"))
    return p.select(
        *KEY, "dfs_order", "paragraph_index", F.row_number().over(by).alias("sentence_index"),
        (F.row_number().over(Window.partitionBy("document_id").orderBy("dfs_order", "paragraph_index", "k")) - 1).alias("source_order"),
        "range_start", "range_end", "text",
    )


def with_sentence_ids(units: DataFrame, normalized: DataFrame) -> DataFrame:
    at = units.join(normalized.select("document_id", "normalized_hash"), "document_id")
    c = F.col
    return at.withColumn("unit_id", ident.unit_id(c("document_id"), c("normalized_hash"), c("section_id"), "sentence", [c("paragraph_index"), c("sentence_index")], c("range_start"), c("range_end")))


def paragraph_coverage(sections: DataFrame, paras: DataFrame) -> DataFrame:
    """How a section's characters divide into paragraphs (by where their bounds come from) and separators."""
    n = F.col("range_end") - F.col("range_start")
    native, kind = F.col("native_kind").isNotNull(), F.col("native_kind")
    sums = paras.groupBy(*KEY).agg(
        F.count("*").alias("paragraph_count"), F.sum(n).alias("paragraph_chars"),
        F.sum(F.when(kind == "paragraph", n).otherwise(0)).alias("native_paragraph_chars"),
        F.sum(F.when(kind.isin("blockquote", "list_item"), n).otherwise(0)).alias("structural_chars"),
        F.sum(F.when(kind.isin("preformatted", "table"), n).otherwise(0)).alias("non_prose_chars"),
        F.sum(F.when(~native, n).otherwise(0)).alias("fallback_chars"),
    )
    counts = [c for c in sums.columns if c not in KEY]
    at = sections.select(*KEY, F.char_length("content").cast("long").alias("owner_chars")).join(sums, KEY, "left").fillna(0, counts)
    return at.withColumn("separator_chars", F.col("owner_chars") - F.col("paragraph_chars"))


def sentence_coverage(paras: DataFrame, sents: DataFrame) -> DataFrame:
    """How a paragraph's characters divide into sentences, separators and text kept whole."""
    key = [*KEY, "paragraph_index"]
    n = F.col("range_end") - F.col("range_start")
    sums = sents.groupBy(*key).agg(F.count("*").alias("sentence_count"), F.sum(n).alias("sentence_chars"))
    at = paras.select(*key, n.alias("paragraph_chars"), "content_class").join(sums, key, "left").fillna(0, ["sentence_count", "sentence_chars"])
    whole = F.when(F.col("content_class").isin(*ELIGIBLE), F.lit(0)).otherwise(F.col("paragraph_chars"))
    return at.withColumn("coarse_only_chars", whole.cast("long")).withColumn("separator_chars", F.col("paragraph_chars") - F.col("sentence_chars") - F.col("coarse_only_chars"))
