"""Declared streams of units in a section: their items, coverage, pages from an anchor, and context.

A stream has the paragraphs of a section, or its sentences with paragraphs that have none (code,
tables, flat native containers) kept whole in their places. All functions work on many sections at
once; a stream is ordered within its section, which is the unit of parallel work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .units import ELIGIBLE, KEY

# Classes without sentences, and what an item says that stands for finer ones.
NON_PROSE, STRUCTURAL = ("code_block", "table", "preformatted"), ("quote", "list_item")
FLAT = "flat_native_container_no_nested_textunit_evidence"
READING = (FLAT, "requested_sentence_but_non_prose_is_paragraph_only", "requested_sentence_but_non_prose_is_paragraph_only")
CONTEXT = (FLAT, "requested_sentence_context_but_non_prose_is_paragraph_only", "requested_sentence_context_but_paragraph_is_coarse_only")
POLICIES, KINDS, DIRECTIONS = ("preserve_source", "eligible_only"), ("sentence", "paragraph"), ("forward", "backward")

ITEM = ["paragraph_index", "sentence_index", "range_start", "range_end", "text", "effective_kind", "content_class", "degradation"]


def coarse(content_class: Column) -> Column:
    return ~content_class.isin(*ELIGIBLE)


def reading_class(content_class: Column) -> Column:
    """What an enumeration says of a class; the class itself is its detail."""
    return F.when(content_class.isin(*NON_PROSE), "non_prose").otherwise("unknown")


def stream(paragraphs: DataFrame, sentences: DataFrame, kind: str = "sentence", policy: str = "preserve_source", labels: tuple[str, str, str] = READING) -> DataFrame:
    """The items of every section's stream with their 0-based index. labels: how items that stand for
    finer ones are marked, by structural, non-prose and other classes."""
    if kind not in KINDS or policy not in POLICIES:
        raise ValueError(f"kind is one of {KINDS}, policy one of {POLICIES}")
    c = F.col("content_class")
    why = F.when(c.isin(*STRUCTURAL), labels[0]).when(c.isin(*NON_PROSE), labels[1]).otherwise(labels[2])
    none = F.lit(None).cast("int")
    p = paragraphs.withColumn("sentence_index", none).withColumn("effective_kind", F.lit("paragraph"))
    if kind == "paragraph":
        p = p.withColumn("degradation", F.lit(None).cast("string"))
        items = p.where(~coarse(c)) if policy == "eligible_only" else p
        items = items.select(*KEY, *ITEM)
    else:
        classes = paragraphs.select(*KEY, "paragraph_index", "content_class")
        items = sentences.join(classes, [*KEY, "paragraph_index"]).withColumn("effective_kind", F.lit("sentence")).withColumn("degradation", F.lit(None).cast("string")).select(*KEY, *ITEM)
        if policy == "preserve_source":
            items = items.unionByName(p.where(coarse(c)).withColumn("degradation", why).select(*KEY, *ITEM))
    order = Window.partitionBy(*KEY).orderBy("paragraph_index", F.col("sentence_index").asc_nulls_first())
    return items.withColumn("index", F.row_number().over(order) - 1)


def coverage(sections: DataFrame, paragraphs: DataFrame, sentences: DataFrame, kind: str = "sentence", policy: str = "preserve_source") -> DataFrame:
    """What a stream represents of each section, and what it leaves out: thirteen counters and whether
    the source is complete."""
    n = F.col("range_end") - F.col("range_start")
    c = F.col("content_class")
    of_sentences = sentences.groupBy(*KEY, "paragraph_index").agg(F.count("*").alias("n_sentences"), F.sum(n).alias("sentence_chars"))
    p = paragraphs.join(of_sentences, [*KEY, "paragraph_index"], "left").fillna(0, ["n_sentences", "sentence_chars"])
    count = lambda x: F.count(F.when(x, 1))
    nothing = F.lit(False)
    skipped = coarse(c) if policy == "eligible_only" else nothing
    as_paragraph = ~skipped if kind == "paragraph" else coarse(c) & ~skipped
    by_sentence = F.lit(kind == "sentence")
    sums = p.groupBy(*KEY).agg(
        F.sum(n).alias("paragraph_chars"), F.count("*").alias("paragraph_count"),
        F.sum(F.when(~coarse(c), n - F.col("sentence_chars")).otherwise(0)).alias("sentence_separator_chars"),
        count(~coarse(c)).alias("sentence_eligible_paragraphs"), count(c.isin(*NON_PROSE)).alias("non_prose_paragraphs"), count(c.isin(*STRUCTURAL)).alias("coarse_structural_paragraphs"),
        count(as_paragraph).alias("represented_paragraphs"), F.sum(F.when(by_sentence & ~coarse(c), F.col("n_sentences")).otherwise(0)).alias("represented_sentences"),
        count(by_sentence & ~skipped & coarse(c) & ~c.isin(*STRUCTURAL)).alias("coarse_non_prose_items"), count(by_sentence & ~skipped & c.isin(*STRUCTURAL)).alias("coarse_structural_items"),
        count(skipped).alias("intentionally_skipped"),
    )
    names = [x for x in sums.columns if x not in KEY]
    at = sections.select(*KEY, F.char_length("content").cast("long").alias("owner_chars")).join(sums, KEY, "left").fillna(0, names)
    at = at.withColumn("section_separator_chars", F.col("owner_chars") - F.col("paragraph_chars")).withColumn("unsupported_gaps", F.lit(0).cast("long")).drop("paragraph_chars")
    return at.withColumn("source_complete", F.lit(policy == "preserve_source") & (F.col("intentionally_skipped") == 0))


def anchored(items: DataFrame, anchors: DataFrame, max_items: int, max_chars: int, forward: bool = True) -> DataFrame:
    """For each anchor (KEY, paragraph_index, sentence_index), the page of its stream after it, or before
    it; the anchor itself is left out. Whole items only, while their characters add up to max_chars."""
    names = ["paragraph_index", "sentence_index"]
    a = anchors.select(*[F.col(k).alias(f"_{k}") for k in KEY], *[F.col(x).alias(f"anchor_{x}") for x in names])
    same = [F.col(k) == F.col(f"_{k}") for k in KEY] + [F.col(x).eqNullSafe(F.col(f"anchor_{x}")) for x in names]
    at = items.select(*KEY, *names, F.col("index").alias("anchor_index")).join(a, same).drop(*names)
    there = (F.col("index") > F.col("anchor_index")) & (F.col("index") <= F.col("anchor_index") + max_items)
    before = (F.col("index") < F.col("anchor_index")) & (F.col("index") >= F.col("anchor_index") - max_items)
    due = at.select(*[f"_{k}" for k in KEY], "anchor_index", *[f"anchor_{x}" for x in names]).join(items, [F.col(k) == F.col(f"_{k}") for k in KEY]).where(there if forward else before).drop(*[f"_{k}" for k in KEY])
    by = Window.partitionBy(*KEY, "anchor_index").orderBy(F.col("index") if forward else F.desc("index"))
    return due.withColumn("_sum", F.sum(F.char_length("text")).over(by)).where(F.col("_sum") <= max_chars).drop("_sum")


def neighbours(items: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """For every item of a stream as anchor, the items up to `before` ahead of it and `after` behind it,
    with roles; a window never leaves its section."""
    names = ["paragraph_index", "sentence_index"]
    anchor = items.select(*KEY, *[F.col(x).alias(f"anchor_{x}") for x in names], F.col("index").alias("anchor_index"))
    at = anchor.select("*", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("index", F.col("anchor_index") + F.col("offset"))
    role = F.when(F.col("offset") < 0, "before").when(F.col("offset") > 0, "after").otherwise("anchor")
    return at.join(items, [*KEY, "index"]).withColumn("role", role)


def container_paragraphs(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraph around each of units (KEY, paragraph_index, sentence_index), as a context item."""
    p = paragraphs.select(*KEY, "paragraph_index", "range_start", "range_end", "text", "content_class")
    u = units.select(*KEY, "paragraph_index", F.col("sentence_index").alias("anchor_sentence_index"))
    return u.join(p, [*KEY, "paragraph_index"]).withColumn("role", F.lit("container")).withColumn("effective_kind", F.lit("paragraph"))


def container_sections(units: DataFrame, sections: DataFrame) -> DataFrame:
    """The section around each of units (KEY, ...): its title, and as content its own text without what
    lies below it."""
    s = sections.select(*KEY, "title", F.regexp_replace("content", r"(?U)^\s+|\s+$", "").alias("content"))
    return units.join(s, KEY).withColumn("role", F.lit("container")).withColumn("effective_kind", F.lit("section"))


def within_budget(items: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Whether the items of each context fit into a response: none is cut."""
    sums = items.groupBy(*by).agg(F.count("*").alias("items"), (F.sum(F.char_length("text")) + 2 * (F.count("*") - 1)).alias("chars"))
    return sums.withColumn("fits", F.col("chars") <= limit)
