"""Locators: addresses of sections, ranges, paragraphs and sentences, resolved in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.ident import SEGMENTATION

KEY = ["document_id", "section_id"]


def resolve(locators: DataFrame, documents: DataFrame, sections: DataFrame, paragraphs: DataFrame, sentences: DataFrame) -> DataFrame:
    """locators (document_id, content_hash, normalized_hash, section_id, paragraph_index,
    sentence_index, range_start, range_end, segmentation) with `kind`, `verdict` (ok, stale,
    invalid, not_found) and the resolved range. Checks come in a fixed order; the first that fails decides."""
    d = documents.select("document_id", F.col("content_hash").alias("_content"), F.col("normalized_hash").alias("_normal"))
    s = sections.select(*KEY, F.char_length("content").alias("_chars"))
    p = paragraphs.select(*KEY, "paragraph_index", F.col("range_start").alias("_p0"), F.col("range_end").alias("_p1"))
    q = sentences.select(*KEY, "paragraph_index", "sentence_index", F.col("range_start").alias("_s0"), F.col("range_end").alias("_s1"))
    at = locators.join(d, "document_id", "left").join(s, KEY, "left").join(p, [*KEY, "paragraph_index"], "left").join(q, [*KEY, "paragraph_index", "sentence_index"], "left")
    c = F.col
    para, sent, rng, seg = c("paragraph_index").isNotNull(), c("sentence_index").isNotNull(), c("range_start").isNotNull() & c("range_end").isNotNull(), c("segmentation").isNotNull()
    none = c("range_start").isNull() & c("range_end").isNull()
    kind = F.when(~para & ~sent & none & ~seg, "section").when(~para & ~sent & rng & ~seg, "character_range").when(para & ~sent & rng & seg, "paragraph").when(para & sent & rng & seg, "sentence")
    at = at.withColumn("kind", kind)
    unit = c("kind").isin("paragraph", "sentence")
    lo, hi = F.when(c("kind") == "sentence", c("_s0")).otherwise(c("_p0")), F.when(c("kind") == "sentence", c("_s1")).otherwise(c("_p1"))
    verdict = (
        F.when(c("_content").isNull(), "not_found")
        .when(c("content_hash") != c("_content"), "stale")
        .when(c("normalized_hash") != c("_normal"), "stale")
        .when(c("_chars").isNull(), "invalid")
        .when(c("kind").isNull(), "invalid")
        .when(unit & (c("segmentation") != SEGMENTATION), "stale")
        .when(unit & lo.isNull(), "invalid")
        .when(unit & ((lo != c("range_start")) | (hi != c("range_end"))), "invalid")
        .when(rng & ((c("range_start") > c("range_end")) | (c("range_end") > c("_chars"))), "invalid")
        .otherwise("ok")
    )
    return at.withColumn("verdict", verdict).drop("_content", "_normal", "_chars", "_p0", "_p1", "_s0", "_s1")


def exact_text(resolved: DataFrame, sections: DataFrame) -> DataFrame:
    """The exact text that each valid locator addresses."""
    at = resolved.where("verdict = 'ok'").join(sections.select(*KEY, "content"), KEY)
    start = F.coalesce("range_start", F.lit(0))
    end = F.coalesce("range_end", F.char_length("content"))
    return at.withColumn("text", F.substring("content", start.cast("int") + 1, (end - start).cast("int"))).drop("content")
