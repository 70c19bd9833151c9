"""Native blocks: their checks, and joins of blocks with units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["document_id", "section_id"]
KINDS = ("paragraph", "blockquote", "list_item", "preformatted", "table")


def problems(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """The first error of each document's block map, in source order; documents without errors have no row."""
    known = sections.select(*KEY, F.char_length("content").alias("chars"), F.lit(True).alias("known"))
    per, whole = Window.partitionBy(*KEY).orderBy("source_order"), Window.partitionBy("document_id").orderBy("source_order")
    at = blocks.join(known, KEY, "left").withColumn("due", F.row_number().over(whole) - 1).withColumn("due_index", F.row_number().over(per)).withColumn("before", F.lag("range_end").over(per))
    code = (
        F.when(F.col("source_order") != F.col("due"), "source_order_gap")
        .when(F.col("known").isNull(), "unknown_owner")
        .when(F.col("block_index") != F.col("due_index"), "block_index_gap")
        .when(~F.col("kind").isin(*KINDS), "unknown_kind")
        .when(F.col("range_start") > F.col("range_end"), "range_order")
        .when(F.col("range_end") > F.col("chars"), "range_out_of_bounds")
        .when(F.col("range_start") == F.col("range_end"), "empty_block")
        .when(F.col("range_start") < F.col("before"), "overlap")
    )
    return at.withColumn("error", code).where("error is not null").groupBy("document_id").agg(F.min(F.struct("source_order", "error")).alias("m")).select("document_id", "m.source_order", "m.error")


def overlapping(sentences: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sentences that overlap preformatted or table blocks of their section (a range semi-join within sections)."""
    b = blocks.where(F.col("kind").isin("preformatted", "table")).select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "range_start", "range_end")])
    same = (F.col("document_id") == F.col("_document_id")) & (F.col("section_id") == F.col("_section_id"))
    return sentences.join(b, same & (F.col("_range_start") < F.col("range_end")) & (F.col("range_start") < F.col("_range_end")), "left_semi")


def exact_matches(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """How many blocks of each document are exactly a paragraph, and how many aren't."""
    key = [*KEY, "range_start", "range_end"]
    p = paragraphs.select(*key, F.lit(True).alias("same")).distinct()
    return blocks.join(p, key, "left").groupBy("document_id").agg(F.count("same").alias("exact"), F.count(F.when(F.col("same").isNull(), 1)).alias("inexact"))


def over_budget(sections: DataFrame, max_sections: int = 20_000, max_depth: int = 32, max_chars: int = 16_000_000) -> DataFrame:
    """Counts of each document, and whether it exceeds a limit."""
    sums = sections.groupBy("document_id").agg(F.count("*").alias("section_count"), F.max("depth").alias("max_depth"), F.sum(F.char_length("content")).alias("chars"))
    return sums.withColumn("over", (F.col("section_count") > max_sections) | (F.col("max_depth") > max_depth) | (F.col("chars") > max_chars))
