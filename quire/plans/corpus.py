"""The driver's tables as resources and documents of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ident
from quire.sources import router

from .store import normalized_hashes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text resources, natively: a text is one section."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    d = d.select("doc_id", F.concat(F.lit("memory:documents/"), F.col("doc_id").cast("string")).alias("source"), "text")
    d = d.withColumn("content_hash", ident.content_hash(F.col("text")))
    return d.withColumn("document_id", ident.document_id(F.col("source"), F.col("content_hash"))).withColumn("title", F.col("source"))


def plain_sections(docs: DataFrame) -> DataFrame:
    c = F.lit
    return docs.select(
        "doc_id", "document_id", c("section://document").alias("section_id"), c(None).cast("string").alias("parent_id"), c(0).alias("dfs_order"), "title",
        c(1).alias("level"), F.col("text").alias("content"), c(0).alias("child_count"), c(1).alias("depth"),
    )


def chat_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown resource for each conversation: a heading, then a heading and the text of each turn."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null")
    said = F.concat(F.lit("## turn "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    one = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    text = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("turns", lambda x: x["said"]), ""))
    return one.select(F.concat(F.lit("memory:conversations/"), F.col("conv_id").cast("string")).alias("source"), F.lit("text/markdown").alias("media_type"), text.cast("binary").alias("bytes"), F.lit(None).cast("map<string,string>").alias("metadata"))


def chat_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of all conversations, with what tree queries need."""
    parsed = router.parse(chat_markdown(spark, sf_dir))
    key = parsed.select("source", ident.document_id(F.col("source"), F.col("content_hash")).alias("document_id"))
    return router.sections(parsed).drop("native_location", "anchor", "chapter", "page").join(key, "document_id")


def deep_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown resource for each conversation whose turns are headings of levels 1 to 4: several roots,
    levels that are skipped, and titles that repeat."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null")
    level = F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(4)) + 1
    name = F.concat(F.lit("Topic "), F.pmod(F.col("turn"), F.lit(3)).cast("string"))
    said = F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), name, F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    one = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: x["said"]), "")
    return one.select(F.concat(F.lit("memory:deep/"), F.col("conv_id").cast("string")).alias("source"), F.lit("text/markdown").alias("media_type"), text.cast("binary").alias("bytes"), F.lit(None).cast("map<string,string>").alias("metadata"))


def deep_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = router.parse(deep_markdown(spark, sf_dir))
    key = parsed.select("source", ident.document_id(F.col("source"), F.col("content_hash")).alias("document_id"))
    return router.sections(parsed).drop("native_location", "anchor", "chapter", "page").join(key, "document_id")


def joined_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one section of paragraphs: turns joined by blank lines, by their number as they
    stand, as fenced code, as a table and indented."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null")
    whole, newline = F.col("text"), F.lit("\n")
    ways = (whole, F.concat(F.lit("```\n"), whole, F.lit("\n```")), F.concat(F.lit("a | b\n--- | ---\n"), whole), F.concat(F.lit("    "), F.replace(whole, newline, F.lit("\n    "))))
    said = F.element_at(F.array(*ways), (F.pmod(F.col("turn"), F.lit(4)) + 1).cast("int"))
    one = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: x["said"]), "\n\n")
    return one.select(F.concat(F.lit("chat:"), F.col("conv_id").cast("string")).alias("document_id"), F.lit("section://document").alias("section_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("dfs_order"), F.lit("chat").alias("title"), F.lit(1).alias("level"), text.alias("content"), F.lit(0).alias("child_count"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return router.parse(p.select(F.concat(F.lit("memory:pages/"), F.col("page_id").cast("string")).alias("source"), F.lit("text/html").alias("media_type"), F.col("html").cast("binary").alias("bytes"), F.lit(None).cast("map<string,string>").alias("metadata")))


def hashes(secs: DataFrame) -> DataFrame:
    return normalized_hashes(secs)
