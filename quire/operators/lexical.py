"""The lexical index: candidates, postings and ranked search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ident, text

KIND_RANK = {"section": 0, "paragraph": 1, "sentence": 2}


def candidates(sections: DataFrame, paras: DataFrame, sents: DataFrame) -> DataFrame:
    """One row for each section title, paragraph and sentence that has tokens."""
    none = F.lit(None).cast("int")
    zero = F.lit(None).cast("long")
    s = sections.select("document_id", "section_id", "dfs_order", F.lit("section").alias("kind"), none.alias("paragraph_index"), none.alias("sentence_index"), zero.alias("range_start"), zero.alias("range_end"), F.col("title").alias("text"))
    p = paras.select("document_id", "section_id", "dfs_order", F.lit("paragraph").alias("kind"), "paragraph_index", none.alias("sentence_index"), "range_start", "range_end", "text")
    q = sents.select("document_id", "section_id", "dfs_order", F.lit("sentence").alias("kind"), "paragraph_index", "sentence_index", "range_start", "range_end", "text")
    at = s.unionByName(p).unionByName(q).withColumn("tokens", text.tokens(F.col("text"))).where("size(tokens) > 0")
    rank = F.create_map(*[F.lit(x) for pair in KIND_RANK.items() for x in pair])[F.col("kind")]
    by = Window.partitionBy("document_id").orderBy("dfs_order", rank, "paragraph_index", "sentence_index")
    return at.withColumn("source_order", F.row_number().over(by) - 1).withColumn("snippet", ident.snippet(F.col("text")))


def section_units(sections: DataFrame) -> DataFrame:
    """One unit for each section, of its title and all of its content: search by sections only."""
    none = F.lit(None)
    said = F.concat_ws("\n", "title", "content")
    at = sections.select("document_id", "section_id", "dfs_order", F.lit("section").alias("kind"), none.cast("int").alias("paragraph_index"), none.cast("int").alias("sentence_index"), none.cast("long").alias("range_start"), none.cast("long").alias("range_end"), said.alias("text"))
    at = at.withColumn("tokens", text.tokens(F.col("text"))).where("size(tokens) > 0")
    return at.withColumn("source_order", F.col("dfs_order")).withColumn("snippet", ident.snippet(F.col("text")))


def location(native: Column, kind: Column, paragraph_index: Column, sentence_index: Column) -> Column:
    """Where a unit lies: its section's own location, and its numbers in the section."""
    unit = F.when(kind != "section", F.concat(F.lit("search-unit:"), paragraph_index.cast("string")))
    return F.concat_ws("#", native, unit, F.when(kind == "sentence", F.concat(F.lit("sentence:"), sentence_index.cast("string"))))


def postings(units: DataFrame) -> DataFrame:
    return units.select("document_id", "source_order", F.explode("tokens").alias("token"))


def document_frequency(units: DataFrame) -> DataFrame:
    return postings(units).groupBy("token").agg(F.count("*").alias("df"))


def matches(units: DataFrame, queries: DataFrame) -> DataFrame:
    """Units that hold all tokens of a query, for queries(query_id, query). A unit meets a query at one
    token of the query, its longest, and then is tested for all: units are read once, and none moves
    unless the queries are too many to broadcast."""
    q = queries.select("query_id", F.trim("query").alias("query"), text.tokens(F.trim("query")).alias("query_tokens")).where("size(query_tokens) > 0")
    q = q.select("query_id", "query", "query_tokens", F.size("query_tokens").alias("n_query"), F.element_at(F.array_sort(F.transform("query_tokens", lambda t: F.struct(F.length(t), t.alias("t")))), -1)["t"].alias("anchor"))
    at = units.select(*units.columns, F.explode("tokens").alias("token")).join(q, F.col("token") == F.col("anchor"))
    return at.where(F.size(F.array_except("query_tokens", "tokens")) == 0).drop("token", "anchor", "query_tokens")


def _top(ranked: DataFrame, order: list, limit: int, per: list[str]) -> DataFrame:
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= limit)


def rank_phrase(units: DataFrame, queries: DataFrame, limit: int = 10, per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Phrase first, then how many tokens, then sentences before paragraphs before sections."""
    m = matches(units, queries)
    kind = F.when(F.col("kind") == "sentence", 1.0).when(F.col("kind") == "paragraph", 0.5).otherwise(0.25)
    phrase = F.when(F.lower("text").contains(F.lower("query")), 4.0).otherwise(0.0)
    m = m.withColumn("score", phrase + F.col("n_query") + kind).withColumn("kind_order", F.when(F.col("kind") == "sentence", 0).when(F.col("kind") == "paragraph", 1).otherwise(2))
    return _top(m, [F.desc("score"), "kind_order", "document_id", "section_id", F.coalesce("range_start", F.lit(0)), "source_order"], limit, list(per))


def statistics(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(token, df, lengths) of the wanted tokens, and of the empty token, which stands for every unit: how
    many units hold it, and how many tokens these have together. Units are read once."""
    w = wanted.select("token").unionByName(wanted.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    at = units.select(F.size("tokens").alias("n"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"))
    return at.join(w, "token").groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("lengths"))


def rank_bm25(units: DataFrame, queries: DataFrame, limit: int = 10, per: tuple[str, ...] = ("query_id",), k1: float = 1.2, b: float = 0.75, whole: DataFrame | None = None) -> DataFrame:
    """BM25 over distinct tokens: within a query, order is by number of tokens, then place. The score
    is 1 / (1 + rank), with counts over all documents: those of whole, where units are only a part."""
    q = queries.select("query_id", F.explode(text.tokens(F.trim("query"))).alias("token"))
    counts = statistics(units if whole is None else whole, q)
    every = F.col("token") == ""  # no filter, which would be pushed down and have the units read again
    of_all = counts.agg(F.max(F.when(every, F.col("df"))).alias("n_units"), F.max(F.when(every, F.col("lengths") / F.col("df"))).alias("avg_len"))  # one row
    idf = F.log((F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    at = q.join(counts, "token").join(F.broadcast(of_all)).withColumn("idf", F.when(idf > 0, idf).otherwise(1e-6))
    weights = at.groupBy("query_id").agg(F.sum("idf").alias("idf"), F.first("avg_len").alias("avg_len"))
    m = matches(units, queries).withColumn("n_tokens", F.size("tokens")).join(weights, "query_id")
    raw = F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("n_tokens") / F.col("avg_len")))
    m = m.withColumn("score", 1 / (1 + raw))
    return _top(m, ["n_tokens", "document_id", "source_order"], limit, list(per))


def bm25_score(idf: float, n: int, average: float, k1: float = 1.2, b: float = 0.75) -> float:
    return 1 / (1 + idf * (k1 + 1) / (1 + k1 * (1 - b + b * n / average)))


def idf(n_units: int, df: int) -> float:
    return max(1e-6, math.log((n_units - df + 0.5) / (df + 0.5)))
