"""Pages over ordered items and over rendered text, for many streams at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHARS, MOST_CHARS = 32_000, 64_000
PAGE_ITEMS, PAGE_CHARS, MOST_ITEMS, MOST_PAGE_CHARS = 32, 32_768, 256, 65_536


def response_limit(asked: int | None) -> int:
    """Reads clamp what is asked for; they don't refuse it."""
    return min(DEFAULT_CHARS if asked is None else asked, MOST_CHARS)


def check_page(max_items: int, max_chars: int) -> None:
    """Enumerations refuse what is out of bounds."""
    if not 1 <= max_items <= MOST_ITEMS or not 1 <= max_chars <= MOST_PAGE_CHARS:
        raise ValueError(f"a page has 1 to {MOST_ITEMS} items and 1 to {MOST_PAGE_CHARS} characters")


def page(items: DataFrame, stream: list[str], position: Column, max_items: int, max_chars: int, forward: bool = True) -> DataFrame:
    """One page of each stream of items(index, text) from a position: forward the items at and after
    it, else those before it; whole items only, while their characters add up to max_chars."""
    check_page(max_items, max_chars)
    some = items.where(F.col("index") >= position) if forward else items.where(F.col("index") < position)
    by = Window.partitionBy(*stream).orderBy(F.col("index") if forward else F.desc("index"))
    at = some.withColumn("taken_chars", F.sum(F.char_length("text")).over(by)).withColumn("taken", F.row_number().over(by))
    return at.where((F.col("taken") <= max_items) & (F.col("taken_chars") <= max_chars)).drop("taken_chars", "taken")


def pages(items: DataFrame, stream: list[str], size: int) -> DataFrame:
    """items with the number of the page of `size` items that holds each."""
    return items.withColumn("page", F.floor(F.col("index") / size).cast("int"))


def text_page(content: Column, start: Column, limit: int) -> Column:
    """A page of a rendered text: struct(content, start, end, total, complete)."""
    total = F.char_length(content)
    end = F.least(start + limit, total)
    return F.struct(F.substring(content, start.cast("int") + 1, F.lit(limit)).alias("content"), start.alias("start"), end.alias("end"), total.alias("total"), (end >= total).alias("complete"))


def atomic_budget(items: DataFrame, stream: list[str], limit: int) -> DataFrame:
    """Whether a stream's items, joined by two characters, fit into limit."""
    sums = items.groupBy(*stream).agg(F.max(F.char_length("text")).alias("longest"), (F.sum(F.char_length("text")) + 2 * (F.count("*") - 1)).alias("total"))
    return sums.withColumn("fits", (F.col("longest") <= limit) & (F.col("total") <= limit))
