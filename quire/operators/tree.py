"""Section trees, from sections(document_id, section_id, parent_id, dfs_order, depth, ...).

Trees are stored flat in preorder: `dfs_order` and `subtree_size` make a subtree an interval, and
`ancestor_ids` makes ancestors an array, so that no query needs recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["document_id"]


def enrich(sections: DataFrame) -> DataFrame:
    """Adds depth, ancestor_ids, child_count and subtree_size to sections in preorder, for tables that no
    parser of this library has made (sources.router gives these columns already). Within a document,
    one walk in preorder keeps the path of open sections; documents are independent of each other."""
    key = ["document_id", "section_id"]
    one = sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("dfs_order", "section_id", "parent_id"))).alias("s"))
    empty = F.array().cast("array<string>")

    def step(path: Column, s: Column) -> Column:
        """The ancestors of a section, and itself: the open path up to its parent."""
        return F.concat(F.when(s["parent_id"].isNull(), empty).otherwise(F.slice(path, F.lit(1), F.array_position(path, s["parent_id"]).cast("int"))), F.array(s["section_id"]))

    walked = F.aggregate(
        "s",
        F.array().cast("array<array<string>>"),
        lambda done, s: F.concat(done, F.array(step(F.coalesce(F.try_element_at(done, F.lit(-1)), empty), s))),
    )
    up = one.select("document_id", F.explode(walked).alias("path")).select("document_id", F.element_at("path", -1).alias("section_id"), F.size("path").alias("depth"), F.slice("path", F.lit(1), F.size("path") - 1).alias("ancestor_ids"), "path")
    below = up.select("document_id", F.explode("path").alias("section_id")).groupBy(*key).agg(F.count("*").alias("subtree_size"))
    kids = sections.where("parent_id is not null").groupBy("document_id", F.col("parent_id").alias("section_id")).agg(F.count("*").alias("child_count"))
    return sections.join(up.drop("path"), key).join(below, key).join(kids, key, "left").fillna(0, ["child_count"])


def outline(sections: DataFrame, max_depth: int | None = None, budget: int = 1000) -> DataFrame:
    """Sections without content in preorder, at most `budget` a document; `truncated` says whether more were due."""
    some = sections if max_depth is None else sections.where(F.col("depth") <= max(max_depth, 1))
    by = Window.partitionBy("document_id").orderBy("dfs_order")
    ranked = some.select("document_id", "section_id", "parent_id", "dfs_order", "depth", "title", "level", F.row_number().over(by).alias("rank"), F.count("*").over(Window.partitionBy("document_id")).alias("due"))
    return ranked.where(F.col("rank") <= budget).withColumn("truncated", F.col("due") > budget).drop("due")


def ancestors(sections: DataFrame) -> DataFrame:
    """(document_id, section_id, position from the root, ancestor_id)."""
    return sections.select("document_id", "section_id", F.posexplode("ancestor_ids").alias("position", "ancestor_id"))


def children(sections: DataFrame) -> DataFrame:
    return sections.where("parent_id is not null").select("document_id", F.col("parent_id").alias("section_id"), F.col("section_id").alias("child_id"), "dfs_order")


def in_source_order(sections: DataFrame) -> DataFrame:
    """Roots and siblings numbered from 0 in source order, as `place` among those of one parent."""
    by = Window.partitionBy("document_id", "parent_id").orderBy("dfs_order")
    return sections.withColumn("place", F.row_number().over(by) - 1)


def siblings(sections: DataFrame) -> DataFrame:
    """(document_id, section_id, sibling_id): same parent, roots included, without itself."""
    a = sections.select("document_id", "section_id", "parent_id")
    b = sections.select(F.col("document_id").alias("_d"), F.col("section_id").alias("sibling_id"), F.col("parent_id").alias("_p"), F.col("dfs_order").alias("sibling_order"))
    same = (F.col("document_id") == F.col("_d")) & F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("section_id") != F.col("sibling_id"))
    return a.join(b, same).select("document_id", "section_id", "sibling_id", "sibling_order")


def neighbours(sections: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Sections up to `before` ahead of and `after` behind each one in whole-document preorder, with roles."""
    anchor = sections.select("document_id", F.col("section_id").alias("anchor_id"), F.col("dfs_order").alias("anchor_order"))
    offsets = anchor.select("*", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("dfs_order", F.col("anchor_order") + F.col("offset"))
    role = F.when(F.col("offset") < 0, "before").when(F.col("offset") > 0, "after").otherwise("anchor")
    return offsets.join(sections.select("document_id", "dfs_order", "section_id", "title", "level", "content"), ["document_id", "dfs_order"]).select("document_id", "anchor_id", "offset", role.alias("role"), "section_id", "title", "level", "content")


def heading_text(level: Column, title: Column, content: Column) -> Column:
    """One section as Markdown: its heading, a blank line and its trimmed content."""
    head = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level))), F.lit(" "), title)
    body = F.regexp_replace(content, r"(?U)^\s+|\s+$", "")
    return F.concat(head, F.lit("\n\n"), F.when(body == "", F.lit("")).otherwise(F.concat(body, F.lit("\n\n"))))


def shallow(level: int, title: str, content: str) -> str:
    """One section as heading_text has it, without blank lines at its end, for what a driver has at hand."""
    return f"{'#' * max(1, min(6, level))} {title}\n\n{content.strip()}".rstrip()


def render(sections: DataFrame, top: DataFrame) -> DataFrame:
    """The subtree of each section in top(document_id, section_id) as one Markdown text."""
    t = top.join(sections.select("document_id", "section_id", F.col("dfs_order").alias("lo"), (F.col("dfs_order") + F.col("subtree_size")).alias("hi")), ["document_id", "section_id"])
    s = sections.select(F.col("document_id").alias("_d"), "dfs_order", heading_text(F.col("level"), F.col("title"), F.col("content")).alias("said"))
    got = t.join(s, (F.col("document_id") == F.col("_d")) & (F.col("dfs_order") >= F.col("lo")) & (F.col("dfs_order") < F.col("hi")))
    whole = got.groupBy("document_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("dfs_order", "said"))).alias("parts"))
    return whole.select("document_id", "section_id", F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["said"]), ""), r"(?U)^\s+|\s+$", "").alias("content"))
