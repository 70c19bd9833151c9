"""Connected components of a graph whose nodes are longs, by rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, if_small, last_only

MAX_ROUNDS = 100


def label(edges: DataFrame, max_broadcast_rows: int = 500_000) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges (a, b).
    Edges with a null end are ignored, repeated ones and loops change nothing, no edges give no rows.

    Each round lowers a node's label to the least among its neighbours, hooks the trees that labels
    form onto each other, and shortens their paths, so that rounds grow with the logarithm of a
    component's diameter. Every round is written to the shared folder. edges is a table already
    written, so that counting it reads footers only."""
    return last_only(edges.sparkSession, lambda: _label(edges, max_broadcast_rows))


def _label(edges: DataFrame, max_broadcast_rows: int) -> DataFrame:
    rows = 2 * edges.count()
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges", rows)
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", rows)
    for _ in range(MAX_ROUNDS):
        small = lambda d: if_small(d, max_broadcast_rows)
        near = both.join(small(now), both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("near"))
        seen = cut(now.join(near, now["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("least")), "seen", rows)
        hooks = cut(seen.groupBy(F.col("label").alias("root")).agg(F.min("least").alias("hook")), "hooks", rows)
        hooked = cut(seen.join(small(hooks), seen["label"] == hooks["root"]).select("node", "label", F.least("least", "hook").alias("next")), "hooked", rows)
        up = hooked.select(F.col("node").alias("_up"), F.col("next").alias("over"))
        after = cut(hooked.join(small(up), hooked["next"] == F.col("_up")).select("node", "label", F.least("next", "over").alias("next")), "after", rows)
        moved = after.where("label <> next").limit(1).count()
        now = after.select("node", F.col("next").alias("label"))
        if not moved:
            return now
    raise RuntimeError("components didn't settle")
