"""Connected components of undirected graphs given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.sources.shared import dropped, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label (the smallest node that can be reached) for each end of an edge (a, b).

    Labels are lowered to the least of all neighbours of a component's nodes, and
    to the label of that label, until nothing changes. A round's tables are removed
    when the next round has been written. Raises RuntimeError if `rounds` don't
    suffice.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = written(labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low")), "low")
        hooked = written(low.where("low < label").groupBy(F.col("label").alias("root")).agg(F.min("low").alias("root_low")), "hooked")
        if hooked.isEmpty():
            dropped(both, low, hooked)
            return labels
        mid = F.coalesce(F.least("low", "root_low"), F.col("low"))
        moved = low.join(hooked, low.label == hooked.root, "left").select("node", mid.alias("mid"))
        up = moved.select(F.col("node").alias("up"), F.col("mid").alias("up_label"))
        before = labels
        labels = written(moved.join(up, moved.mid == up.up, "left").select("node", F.coalesce(F.least("mid", "up_label"), F.col("mid")).alias("label")), "labels")
        dropped(before, low, hooked)
    raise RuntimeError("components: more rounds are needed")


def groups(edges: DataFrame) -> DataFrame:
    """label, size and members, in order, of each component. Members are one array of
    a row: for groups of at most some millions of nodes."""
    return components(edges).groupBy("label").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members"))
