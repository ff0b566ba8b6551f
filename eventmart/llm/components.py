"""Connected components of a link table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def roots(parent: DataFrame) -> DataFrame:
    """(node, parent) with ``parent`` pointers followed to their roots; each pass halves the depth."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parent = saved(
            parent.join(up, "parent", "left").select(
                "node",
                F.coalesce("grand", "parent").alias("parent"),
                (F.coalesce("grand", "parent") != F.col("parent")).alias("moved"),
            ),
            "components-jump",
        )
        if parent.filter("moved").limit(1).count() == 0:
            return parent.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the smallest node reachable.

    Links may be repeated, reversed or loops; NULL ends are ignored. Each round hooks every
    node to its smallest neighbour, collapses the trees and keeps only links between different
    trees, so hubs shrink by aggregation before they are shuffled and nothing is collected.
    """
    links = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    links = saved(
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-links"
    )
    labels = None
    while True:
        hooked = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        parent = roots(hooked.select("node", F.least("node", "b").alias("parent")))
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            moved = parent.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            labels = saved(
                labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")),
                "components-labels",
            )
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        links = saved(
            links.join(left, "a").join(right, "b").filter("pa <> pb")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "components-links",
        )
        if links.limit(1).count() == 0:
            return labels
