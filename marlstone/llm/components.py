"""Connected components over a table of links, by contraction.

Every round each node takes the least node among itself and its neighbours as its parent, links are relabelled to the
parents, and links within one parent vanish. A star collapses in two rounds and, with digests as nodes, a chain in a
number of rounds that grows with the logarithm of its length. Hot nodes meet only in aggregates with partial results
and in joins that AQE can split. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch, few


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of links (a, b); the component is named by one of its nodes.

    Null ends and links of a node with itself are ignored; repeated links do no harm; no links give an empty table.
    """
    links = scratch.save(links.select("a", "b").where("a <> b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    n = links.count()
    labels = scratch.save(few(nodes, 2 * n).withColumn("component", F.col("node")))
    n_labels = labels.count()
    while n:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parents = scratch.save(few(least.select("node", F.least("node", "least").alias("parent")), 2 * n))
        onto = parents.where("parent <> node")
        moved = labels.join(onto.select(F.col("node").alias("component"), "parent"), "component", "left")
        new_labels = scratch.save(few(moved.select("node", F.coalesce("parent", "component").alias("component")), n_labels))
        relabelled = (
            links.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .distinct()
        )
        new_links = scratch.save(few(relabelled, n))
        for old in (labels, links, parents):
            scratch.drop(old)
        labels, links = new_labels, new_links
        n = links.count()
    return labels


def brute_force(links: list[tuple]) -> dict:
    """Node to the least node of its component; for tests."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}
