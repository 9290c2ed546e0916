"""Connected components of an edge table: smallest label spread along edges with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both longs; root is the smallest node of the component.

    Each round takes the least label among a node and its neighbours and then that label's own label, so the
    rounds grow with the logarithm of a chain's length. Every round is written to the shared folder, the driver only
    learns how many labels changed; labels that a later round has replaced are deleted. An empty edge table gives no nodes."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        after = materialize(step.join(jump, step.root == jump.via, "left").select("node", "old", F.least("root", "beyond").alias("root")), "labels")
        discard(labels)
        labels = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            discard(both)
            return labels
    raise RuntimeError("components did not settle")


def contracted(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels (node, root) after further edges (a, b). The edges are first mapped to roots, so that a round's work
    follows the components that are still apart, not all links found so far."""
    if labels is None:
        return components(edges)
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    known = materialize(ends.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("fresh")), "roots")
    x, y = (known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    between = edges.join(x, "a").join(y, "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).filter("a <> b").distinct()
    merged = components(between).select(F.col("node").alias("root"), F.col("root").alias("beyond"))
    nodes = labels.union(known.filter("fresh").select("node", "root"))
    return materialize(nodes.join(merged, "root", "left").select("node", F.coalesce("beyond", "root").alias("root")), "labels")
