"""Connected components of a table of links, by contraction: hook to a smaller neighbour, shorten, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.llm.common import discard, written


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Links between different nodes, once each, the larger node first."""
    return (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )


def _shortened(parents: DataFrame) -> DataFrame:
    """Every node's root: parents are replaced by their parents until none has one."""
    while True:
        before = parents
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        parents = written(
            parents.join(up, "root", "left").select(
                "node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")
            ),
            "roots",
        )
        discard(before)
        if parents.where("moved").isEmpty():
            return parents
        parents, place = parents.select("node", "root"), parents.place
        parents.place = place


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of a link (a, b)."""
    edges = written(_ordered(edges, "a", "b"), "links")
    labels = None
    while not edges.isEmpty():
        last, table = edges, _shortened(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"))
        roots = table.select("node", "root")
        if labels is None:
            ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            labels = written(
                ends.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels"
            )
        else:
            higher = roots.select(F.col("node").alias("label"), "root")
            old, labels = labels, written(
                labels.join(higher, "label", "left").select("node", F.coalesce("root", "label").alias("label")),
                "labels",
            )
            discard(old)
        to = roots.select(F.col("node").alias("b"), F.col("root").alias("b_root"))
        moved = edges.join(roots.withColumnRenamed("node", "a"), "a", "left").join(to, "b", "left")
        edges = written(
            _ordered(
                moved.select(F.coalesce("root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")), "x", "y"
            ),
            "links",
        )
        discard(last, table)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
