"""Connected components of a table of edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import forget, meet, written

#: Edges of a task at most, where there are more than so few tasks: tables of a round are written in few files.
PART_EDGES, LEAST_PARTS = 50_000, 4
#: So many edges (both ways) are a small task even if one node has them all.
FEW_EDGES = 2**17


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node of each component, for every node that has an edge.

    Each round gives a node the least label around it, then the label of its label; the rounds
    needed grow with the logarithm of a path's length. Rounds are written to the shared folder,
    so a lost executor costs one round. Of more than FEW_EDGES edges, those of a node that many others
    are linked with, and nodes that share a label, are met by broadcast, not in one task.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x != y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-edges")
    total = both.count()
    parts = max(LEAST_PARTS, -(-total // PART_EDGES))
    degrees = written(both.groupBy("y").agg(F.count("*").alias("c")), "cc-degrees", parts=parts)
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("label")), "cc", parts=parts)
    spread = _spread if total > FEW_EDGES else _plain
    while True:
        new = spread(both, labels, degrees, total, parts)
        forget(labels)
        labels = new.select("node", F.col("new").alias("label"))
        if new.filter("new != old").isEmpty():
            forget(both)
            forget(degrees)
            return labels


def _plain(both: DataFrame, labels: DataFrame, degrees: DataFrame, total: int, parts: int) -> DataFrame:
    """(node, old, new) after a round, by joins alone: all edges of any node fit a task."""
    around = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
    lowered = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
    jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
    return written(lowered.join(jump, "low").select("node", F.least("low", "far").alias("new"), F.col("label").alias("old")), "cc", parts=parts)


def _spread(both: DataFrame, labels: DataFrame, degrees: DataFrame, total: int, parts: int) -> DataFrame:
    """The same, with nodes of many edges and labels of many nodes met by broadcast."""
    named = written(labels.select(F.col("node").alias("y"), "label").join(degrees, "y"), "cc-named", parts=parts)
    around = meet(both, named, "y", "c", total).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
    lowered = written(labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low")), "cc-lowered", parts=parts)
    shared = lowered.groupBy("low").agg(F.count("*").alias("c"))
    jump = written(labels.select(F.col("node").alias("low"), F.col("label").alias("far")).join(shared, "low"), "cc-jump", parts=parts)
    new = written(meet(lowered, jump, "low", "c", total).select("node", F.least("low", "far").alias("new"), F.col("label").alias("old")), "cc", parts=parts)
    for used in (named, lowered, jump):
        forget(used)
    return new
