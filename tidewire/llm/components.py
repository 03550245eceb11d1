"""Connected components of a table of links, by repeated minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_counted


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the least node that can be reached.

    In each round a node takes the least label among its own and its neighbours', and then the label of its label, so
    chains halve. Only the count of changes comes to the driver. A node with many links is met as the key of an
    aggregate with partial sums, or as a join key that adaptive execution may split.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("least"))
        hop = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        # A label is a node as well, so it has a label of its own.
        jump = hop.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        step, seen = materialize_counted(jump.select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels", changed=F.col("was") != F.col("label"))
        labels = step.select("node", "label")
        if not seen.changed:
            return labels
