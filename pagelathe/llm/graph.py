"""Connected components of a link table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.scratch import discard, sized, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); label is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then jumps to the label's own label, so
    chains halve. Labels of a round are written to the shared folder; only counts come to the driver. A hub's
    links are pre-aggregated in each task before the shuffle, and while the labels are few (a checked count) they are
    broadcast; beyond that the joins are plain ones that AQE can split.
    """
    one = links.where("a != b").select("a", "b")
    both = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    n = labels.count()
    while True:
        small = sized(labels.withColumnRenamed("node", "b"), n)
        near = both.join(small, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # every node has a neighbour, so near has them all
        own = sized(labels.select("node", "label"), n)
        lower = near.join(own, "node").select("node", "label", F.least("label", "near").alias("low"))
        target = sized(labels.select(F.col("node").alias("low"), F.col("label").alias("jump")), n)
        new = lower.join(target, "low", "left").select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("label")).alias("moved"))
        new = written(new, "labels")
        moved = new.where("moved").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels.select("node", "label")
