"""Connected components by least labels, with a written table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node that each node of an edge reaches.

    Before the first round every node's lesser neighbours are hung on the least of them, so that a
    group in which all are neighbours of many becomes a star. Every round takes the least label among the neighbours, then the label of that
    label, so that long chains halve. Neighbours are combined before the shuffle; a node
    with very many edges is a skewed join, which Spark splits. Rounds are cut by written
    tables. Edges with a null end are left out; an empty table gives an empty result.
    """
    ends = (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    down = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*ends)
    least = down.groupBy("hi").agg(F.min("lo").alias("least"))
    hung = down.join(least, "hi").where("lo <> least").select(F.col("least").alias("a"), F.col("lo").alias("b"))
    pairs = hung.union(least.select(F.col("least").alias("a"), F.col("hi").alias("b")))
    both = materialize(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("node").alias("via"), F.col("component").alias("next"))
        after = lower.join(jump, lower["component"] == jump["via"]).select("node", "old", F.col("next").alias("component"))
        labels = materialize(after, "labels")
        if not labels.where("old <> component").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
