"""Connected components by joins: minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.skew import hot_keys, spread_join
from fieldbook.session import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges.

    Nodes with a null end are ignored; nodes that have no edge don't appear (a self loop is an edge).
    Each round takes the smallest label of the neighbours and then the label of that label, so that
    chains shorten by half; lineage is cut by a written table in every round. Nodes with very many edges and components with
    very many nodes don't gather in a task: they meet their labels by a broadcast of a row for each of them.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    links = written(both.union(both.select("b", "a")).distinct())
    busy = hot_keys(links, "b")
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = written(labels)
    while True:
        near = spread_join(links, labels.withColumnRenamed("node", "b"), "b", busy).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        # What was hot as a label is what many take now.
        moved = spread_join(lower, jump, "next", hot_keys(labels, "label"))
        moved = written(moved.select("node", F.least("next", "jump").alias("label"), F.col("label").alias("was")))
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
