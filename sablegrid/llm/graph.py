"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import made, stage, sweep


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of every node that has a link (a, b); the component is its smallest node.

    Each round takes the smallest label of the neighbours and then the label's own label, so a
    path of n links needs about log n rounds. Minima are combined before they are shuffled, and
    each round's labels are written to the shared folder.
    """
    mark = made()
    edges = stage(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("its"))
        new = stage(lower.join(jump, lower["low"] == jump["to"], "left").select("node", "component", F.least("low", "its").alias("new")), "labels")
        labels, done = new.select("node", F.col("new").alias("component")), new.where("new <> component").isEmpty()
        if done:
            sweep(mark, labels)
            return labels
        sweep(mark, labels, edges)
