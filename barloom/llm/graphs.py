"""Connected components over a table of links, label by label in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.session import persist_table


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b).

    Each round gives a node the smallest label among its neighbours and then
    the label of that label, so labels travel in doubling steps. Minima are
    merged before each shuffle; every round is written to the shared folder,
    and only the number of changed labels reaches the driver. An empty table
    gives no rows; loops and repeated links change nothing.
    """
    both = persist_table(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links"
    )
    labels = persist_table(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(seen, labels.node == seen.a).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("place"), F.col("label").alias("further"))
        moved = own.join(jump, own.label == jump.place, "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        stepped = persist_table(moved, "labels")
        labels = stepped.select("node", "label")
        if stepped.filter("label <> old").isEmpty():
            return labels
