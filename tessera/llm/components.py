"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for each node of the links (columns ``a`` and ``b``): the smallest node it reaches.

    Each round a node takes the least label among its neighbours' and its own, then the label of that label;
    stars end in two rounds, chains in about the logarithm of their length. Labels are staged each round, so
    nothing is recomputed and only a count of changes comes to the driver.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = stage(both.distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        least = stage(least, "least")
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        jumped = least.join(up, least["label"] == up["to"], "left").select("node", "was", F.least("label", "further").alias("label"))
        nxt = stage(jumped, "labels")
        changed = nxt.filter("was <> label").limit(1).count()
        unstage(labels, least)
        labels = nxt
        if not changed:
            unstage(edges)
            return labels.select("node", "label")
