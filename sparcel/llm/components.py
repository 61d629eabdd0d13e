"""Connected components by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparcel.session import stage


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component) for every node of a link; a component's name is its smallest node.

    Each round a node takes the smallest label among its neighbours and itself, then the label of that label, so
    the number of rounds grows with the logarithm of a component's diameter. Every round is a written table.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("least"))
        over = labels.select(F.col("node").alias("least"), F.col("label").alias("next"))
        jumped = stage(taken.join(over, "least").select("node", F.col("label").alias("was"), F.least("least", "next").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("was <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
