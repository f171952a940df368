"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for the nodes of links (a, b): label is the least node reachable.

    Each round a node takes the least label among its neighbours' and then that label's own label, so labels travel in
    doubling steps. Every round is a written table.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    at = labels
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = written(step.join(jump, step["next"] == jump["_n"], "left").select("node", "label", F.least("next", "_l").alias("next")), "labels")
        changed = new.where("next <> label").limit(1).count()
        drop(at)
        labels, at = new.select("node", F.col("next").alias("label")), new
        if not changed:
            drop(both)
            labels._weft_path = at._weft_path
            return labels
