"""Distribution statistics of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(df: DataFrame, by: str, value: str, prefix: str) -> DataFrame:
    """min, max, upper median, mean and population deviation of value; the median is order statistic floor(n / 2) from 0.

    The median comes from the histogram of values, summed before the shuffle, so no group's values meet in one list.
    """
    counts = df.groupBy(by, value).agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(by))
    median = counts.select(by, value, run.alias("run"), total.alias("n")).where(F.col("run") > F.floor(F.col("n") / 2)).groupBy(by).agg(F.min(value).alias(f"{prefix}_median"))
    base = df.groupBy(by).agg(F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"), F.avg(value).alias(f"{prefix}_mean"), F.stddev_pop(value).alias(f"{prefix}_stddev"))
    return base.join(median, by)


def density(num_nodes, num_edges):
    """Undirected edges over n (n - 1): half of the usual measure; null for fewer than two nodes."""
    return F.try_divide(num_edges.cast("double"), (num_nodes * (num_nodes - 1)).cast("double"))


def graph_stats(nodes: DataFrame, edge: DataFrame, degree: DataFrame) -> DataFrame:
    """One row a graph: sizes, density, and the metrics of degrees and weights (0 where a graph has no edges)."""
    size = nodes.groupBy("repo").agg(F.count("*").alias("num_nodes")).join(edge.groupBy("repo").agg(F.count("*").alias("num_edges")), "repo", "left").withColumn("num_edges", F.coalesce("num_edges", F.lit(0)))
    out = size.withColumn("density", density(F.col("num_nodes"), F.col("num_edges"))).join(metrics(degree, "repo", "degree", "degree"), "repo", "left").join(metrics(edge, "repo", "weight", "weight"), "repo", "left")
    return out.fillna(0, [c for c in out.columns if c.startswith(("degree_", "weight_"))])


def write_stats(stats: DataFrame, path: str) -> None:
    """The statistics as a table separated by blanks, names in quotes."""
    stats.withColumn("repo", F.concat(F.lit('"'), "repo", F.lit('"'))).write.csv(path, sep=" ", header=True, quote="")
