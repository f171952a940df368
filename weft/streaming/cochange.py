"""An extension beyond the batch operators: co-change counts that follow a stream of commits' change sets.

Counts only add up, so the running aggregate is exact in any order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_sets(spark: SparkSession, path: str) -> DataFrame:
    """A stream of rows (repo, commit, items), one a commit, from the Parquet files that arrive in a folder."""
    return spark.readStream.schema("repo string, commit string, items array<string>").parquet(path)


def edge_counts(sets: DataFrame) -> DataFrame:
    """(repo, lo, hi, weight), for update or complete output."""
    items = sets.select("repo", F.array_sort(F.array_distinct("items")).alias("items")).where("size(items) > 1")
    first = items.select("repo", "items", F.posexplode("items").alias("i", "lo"))
    pairs = first.select("repo", "lo", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("hi"))
    return pairs.groupBy("repo", "lo", "hi").agg(F.count("*").alias("weight"))
