"""Training instances: normalisation, labels, splits, batches, mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The normalising transform.
C1, C2, C3 = 4.2991, 0.0154927, -0.0184841


def instance_max(x: Column) -> Column:
    return F.greatest(F.lit(1.0), F.array_max(x).cast("double"))


def normalised(x: Column) -> Column:
    """Weights as logarithms between about -0.92 for none and 0.95 for the instance's largest."""
    top = instance_max(x)
    return F.transform(x, lambda v: 2 * F.log((v.cast("double") / top - C3) / C2) / C1 - 1)


def label(kind: Column) -> Column:
    """1 for real, -1 for random and perturbed, 0 (unlabelled) for anything else."""
    return F.when(kind == "real", 1.0).when(kind.isin("random", "perturbed"), -1.0).otherwise(0.0)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with a column ``place``, from 0 in the order given. The number before each range of 2^16 ids would make this
    parallel; instances are few enough for one ordered pass of keys."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def split(df: DataFrame, test_frac: float, batch_size: int, place: str = "place") -> DataFrame:
    """A column ``part``: the first batches train, the last floor(test_frac * batches) test; a rest shorter than a batch is left out."""
    n = df.count() // batch_size
    test = int(test_frac * n)
    batch = F.floor(F.col(place) / batch_size)
    return df.withColumn("part", F.when(batch < n - test, "train").when(batch < n, "test")).where("part is not null")


def rebatch(df: DataFrame, batch_size: int, place: str = "place") -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(place) / batch_size)).withColumn("slot", F.pmod(F.col(place), F.lit(batch_size)))


def shuffled(df: DataFrame, seed: int, key: str = "instance_id") -> DataFrame:
    """df in an order that the seed and the keys decide."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def mix(real: DataFrame, random: DataFrame) -> DataFrame:
    return real.unionByName(random)


def data_info(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count("*").alias("n"))
