"""Evaluation of scores, and reports on trials and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str = "y", score: str = "y_hat") -> DataFrame:
    """Counts over labelled rows: predicted positive is a score above 0."""
    pos = F.col(score) > 0
    return df.where(F.col(y) != 0).agg(
        F.count("*").alias("n"),
        F.count_if(pos).alias("pred_pos"),
        F.count_if(~pos).alias("pred_neg"),
        F.count_if((F.col(y) > 0) & ~pos).alias("fn"),
        F.count_if((F.col(y) <= 0) & pos).alias("fp"),
        F.sum(0.5 * F.pow(F.col(y) - F.col(score), 2)).alias("half_sq"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the shares of false predictions among all of their sign."""
    precision = 1 - F.try_divide(F.col("fp"), F.col("pred_pos"))
    recall = 1 - F.try_divide(F.col("fn"), F.col("pred_pos") - F.col("fp") + F.col("fn"))
    out = counts.select("*", precision.alias("precision"), recall.alias("recall"), F.try_divide(F.col("fn"), F.col("pred_neg")).alias("fn_share"), F.try_divide(F.col("fp"), F.col("pred_pos")).alias("fp_share"), F.try_divide(F.col("half_sq"), F.col("n")).alias("half_mse"))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classify(scores: DataFrame, by: str = "repo", score: str = "y_hat") -> DataFrame:
    """Per graph the least, greatest and mean score; positive if the mean is above 0."""
    return scores.groupBy(by).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean")).withColumn("positive", F.col("mean") > 0)


def totals(classified: DataFrame) -> DataFrame:
    return classified.agg(F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"))


def running_best(trials: DataFrame, order: str, value: str) -> DataFrame:
    """A column ``best``: whether a trial is strictly below all before it."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.min(value).over(w)
    return trials.withColumn("best", before.isNull() | (F.col(value) < before))


def running_mean(df: DataFrame, order: str, value: str, every: int) -> DataFrame:
    """The mean of value over each range of ``every`` steps."""
    return df.groupBy(F.floor(F.col(order) / every).alias("range")).agg(F.avg(value).alias("mean"))


def kernel_smooth(points: DataFrame, x: str, y: str, samples: int = 200, sigma: float = 0.04, pad: float = 0.05) -> DataFrame:
    """(i, x, y): kernel-smoothed means at evenly spaced places over the padded range of x.

    Points meet a fixed number of places, and are summed by place before any shuffle.
    """
    span = points.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    places = span.select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"), "a", "b").select("i", ((F.col("b") - F.col("a")) * sigma).alias("s"), (F.col("a") - pad * (F.col("b") - F.col("a")) + (1 + 2 * pad) * (F.col("b") - F.col("a")) * F.col("i") / (samples - 1)).alias("at"))
    near = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).join(F.broadcast(places.select(F.collect_list(F.struct("i", "s", "at")).alias("p"))), F.lit(True)).select("_x", "_y", F.explode("p").alias("p"))
    w = F.exp(-F.pow((F.col("_x") - F.col("p.at")) / F.col("p.s"), 2) / 2)
    return near.groupBy(F.col("p.i").alias("i"), F.col("p.at").alias("x")).agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("y"))


def even_sample(df: DataFrame, by: str, value: str, most: int = 500, tie: str | None = None) -> DataFrame:
    """At most so many rows of each group, evenly over its sorted values."""
    w = Window.partitionBy(by)
    order = [value] if tie is None else [value, tie]
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    ranked = df.select("*", i.alias("_i"), n.alias("_n"))
    cell = lambda k: F.floor(k * most / F.col("_n"))
    return ranked.where((F.col("_n") <= most) | (F.col("_i") == 0) | (cell(F.col("_i")) != cell(F.col("_i") - 1))).drop("_i", "_n")


def tagged(scores: DataFrame, tags: DataFrame, by: str = "repo") -> DataFrame:
    """Scores with each class that lists their repository; a repository may have several."""
    return scores.join(tags.distinct(), by)


def schedule(epoch: Column, rate: float, decay: int) -> Column:
    return F.lit(rate) * F.pow(F.lit(0.5), F.floor(epoch / decay)) if decay else F.lit(rate)
