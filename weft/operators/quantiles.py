"""Exact nearest-rank quantiles, percentile tables, and a one-pass sketch of them."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, by: str, value: str, bins: int) -> DataFrame:
    """(by, i, q) for i = 0..bins: the ceil(i n / bins)-th smallest value, and the smallest for i = 0.

    Ranks are found on the histogram of values, not on the values.
    """
    counts = df.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    ranked = counts.select(by, value, F.sum("c").over(w.orderBy(value)).alias("high"), F.sum("c").over(w).alias("n"), "c")
    wanted = ranked.select(by, value, "high", (F.col("high") - F.col("c")).alias("low"), "n", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("i")) if bins <= 16 else None
    if wanted is None:  # only the i that can fall in a value's ranks
        first = F.floor((F.col("high") - F.col("c")) * bins / F.col("n")).cast("int")
        last = F.ceil(F.col("high") * F.lit(bins) / F.col("n")).cast("int")
        wanted = ranked.select(by, value, "high", (F.col("high") - F.col("c")).alias("low"), "n", F.explode(F.sequence(first, F.least(last, F.lit(bins)))).alias("i"))
    rank = F.greatest(F.expr(f"(i * n + {bins - 1}) div {bins}"), F.lit(1))
    return wanted.where((rank > F.col("low")) & (rank <= F.col("high"))).select(by, F.col("i").cast("int").alias("i"), F.col(value).cast("double").alias("q"))


class Sketch:
    """Equiprobable cells with b + 1 markers, moved by parabolas: constant memory, one pass, order-dependent."""

    def __init__(self, bins: int):
        self.bins, self.q, self.at, self.n = bins, [], [], 0

    def add(self, x: float) -> None:
        self.n += 1
        if len(self.q) <= self.bins:
            bisect.insort(self.q, x)
            self.at = list(range(1, len(self.q) + 1))
            return
        q, at, b = self.q, self.at, self.bins
        k = bisect.bisect_right(q, x) - 1
        if k < 0:
            q[0], k = x, 0
        elif k >= b:
            q[b], k = max(q[b], x), b - 1
        for i in range(k + 1, b + 1):
            at[i] += 1
        for i in range(1, b):
            off = 1 + i * (self.n - 1) / b - at[i]
            if (off >= 1 and at[i + 1] - at[i] > 1) or (off <= -1 and at[i - 1] - at[i] < -1):
                s = 1 if off > 0 else -1
                up, down = (q[i + 1] - q[i]) / (at[i + 1] - at[i]), (q[i] - q[i - 1]) / (at[i] - at[i - 1])
                new = q[i] + s / (at[i + 1] - at[i - 1]) * ((at[i] - at[i - 1] + s) * up + (at[i + 1] - at[i] - s) * down)
                q[i] = new if q[i - 1] < new < q[i + 1] else q[i] + s * (q[i + s] - q[i]) / (at[i + s] - at[i])
                at[i] += s


def sketch(df: DataFrame, by: str, order: str, value: str, bins: int = 100) -> DataFrame:
    """(by, i, q) of the sketch fed in order; series of fewer than bins + 1 values give none.

    The sketch depends on the order of a whole series and has no merge, so a series is one task's work by definition;
    its memory is constant. quantiles() is exact and distributed.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Sketch(bins)
        for x in pdf.sort_values(order)[value]:
            s.add(float(x))
        n = len(s.q) if len(s.q) == bins + 1 else 0
        # the key keeps its own type where a series gives no rows
        return pd.DataFrame({by: pdf[by].iloc[[0] * n].reset_index(drop=True), "i": np.arange(n, dtype=np.int32), "q": s.q[:n]})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, order, value).groupBy(by).applyInPandas(fold, f"{by} {kind}, i int, q double")


def bin_mass(q: list[float], bins: int) -> list[float]:
    """The share of mass in each of so many equal display bins between the first and last quantile."""
    low, high = q[0], q[-1]
    width = (high - low) / bins or 1.0
    out = [0.0] * bins
    for a, b in zip(q[:-1], q[1:], strict=True):
        share = 1 / (len(q) - 1)
        first, last = min(bins - 1, int((a - low) / width)), min(bins - 1, int((b - low) / width))
        for k in range(first, last + 1):
            part = min(b, low + (k + 1) * width) - max(a, low + k * width)
            out[k] += share * (part / (b - a) if b > a else 1 / (last - first + 1))
    return out


def render(q: list[float], bins: int = 60, height: int = 10) -> str:
    """A histogram as text; too few quantiles give a message."""
    if len(q) < 101:
        return "too few values for a histogram"
    mass = bin_mass(q, bins)
    top = max(mass) or 1.0
    rows = ["".join("#" if m / top * height > r else " " for m in mass) for r in reversed(range(height))]
    return "\n".join([*rows, f"{q[0]:g}{' ' * max(1, bins - 12)}{q[-1]:g}"])


def nearest_rank(values: list[float], bins: int) -> list[float]:
    s = sorted(values)
    return [s[max(0, math.ceil(i * len(s) / bins) - 1)] for i in range(bins + 1)]
