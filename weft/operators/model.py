"""A small classifier of instances: shared dense layers for each neighbourhood, then dense layers over all."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Hyper:
    """Settings; out of range values raise."""

    batch_count: int = 256
    batch_size: int = 256
    recf_nodes: int = 8
    recf_count: int = 8
    gen_instances: int = 32
    a1: int = 24
    a2: int = 32
    b1: int = 72
    b2: int = 32
    learning_rate: float = 0.1
    decay: int = 0
    dropout: float = 1.0
    l2: float = 0.0
    seed: int = 1
    test_frac: float = 0.1

    def __post_init__(self):
        whole = (self.batch_count, self.batch_size, self.recf_nodes, self.recf_count, self.gen_instances, self.a1, self.a2, self.b1, self.b2)
        if min(whole) < 1 or not 0 <= self.learning_rate < 1 or self.decay < 0 or not 0.1 <= self.dropout <= 1 or self.l2 < 0 or not 0 <= self.test_frac <= 1:
            raise ValueError(f"out of range: {self}")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        w = {"a1": (self.recf_nodes**2, self.a1), "a2": (self.a1, self.a2), "b1": (self.a2 * self.recf_count, self.b1), "b2": (self.b1, self.b2), "b3": (self.b2, 1)}
        return {f"{k}w": s for k, s in w.items()} | {f"{k}b": (s[1],) for k, s in w.items()}


Params = dict[str, np.ndarray]
LAYERS = ("a1", "a2", "b1", "b2", "b3")


def init(h: Hyper) -> Params:
    """Weights from a normal distribution cut at 1, with deviation 0.05; no bias."""
    rng = np.random.default_rng(h.seed)
    return {k: np.clip(rng.normal(0, 0.05, s), -1, 1) if k.endswith("w") else np.zeros(s) for k, s in h.shapes().items()}


def forward(p: Params, x: np.ndarray, fields: int, keep: float = 1.0, rng: np.random.Generator | None = None):
    """The output z of each instance, and what the backward pass needs. x: (instances, fields * nodes^2)."""
    a = x.reshape(len(x) * fields, -1)
    saved = []
    for name in LAYERS:
        if name == "b1":
            a = a.reshape(len(x), -1)
        z = a @ p[f"{name}w"] + p[f"{name}b"]
        if name == "b3":
            saved.append((a, None, None))
            return z[:, 0], saved
        out = np.tanh(z)
        mask = (rng.random(out.shape) < keep) / keep if rng is not None and keep < 1 else None
        saved.append((a, out, mask))
        a = out * mask if mask is not None else out


def score(z):
    """2 sigmoid(z) - 1."""
    return np.tanh(z / 2)


def loss(y: np.ndarray, z: np.ndarray) -> float:
    """Mean cross-entropy of labels 1 and -1."""
    return float(np.mean(np.logaddexp(0, -2 * y * z)))


def bce(y: Column, z: Column) -> Column:
    """ln(1 + exp(-2yz)), in a form that large z do not overflow."""
    return F.greatest(-2 * y * z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(2 * y * z)))


def l2_penalty(p: Params, l2: float) -> float:
    """Half the squared weights (biases left out), times l2 over the number of parameters."""
    return l2 / sum(v.size for v in p.values()) * sum(0.5 * float((v * v).sum()) for k, v in p.items() if k.endswith("w"))


def gradient(p: Params, x: np.ndarray, y: np.ndarray, fields: int, keep: float = 1.0, rng=None) -> tuple[Params, float]:
    """Summed (not mean) gradient of the loss, and the summed loss."""
    z, saved = forward(p, x, fields, keep, rng)
    back = (-2 * y / (1 + np.exp(np.clip(2 * y * z, -60, 60))))[:, None]
    out: Params = {}
    for name, (a, act, mask) in zip(reversed(LAYERS), reversed(saved), strict=True):
        if act is not None:
            back = back.reshape(act.shape)
            back = (back * mask if mask is not None else back) * (1 - act * act)
        out[f"{name}w"], out[f"{name}b"] = a.T @ back, back.sum(0)
        back = back @ p[f"{name}w"].T
    return out, float(np.logaddexp(0, -2 * y * z).sum())


def rate(h: Hyper, epoch: int) -> float:
    """The learning rate, halved every ``decay`` epochs."""
    return h.learning_rate * 0.5 ** (epoch // h.decay) if h.decay else h.learning_rate


def train(instances: DataFrame, h: Hyper, epochs: int = 10, start: Params | None = None) -> tuple[Params, list[float]]:
    """Gradient descent, one step an epoch and shard of ``batch_count``: executors sum gradients over their rows, the driver adds
    one small table a step and updates. Unlabelled instances (y = 0) are skipped; start continues from saved parameters. Returns parameters and the loss of each step."""
    p, losses = start or init(h), []
    total = sum(v.size for v in p.values())
    names = list(p)
    labelled = instances.where("y <> 0").withColumn("shard", F.pmod(F.xxhash64("instance_id"), F.lit(h.batch_count))).select("shard", "x", "y").cache()
    for epoch in range(epochs):
        for shard in range(h.batch_count):

            def part(batches, p=p, epoch=epoch, shard=shard):
                rng = np.random.default_rng([h.seed, epoch, shard])
                for pdf in batches:
                    if len(pdf):
                        g, total_loss = gradient(p, np.stack(pdf["x"]).astype(float), pdf["y"].to_numpy(float), h.recf_count, h.dropout, rng)
                        yield pd.DataFrame({"n": [len(pdf)], "loss": [total_loss], "g": [np.concatenate([g[k].ravel() for k in names])]})

            rows = labelled.where(F.col("shard") == shard).mapInPandas(part, "n long, loss double, g array<double>").collect()
            n = sum(r.n for r in rows)
            if not n:
                continue
            flat = np.sum([np.array(r.g) for r in rows], axis=0) / n
            at = 0
            new = {}
            for k in names:
                step = flat[at : at + p[k].size].reshape(p[k].shape)
                at += p[k].size
                new[k] = p[k] - rate(h, epoch) * (step + (h.l2 / total * p[k] if k.endswith("w") else 0))
            p = new
            losses.append(sum(r.loss for r in rows) / n)
    labelled.unpersist()
    return p, losses


def predict(instances: DataFrame, p: Params, fields: int) -> DataFrame:
    """instances with y_hat between -1 and 1."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(score(forward(p, np.stack(x).astype(float), fields)[0]) if len(x) else [], dtype=float)

    return instances.withColumn("y_hat", run("x"))


def save(spark: SparkSession, p: Params, path: str) -> None:
    spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in p.items()], "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Params:
    return {r.name: np.array(r["values"]).reshape(r.shape) for r in spark.read.parquet(path).collect()}


def random_hyper(base: Hyper, trial: int, seed: int = 1) -> Hyper:
    """Settings drawn for a trial of the random search."""
    rng = np.random.default_rng([seed, trial])
    dropout = float(rng.uniform(0.5, 1))
    layer = lambda: max(1, int(round(math.exp(rng.uniform(math.log(2), math.log(128))) / dropout)))
    return replace(base, batch_size=int(rng.integers(64, 513)), learning_rate=float(rng.uniform(0.03, 0.35)), decay=int(rng.integers(10, 120)), a1=layer(), a2=layer(), b1=layer(), b2=layer(), dropout=dropout, l2=float(rng.uniform(0, 50)))


def random_search(instances: DataFrame, base: Hyper, trials: int, steps: int = 50, seed: int = 1, max_rows: int = 20_000) -> DataFrame:
    """(trial, loss_train, loss_test, settings...): one trial a task, on a sample of at most max_rows instances, the last test_frac of it as test."""
    spark = instances.sparkSession
    rows = instances.where("y <> 0").orderBy(F.xxhash64("instance_id"), "instance_id").limit(max_rows).select("x", "y").toPandas()
    x, y = np.stack(rows["x"]).astype(float), rows["y"].to_numpy(float)
    cut = max(1, int(len(y) * (1 - base.test_frac)))
    held = spark.sparkContext.broadcast((x, y))

    def run(batches):
        x, y = held.value
        for pdf in batches:
            for t in pdf["id"]:
                h = random_hyper(base, int(t), seed)
                rng, p = np.random.default_rng([seed, int(t)]), init(h)
                for step in range(steps):
                    at = rng.integers(0, cut, h.batch_size)
                    g, _ = gradient(p, x[at], y[at], h.recf_count, h.dropout, rng)
                    p = {k: v - rate(h, step * h.batch_size // cut) * (g[k] / h.batch_size) for k, v in p.items()}
                z = forward(p, x, h.recf_count)[0]
                yield pd.DataFrame([(int(t), loss(y[:cut], z[:cut]), loss(y[cut:], z[cut:]) if cut < len(y) else None, h.batch_size, h.learning_rate, h.decay, h.a1, h.a2, h.b1, h.b2, h.dropout, h.l2)], columns=TRIAL)

    return spark.range(trials).repartition(trials).mapInPandas(run, "trial long, loss_train double, loss_test double, batch long, rate double, decay long, a1 long, a2 long, b1 long, b2 long, dropout double, l2 double")


TRIAL = ["trial", "loss_train", "loss_test", "batch", "rate", "decay", "a1", "a2", "b1", "b2", "dropout", "l2"]
