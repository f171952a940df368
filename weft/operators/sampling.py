"""Random neighbourhoods of graphs, and random graphs."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.hashing import perturbed
from weft.functions.scalar import normal_cdf, normal_inv


def frontier_step(adj: DataFrame, visited: DataFrame, last: DataFrame) -> DataFrame:
    """(repo, other, weight): what the last node of each repo adds to its frontier; nodes visited are left out."""
    seen = visited.select("repo", F.col("node").alias("other"))
    return adj.join(last.select("repo", "node"), ["repo", "node"]).select("repo", "other", "weight").join(seen, ["repo", "other"], "left_anti")


def grow(offsets: np.ndarray, other: np.ndarray, weight: np.ndarray, root: int, count: int, rng: np.random.Generator, falsify: bool = False) -> list[int]:
    """Nodes of a neighbourhood: each step adds the newest node's neighbours to a frontier that sums weights, and draws
    the next node from it with probability in proportion to (weight - 1) squared, or evenly if that is 0 for all."""
    out, frontier = [root], {}
    while len(out) < count:
        a, b = offsets[out[-1]], offsets[out[-1] + 1]
        near, w = other[a:b], weight[a:b]
        if falsify and len(near):
            w = perturbed(np.full(len(near), out[-1]), near, w)
        for v, x in zip(near.tolist(), w.tolist(), strict=True):
            if v not in out:
                frontier[v] = frontier.get(v, 0) + x
        if not frontier:
            break
        nodes = list(frontier)
        p = np.array([(frontier[v] - 1.0) ** 2 for v in nodes])
        p = p / p.sum() if p.sum() > 0 else np.full(len(nodes), 1 / len(nodes))
        chosen = nodes[rng.choice(len(nodes), p=p)]
        out.append(chosen)
        del frontier[chosen]
    return out


def matrix(offsets, other, weight, nodes: list[int], size: int, falsify: bool = False) -> np.ndarray:
    """The symmetric matrix of weights between the nodes, 0 elsewhere."""
    out = np.zeros((size, size), dtype=np.float32)
    place = {v: i for i, v in enumerate(nodes)}
    for i, v in enumerate(nodes):
        a, b = offsets[v], offsets[v + 1]
        w = weight[a:b]
        if falsify and b > a:
            w = perturbed(np.full(b - a, v), other[a:b], w)
        for u, x in zip(other[a:b].tolist(), np.asarray(w).tolist(), strict=True):
            if u in place and place[u] != i:
                out[i, place[u]] = x
    return out


def csr(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Node count, offsets, neighbours and weights of one graph's rows (node, other, weight, num_nodes)."""
    n = int(pdf["num_nodes"].iloc[0])
    pdf = pdf[pdf["other"].notna()].sort_values(["node", "other"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(pdf["node"].astype(np.int64), minlength=n))]).astype(np.int64)
    return n, offsets, pdf["other"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)


def instances(graph_rows: DataFrame, per_graph: int, fields: int = 8, nodes: int = 8, seed: int = 1, falsify_of_256: int = 85, kind: str = "real") -> DataFrame:
    """(instance_id, repo, kind, x, y): per graph so many instances of ``fields`` neighbourhoods, some with false weights.

    graph_rows: (repo, node, other, weight, num_nodes), one row with null ends for a graph without edges; graphs without
    nodes give none. Each graph draws from a generator seeded by the seed and its name, so results do not depend on how
    graphs are dealt to tasks. A single graph is one task's work, as a walk needs all of it.
    """

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["repo"].iloc[0]
        rng = np.random.default_rng([seed, *name.encode()])
        n, offsets, other, weight = csr(pdf)
        rows = []
        for i in range(per_graph if n else 0):
            false = kind == "real" and rng.integers(256) < falsify_of_256
            parts = [matrix(offsets, other, weight, grow(offsets, other, weight, int(rng.integers(n)), nodes, rng, false), nodes, false) for _ in range(fields)]
            what = "perturbed" if false else kind
            rows.append((f"{name}#{i}", name, what, np.concatenate([p.ravel() for p in parts]), 1.0 if what == "real" else -1.0))
        return pd.DataFrame(rows, columns=["key", "repo", "kind", "x", "y"])

    drawn = graph_rows.groupBy("repo").applyInPandas(sample, "key string, repo string, kind string, x array<float>, y float")
    return drawn.withColumn("instance_id", F.xxhash64("key")).select("instance_id", "repo", "kind", "x", "y")


# Distributions of the size of random graphs and of their commits.
NODES = (2565.8616745774, 0.0186871905261577)
COMMITS = (582.189712734868, 0.780733999863337)
DENSITY = (9.66738e-10, 6.04831e-06, 0.0160384, 1.001)
SPREAD = 0.209583
COMMIT_SIZE = (0.782874, 0.999893, 0.870283)


def random_sizes(rng: np.random.Generator) -> tuple[int, int]:
    """Numbers of nodes and commits of a random graph; they hang together by a truncated normal."""
    u = rng.random()
    n = math.ceil(NODES[0] * math.log(1 + NODES[1] / (1 - u) ** 2))
    f = 1 - 1 / math.sqrt(((DENSITY[0] * n + DENSITY[1]) * n + DENSITY[2]) * n + DENSITY[3])
    low, high = normal_cdf(-f / SPREAD), normal_cdf((1 - f) / SPREAD)
    d = f + SPREAD * normal_inv(min(max(low + rng.random() * (high - low), 1e-300), 1 - 1e-16))
    d = min(max(d, 0.0), 1 - 1e-9)
    return n, max(1, math.ceil(COMMITS[0] * ((1 - d) ** -COMMITS[1] - 1)))


def _commits(batches, seed: int):
    for pdf in batches:
        for g in pdf["graph"]:
            rng = np.random.default_rng([seed, int(g)])
            n, m = random_sizes(rng)
            sizes = np.ceil(COMMIT_SIZE[0] / (1 - COMMIT_SIZE[1] * rng.random(m)) ** COMMIT_SIZE[2]).astype(np.int64)
            for a in range(0, m, 10_000):
                size = sizes[a : a + 10_000]
                yield pd.DataFrame({"repo": f"random{g}", "commit": np.repeat(np.arange(a, a + len(size)), size), "item": rng.integers(0, n, int(size.sum())), "num_nodes": n})


def random_changes(spark: SparkSession, graphs: int, seed: int = 1) -> DataFrame:
    """(repo, commit, item, num_nodes) of random graphs; members are drawn with replacement and may repeat in a commit."""
    numbers = spark.range(graphs).select(F.col("id").alias("graph")).repartition(max(1, min(graphs, 1000)))
    return numbers.mapInPandas(partial(_commits, seed=seed), "repo string, commit long, item long, num_nodes long")
