"""Co-change graphs from change sets (repo, commit, item): nodes, weighted edges, adjacency, packed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGES_MIN, EDGES_MAX = 10, 50_000_000


def node_ids(changed: DataFrame, item: str = "item") -> DataFrame:
    """(repo, item, node): numbers from 0 in the order of items, for items changed at least once.

    One window a repository: the distinct items of a repository are sorted in one task.
    """
    items = changed.select("repo", item).distinct()
    return items.withColumn("node", F.row_number().over(Window.partitionBy("repo").orderBy(item)) - 1)


def commit_sizes(changed: DataFrame) -> DataFrame:
    return changed.distinct().groupBy("repo", "commit").agg(F.count("*").alias("n"))


def within_guard(changed: DataFrame, edges_max: int = EDGES_MAX) -> DataFrame:
    """Change sets of repositories none of whose commits alone makes too many pairs; such a commit drops its repository."""
    over = commit_sizes(changed).where(F.col("n") * (F.col("n") - 1) / 2 > edges_max).select("repo").distinct()
    return changed.join(over, "repo", "left_anti")


def edges(changed: DataFrame, item: str = "item") -> DataFrame:
    """(repo, lo, hi, weight): how many commits changed both. Pairs come from each commit's sorted set, so none is made twice."""
    sets = changed.groupBy("repo", "commit").agg(F.array_sort(F.collect_set(item)).alias("items")).where(F.size("items") > 1)
    first = sets.select("repo", "items", F.posexplode("items").alias("i", "lo"))
    pairs = first.select("repo", "lo", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("hi"))
    return pairs.groupBy("repo", "lo", "hi").agg(F.count("*").alias("weight"))


def edge_limits(edge: DataFrame, edges_min: int = EDGES_MIN, edges_max: int = EDGES_MAX) -> DataFrame:
    """The repositories whose number of edges lies within the limits, with that number."""
    return edge.groupBy("repo").agg(F.count("*").alias("num_edges")).where(F.col("num_edges").between(edges_min, edges_max))


def build_graphs(changed: DataFrame, item: str = "item", edges_min: int = EDGES_MIN, edges_max: int = EDGES_MAX) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the repositories within the limits."""
    safe = within_guard(changed, edges_max)
    edge = edges(safe, item)
    kept = edge_limits(edge, edges_min, edges_max).select("repo")
    return node_ids(safe, item).join(kept, "repo", "left_semi"), edge.join(kept, "repo", "left_semi")


def adjacency(edge: DataFrame) -> DataFrame:
    """(repo, node, other, weight), each edge in both directions."""
    return edge.select("repo", "weight", F.explode(F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")))).alias("e")).select("repo", "e.node", "e.other", "weight")


def one_direction(adj: DataFrame) -> DataFrame:
    return adj.where("node < other")


def degrees(nodes: DataFrame, adj: DataFrame, node: str = "node") -> DataFrame:
    """(repo, node, degree), 0 for nodes without edges."""
    return nodes.select("repo", node).join(adj.groupBy("repo", F.col("node").alias(node)).agg(F.count("*").alias("d")), ["repo", node], "left").select("repo", node, F.coalesce("d", F.lit(0)).alias("degree"))


def csr_offsets(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """(repo, node, start, stop): each node's slice of the adjacency sorted by node and other."""
    w = Window.partitionBy("repo").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    return degrees(nodes, adj).withColumn("stop", F.sum("degree").over(w)).select("repo", "node", (F.col("stop") - F.col("degree")).alias("start"), "stop")


def pack(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """One row a graph: (repo, offsets, adj). A graph's arrays must fit in a row; larger graphs stay as tables."""
    offsets = csr_offsets(nodes, adj).groupBy("repo").agg(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.array_sort(F.collect_list(F.struct("node", "stop"))), lambda s: s["stop"])).alias("offsets"))
    rows = adj.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "other", "weight"))), lambda s: F.struct(s["other"].cast("int").alias("other"), s["weight"].cast("int").alias("weight"))).alias("adj"))
    return offsets.join(rows, "repo", "left").select("repo", "offsets", F.coalesce("adj", F.array().cast("array<struct<other:int,weight:int>>")).alias("adj"))


def unpack(graphs: DataFrame) -> DataFrame:
    """(repo, node, other, weight) of packed rows."""
    node = graphs.select("repo", "adj", F.explode(F.sequence(F.lit(1), F.greatest(F.size("offsets") - 1, F.lit(1)))).alias("i"), "offsets").where("i < size(offsets)")
    part = node.select("repo", (F.col("i") - 1).cast("long").alias("node"), F.explode(F.expr("slice(adj, cast(offsets[i - 1] as int) + 1, cast(offsets[i] - offsets[i - 1] as int))")).alias("e"))
    return part.select("repo", "node", F.col("e.other").cast("long").alias("other"), F.col("e.weight").cast("long").alias("weight"))


def nth_graph(graphs: DataFrame, index: int, order: str = "repo") -> DataFrame:
    """The graph at a place, from 0, in the order given; raises if there are fewer."""
    found = graphs.select(order).distinct().orderBy(order).limit(index + 1)
    if found.count() <= index:
        raise IndexError(f"no graph {index}")
    name = found.agg(F.max(order)).first()[0]
    return graphs.where(F.col(order) == F.lit(name))


def gdf(nodes: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of a graph exchange file: node names, and edges by falling weight (ties by ends)."""
    return nodes.select(F.col("node").cast("string").alias("name")).orderBy(F.col("node")), edge.select(F.col("lo").alias("node1"), F.col("hi").alias("node2"), F.col("weight").cast("double").alias("weight")).orderBy(F.desc("weight"), "node1", "node2")


def write_gdf(nodes: DataFrame, edge: DataFrame, path: str) -> None:
    """Writes the exchange file as lines of text in order, in one part."""
    n, e = gdf(nodes, edge)
    lines = n.select(F.lit(1).alias("s"), F.monotonically_increasing_id().alias("o"), F.col("name").alias("value"))
    ends = e.select(F.lit(3).alias("s"), F.monotonically_increasing_id().alias("o"), F.concat_ws(",", "node1", "node2", F.col("weight").cast("long")).alias("value"))
    heads = n.sparkSession.createDataFrame([(0, 0, "nodedef>name VARCHAR"), (2, 0, "edgedef>node1 VARCHAR,node2 VARCHAR,weight DOUBLE")], "s int, o long, value string")
    heads.unionByName(lines).unionByName(ends).orderBy("s", "o").select("value").coalesce(1).write.text(path)
