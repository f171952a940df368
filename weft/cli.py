"""Command line: python -m weft.cli MODE ARGUMENTS. Graphs are folders with Parquet tables ``nodes`` and ``edges``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weft.operators import dataset, diff, evaluate, graph, model, sampling, stats
from weft.sources import objects, textfiles


def graph_rows(nodes, edges):
    return nodes.groupBy("repo").agg(F.count("*").alias("num_nodes")).join(graph.adjacency(edges), "repo", "left")


def load_graph(spark, path):
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_graph(spark, a):
    """Builds the graphs of a job file."""
    job = textfiles.jobs(spark.read.text(a.input))
    files = [r.value for r in job.where("kind = 'file'").collect()]  # a job names its files itself
    found = objects.selected(objects.read_objects(spark, *files), job)
    changed = diff.changed_pruned(objects.commits(found), objects.tree_entries(found)).withColumnRenamed("path", "item")
    nodes, edges = graph.build_graphs(changed, "item", a.edges_min, a.edges_max)
    number = nodes.select("repo", F.col("item").alias("k"), F.col("node").cast("long").alias("n"))
    by = lambda c: number.select("repo", F.col("k").alias(c), F.col("n").alias(f"n_{c}"))
    edges = edges.join(by("lo"), ["repo", "lo"]).join(by("hi"), ["repo", "hi"]).select("repo", F.col("n_lo").alias("lo"), F.col("n_hi").alias("hi"), "weight")
    nodes.withColumn("node", F.col("node").cast("long")).write.mode("overwrite").parquet(f"{a.output}/nodes")
    edges.write.mode("overwrite").parquet(f"{a.output}/edges")


def print_stats(spark, a):
    nodes, edges = load_graph(spark, a.input)
    found = stats.graph_stats(nodes, edges, graph.degrees(nodes, graph.adjacency(edges)))
    stats.write_stats(found, a.output) if a.output else found.show(1000, truncate=False)


def prepare_data(spark, a):
    h = model.Hyper(seed=a.seed)
    real = sampling.instances(graph_rows(*load_graph(spark, a.input)), h.gen_instances, h.recf_count, h.recf_nodes, h.seed)
    c = sampling.random_changes(spark, max(1, a.random), a.seed).select("repo", "commit", "item").distinct()
    nodes, edges = graph.build_graphs(c)
    ids = nodes.select("repo", "item", F.col("node").cast("long").alias("n"))
    edges = edges.join(ids.select("repo", F.col("item").alias("lo"), F.col("n").alias("a")), ["repo", "lo"]).join(ids.select("repo", F.col("item").alias("hi"), F.col("n").alias("b")), ["repo", "hi"]).select("repo", F.col("a").alias("lo"), F.col("b").alias("hi"), "weight")
    random = sampling.instances(graph_rows(nodes, edges), h.gen_instances, h.recf_count, h.recf_nodes, h.seed, kind="random")
    mixed = dataset.mix(real, random)
    mixed.withColumn("x", dataset.normalised(F.col("x")).cast("array<float>")).write.mode("overwrite").parquet(a.output)


def train(spark, a):
    p, losses = model.train(spark.read.parquet(a.input), model.Hyper(batch_count=a.batch_count, seed=a.seed), a.epochs)
    model.save(spark, p, a.output)
    print(f"loss {losses[-1]:.6f} after {len(losses)} steps")


def print_data_info(spark, a):
    dataset.data_info(spark.read.parquet(a.input)).show()


def dump_graph(spark, a):
    nodes, edges = load_graph(spark, a.input)
    name = graph.nth_graph(nodes, a.index).select("repo").first()[0]
    graph.write_gdf(nodes.where(F.col("repo") == name), edges.where(F.col("repo") == name), a.output)


def dump_graph_random(spark, a):
    c = sampling.random_changes(spark, 1, a.seed).select("repo", "commit", "item").distinct()
    graph.write_gdf(*graph.build_graphs(c, edges_min=1), a.output)


def grid_search(spark, a):
    evaluate.running_best(model.random_search(spark.read.parquet(a.input), model.Hyper(seed=a.seed), a.trials), "trial", "loss_test").show(a.trials, truncate=False)


def cross_validate(spark, a):
    scored = model.predict(spark.read.parquet(a.input), model.load(spark, a.params), model.Hyper().recf_count)
    evaluate.rates(evaluate.confusion(scored)).show(truncate=False)


def classify(spark, a):
    """Scores graphs; the older form's missing normalisation is kept behind --raw."""
    h = model.Hyper(seed=a.seed)
    drawn = sampling.instances(graph_rows(*load_graph(spark, a.input)), a.samples, h.recf_count, h.recf_nodes, h.seed, falsify_of_256=0)
    x = drawn if a.raw else drawn.withColumn("x", dataset.normalised(F.col("x")).cast("array<float>"))
    found = evaluate.classify(model.predict(x, model.load(spark, a.params), h.recf_count))
    found.show(1000, truncate=False)
    evaluate.totals(found).show()


MODES = {f.__name__: f for f in (write_graph, print_stats, prepare_data, train, print_data_info, dump_graph, dump_graph_random, grid_search, cross_validate, classify)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weft")
    p.add_argument("mode", choices=MODES)
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    for name, kind, default in (("edges-min", int, graph.EDGES_MIN), ("edges-max", int, graph.EDGES_MAX), ("seed", int, 1), ("samples", int, 8), ("index", int, 0), ("trials", int, 10), ("epochs", int, 10), ("batch-count", int, 256), ("random", int, 64), ("params", str, None)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--raw", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.mode == "dump_graph_random" and a.output is None:
        a.output = a.input
    spark = SparkSession.builder.appName("weft").getOrCreate()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="weft-"))
    MODES[a.mode](spark, a)


if __name__ == "__main__":
    main()
