"""The toy repository, worked out by hand: what each commit changed, and the graph of it."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import diff, graph, quantiles, stats
from weft.sources import graphfile, objects

SNAPSHOTS = [
    ("c0", [], {"a": 1, "d/b": 1, "d/c": 1, "g": 1}),
    ("c1", ["c0"], {"a": 2, "d/b": 2, "d/c": 1, "g": 1}),
    ("c2", ["c1"], {"a": 3, "d/b": 2, "e": 1, "g": 1}),
    ("c3", ["c2"], {"a": 3, "d/b": 2, "e/f": 1, "g": 1}),
    ("c4", ["c2", "c3"], {"a": 3, "d/b": 2, "e/f": 1, "g": 1}),
    ("c5", ["c4"], {"a": 3, "d/b": 2, "e/f": 1, "g": 1}),
    ("c6", ["c5"], {"a": 4, "d/b": 2, "e/f": 1, "g": 1}),
]


def toy():
    import hashlib

    h = lambda kind, body: hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).digest()
    out, shas, made = [], {}, set()
    for name, parents, files in SNAPSHOTS:
        tops = {}
        for path, v in files.items():
            top, _, rest = path.partition("/")
            tops.setdefault(top, {})[rest] = h("blob", str(v).encode())
        entries = []
        for top, below in sorted(tops.items()):
            if "" in below:
                entries.append((b"100644", top.encode(), below[""]))
            else:
                body = b"".join(b"100755 " + k.encode() + b"\0" + s for k, s in sorted(below.items()))
                if body not in made:
                    out.append(("tree", body))
                    made.add(body)
                entries.append((b"40000", top.encode(), h("tree", body)))
        body = b"".join(m + b" " + n + b"\0" + s for m, n, s in entries)
        if body not in made:
            out.append(("tree", body))
            made.add(body)
        commit = b"tree " + h("tree", body).hex().encode() + b"\n" + b"".join(b"parent " + shas[p].encode() + b"\n" for p in parents) + b"author x\n\n" + name.encode()
        shas[name] = h("commit", commit).hex()
        out.append(("commit", commit))
    return out, shas


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    found, shas = toy()
    path = tmp_path_factory.mktemp("o") / "stream.gz"
    path.write_bytes(objects.encode([("x/y", found), ("header/only", None), ("z/z", found)]))
    obj = objects.read_objects(spark, str(path))
    commits, entries = objects.commits(obj), objects.tree_entries(obj)
    return commits, entries, shas


def test_changes_both_ways(changed):
    commits, entries, shas = changed
    name = {v: k for k, v in shas.items()}
    want = {("c1", "a"), ("c1", "d/b"), ("c2", "a"), ("c2", "d/c"), ("c2", "e"), ("c3", "e"), ("c3", "e/f"), ("c6", "a")}
    for f in (diff.changed_flat, diff.changed_pruned):
        rows = f(commits, entries).collect()
        for repo in ("x/y", "z/z"):
            assert {(name[r.commit], r.path) for r in rows if r.repo == repo} == want
        assert len(rows) == 16


def test_graph_of_the_toy(changed, spark):
    commits, entries, _ = changed
    c = diff.changed_flat(commits, entries).where("repo = 'x/y'").withColumnRenamed("path", "item")
    nodes, edges = graph.build_graphs(c, edges_min=1)
    assert [(r.item, r.node) for r in nodes.orderBy("node").collect()] == [("a", 0), ("d/b", 1), ("d/c", 2), ("e", 3), ("e/f", 4)]
    assert {(r.lo, r.hi, r.weight) for r in edges.collect()} == {("a", "d/b", 1), ("a", "d/c", 1), ("a", "e", 1), ("d/c", "e", 1), ("e", "e/f", 1)}
    assert graph.build_graphs(c)[1].count() == 0  # five edges are below the default limit
    number = {r.item: r.node for r in nodes.collect()}
    e = spark.createDataFrame([("x/y", number[r.lo], number[r.hi], r.weight) for r in edges.collect()], "repo string, lo long, hi long, weight long")
    n = nodes.withColumn("node", F.col("node").cast("long"))
    adj = graph.adjacency(e)
    packed = graph.pack(n, adj).first()
    assert list(packed.offsets) == [0, 3, 4, 6, 9, 10]
    assert [x.other for x in packed.adj] == [1, 2, 3, 0, 0, 3, 0, 2, 4, 3]
    assert sorted(map(tuple, graph.unpack(graph.pack(n, adj)).collect())) == sorted(map(tuple, adj.select("repo", "node", "other", "weight").collect()))
    s = stats.graph_stats(n, e, graph.degrees(n, adj)).first()
    assert (s.num_nodes, s.num_edges, s.density, s.degree_median, s.degree_min, s.degree_max) == (5, 5, 0.25, 2, 1, 3)
    assert abs(s.degree_stddev - 0.8**0.5) < 1e-12 and s.weight_stddev == 0
    with pytest.raises(IndexError):
        graph.nth_graph(e, 3)


def test_gdf(spark, tmp_path):
    n = spark.createDataFrame([("r", 0), ("r", 1), ("r", 2)], "repo string, node long")
    e = spark.createDataFrame([("r", 0, 1, 1), ("r", 1, 2, 5), ("r", 0, 2, 1)], "repo string, lo long, hi long, weight long")
    graph.write_gdf(n, e, str(tmp_path / "g"))
    text = next((tmp_path / "g").glob("part*")).read_text().split("\n")
    assert text[:-1] == ["nodedef>name VARCHAR", "0", "1", "2", "edgedef>node1 VARCHAR,node2 VARCHAR,weight DOUBLE", "1,2,5", "0,1,1", "0,2,1"]


def test_graph_file_round_trip(spark, tmp_path):
    graphs = [("a/b", [0, 1, 2], [(1, 3), (0, 3)]), ("lonely", [0, 0], []), ("none", [0], [])]
    (tmp_path / "g.bin").write_bytes(graphfile.encode_file(graphs))
    rows = graphfile.read_graphs(spark, str(tmp_path / "g.bin")).orderBy("graph_index").collect()
    assert [(r.name, list(r.offsets), [tuple(x) for x in r.adj]) for r in rows] == graphs
    with pytest.raises(ValueError):
        list(graphfile.decode_file(b"nope"))
    with pytest.raises(ValueError):
        list(graphfile.decode_file(graphfile.encode_file(graphs)[:-3]))
    # copies that overlap themselves: "ab" and then ten bytes from two back
    assert graphfile.lz4_decode(bytes([0x26]) + b"ab" + bytes([2, 0]) + bytes([0x10]) + b"c", 13) == b"abababababab" + b"c"


def test_object_stream_errors():
    good = objects.encode([("r", [("commit", b"tree " + b"0" * 40 + b"\n")])], compress=False)
    assert len(list(objects.decode(good))) == 1
    bad = bytearray(good)
    bad[-25] ^= 1
    with pytest.raises(Exception):  # noqa: B017  the sum of the payload is wrong
        list(objects.decode(bytes(bad)))
    big = objects.encode([("r", [("tree", b"x" * 200_000)])], compress=False)
    assert len(next(objects.decode(big))[3]) == 200_000


def test_edges_equal_a_self_join(spark):
    rng = np.random.default_rng(1)
    rows = {("r", int(c), int(i)) for c, i in zip(rng.integers(0, 40, 300), rng.integers(0, 20, 300), strict=True)}
    c = spark.createDataFrame(sorted(rows), "repo string, commit long, item long")
    want = {}
    for k in {r[1] for r in rows}:
        for a, b in itertools.combinations(sorted(r[2] for r in rows if r[1] == k), 2):
            want[a, b] = want.get((a, b), 0) + 1
    got = {(r.lo, r.hi): r.weight for r in graph.edges(c).collect()}
    assert got == want
    d = graph.degrees(graph.node_ids(c).select("repo", F.col("item").alias("node")), graph.adjacency(graph.edges(c)))
    assert d.agg(F.sum("degree")).first()[0] == 2 * len(want)


def test_quantiles_and_sketch(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    got = [r.q for r in quantiles.quantiles(df, "k", "v", 100).orderBy("i").collect()]
    assert got == quantiles.nearest_rank(x.tolist(), 100)
    near = [r.q for r in quantiles.sketch(df.withColumnRenamed("i", "at"), "k", "at", "v").orderBy("i").collect()]
    assert len(near) == 101 and max(abs(a - b) for a, b in zip(got[5:-5], near[5:-5], strict=True)) < 0.1
    assert quantiles.sketch(df.where("i < 50").withColumnRenamed("i", "at"), "k", "at", "v").count() == 0
    assert abs(sum(quantiles.bin_mass(got, 60)) - 1) < 1e-9
    assert quantiles.render([1.0]).startswith("too few")


def test_changes_in_slices(changed, spark, monkeypatch, tmp_path):
    """The same rows from slices of few commits; afterwards disk holds nothing but the result."""
    import os

    commits, entries, _ = changed
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    for f in (diff.changed_flat, diff.changed_pruned):
        want = sorted(map(tuple, f(commits, entries.unionByName(entries)).collect()))
        before = {x for x in os.listdir(folder) if x.startswith(("weft-", "rdd-"))}
        monkeypatch.setattr(diff, "SLICE", 3)
        got = f(commits, entries)
        monkeypatch.undo()
        assert sorted(map(tuple, got.collect())) == want and len(want) == 16
        left = {x for x in os.listdir(folder) if x.startswith(("weft-", "rdd-"))} - before
        assert len(left) == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("weft_")]


def test_names_of_hashes(spark):
    names = ["a" * 40, "A" * 40, "t1", "", "\1x", "ü" * 20, None, "0123456789abcdef" * 2 + "01234567", "0" * 39]
    rows = spark.createDataFrame([(x,) for x in names], "sha string").select("sha", diff._id(F.col("sha")).alias("id")).select("sha", F.length("id").alias("n"), diff._name(F.col("id")).alias("back")).collect()
    assert [r.back for r in rows] == names and [r.n for r in rows] == [21, 41, 3, 1, 3, 41, None, 21, 40]
