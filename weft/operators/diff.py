"""What each commit changed: commits against their parent, as joins of tree snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Commits whose changes are found at a time.
SLICE = 1 << 21


def single_parent(commits: DataFrame) -> DataFrame:
    """Commits with exactly one parent, which is put in a column ``parent``; roots and merges are left out."""
    return commits.where(F.size("parents") == 1).withColumn("parent", F.col("parents")[0])


def with_trees(commits: DataFrame, strict: bool = False) -> DataFrame:
    """(repo, commit, t_new, t_old) of the single-parent commits whose parent is there; strict raises if one is missing."""
    have = commits.dropDuplicates(["repo", "sha"])
    kept = single_parent(have)
    parents = have.select("repo", F.col("sha").alias("parent"), F.col("tree_sha").alias("t_old"))
    if strict and kept.join(parents, ["repo", "parent"], "left_anti").limit(1).count():
        raise ValueError("a commit's parent is missing")
    return kept.join(parents, ["repo", "parent"]).select("repo", F.col("sha").alias("commit"), F.col("tree_sha").alias("t_new"), "t_old")


def _id(sha: Column) -> Column:
    """A hash in as few bytes as hold it, other names as they are; different names stay different."""
    return F.when(sha.rlike("^[0-9a-f]{40}$"), F.concat(F.lit(bytearray(1)), F.unhex(sha))).otherwise(F.concat(F.lit(bytearray(b"\1")), sha.cast("binary")))


def _name(number: Column) -> Column:
    """The name that _id() was made of."""
    rest = F.substring(number, 2, 1 << 30)
    return F.when(F.substring(number, 1, 1) == F.lit(bytearray(1)), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _trees(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(repo, tree, entries): each tree once, with its entries by name, in buckets for joins on (repo, tree)."""
    entry = F.struct("name", "mode", _id(F.col("sha")).alias("sha"))
    once = F.expr("filter(entries, (x, i) -> i = 0 or not (x.name <=> entries[i - 1].name))")
    found = entries.groupBy("repo", _id(F.col("tree_sha")).alias("tree")).agg(F.sort_array(F.collect_set(entry)).alias("entries"))
    return scratch.bucketed(found.withColumn("entries", once), "repo", "tree")


def _opened(level: DataFrame, trees: DataFrame) -> DataFrame:
    """The rows of level with each entry (name, mode, sha) of their tree in its place."""
    return level.join(trees, ["repo", "tree"]).select(*[c for c in level.columns if c != "tree"], F.inline("entries"))


def _leaves(trees: DataFrame, roots: DataFrame, scratch: Scratch, max_depth: int) -> DataFrame:
    """(repo, root, path, sha) of every leaf under the trees (repo, root)."""
    level = roots.select("repo", "root", F.lit("").alias("prefix"), F.col("root").alias("tree")).distinct()
    out = None
    for _ in range(max_depth):
        step = scratch.written(_opened(level, trees).select("repo", "root", F.concat("prefix", "name").alias("path"), "mode", "sha"))
        leaves = step.where("mode <> 'DIR'").select("repo", "root", "path", "sha")
        out = leaves if out is None else out.unionByName(leaves)
        level = step.where("mode = 'DIR'").select("repo", "root", F.concat("path", F.lit("/")).alias("prefix"), F.col("sha").alias("tree"))
        if level.isEmpty():
            break
    return out


def flatten(entries: DataFrame, roots: DataFrame, max_depth: int = 256) -> DataFrame:
    """(repo, root, path, sha) of every leaf under the trees (repo, root); directories without leaves give nothing."""
    with Scratch(entries.sparkSession) as scratch:
        found = _leaves(_trees(entries, scratch), roots.select("repo", _id(F.col("root")).alias("root")), scratch, max_depth)
        return scratch.written(found.select("repo", _name(F.col("root")).alias("root"), "path", _name(F.col("sha")).alias("sha")), scratch.path())


def _by_slices(commits: DataFrame, entries: DataFrame, changed) -> DataFrame:
    """The rows of changed(pairs, trees, scratch) over all pairs of a commit's tree and its parent's, a slice of the
    commits after the other, so that disk holds what one slice needs, the trees and the result."""
    with Scratch(commits.sparkSession) as scratch:
        pairs = scratch.written(with_trees(commits).select("repo", "commit", _id(F.col("t_new")).alias("t_new"), _id(F.col("t_old")).alias("t_old")))
        trees = _trees(entries, scratch)
        result, count, mark = scratch.path(), max(1, -(-pairs.count() // SLICE)), scratch.mark()
        for i in range(count):
            out = scratch.written(changed(pairs.where(F.pmod(F.xxhash64("repo", "commit"), F.lit(count)) == i), trees, scratch), result)
            scratch.drop_since(mark)
        return out


def changed_flat(commits: DataFrame, entries: DataFrame, max_depth: int = 256) -> DataFrame:
    """(repo, commit, path) changed against the parent: a full outer join of whole snapshots. A changed mode alone is no change."""

    def changed(pairs, trees, scratch):
        roots = pairs.select("repo", F.col("t_new").alias("root")).unionByName(pairs.select("repo", F.col("t_old").alias("root")))
        files = _leaves(trees, roots, scratch, max_depth)
        side = lambda tree, name: pairs.select("repo", "commit", F.col(tree).alias("root")).join(files, ["repo", "root"]).select("repo", "commit", "path", F.col("sha").alias(name))
        both = side("t_new", "new").join(side("t_old", "old"), ["repo", "commit", "path"], "full_outer")
        return both.where(~F.col("new").eqNullSafe(F.col("old"))).select("repo", "commit", "path")

    return _by_slices(commits, entries, changed)


def changed_pruned(commits: DataFrame, entries: DataFrame, max_depth: int = 256) -> DataFrame:
    """The same by levels: only directories whose hash differs are opened, so equal subtrees are never read.

    A name on one side only, or a file on one side and a directory on the other, gives all leaves of both.
    """

    def changed(pairs, trees, scratch):
        level = pairs.where("t_new <> t_old").withColumn("prefix", F.lit(""))
        out, whole = None, None
        for _ in range(max_depth):
            side = lambda tree, tag: _opened(level.select("repo", "commit", "prefix", F.col(tree).alias("tree")), trees).withColumnsRenamed({"mode": f"m_{tag}", "sha": f"s_{tag}"})  # noqa: B023, E731
            both = scratch.written(side("t_new", "n").join(side("t_old", "o"), ["repo", "commit", "prefix", "name"], "full_outer").where("not (s_n <=> s_o)").withColumn("path", F.concat("prefix", "name")).drop("prefix", "name"))
            deeper = both.where("m_n = 'DIR' and m_o = 'DIR'")
            rest = both.where("not (coalesce(m_n, '') = 'DIR' and coalesce(m_o, '') = 'DIR')")
            leaves = rest.where("coalesce(m_n, 'DIR') <> 'DIR' or coalesce(m_o, 'DIR') <> 'DIR'").select("repo", "commit", "path")
            dirs = [rest.where(f"m_{t} = 'DIR'").select("repo", "commit", "path", F.col(f"s_{t}").alias("root")) for t in "no"]
            out = leaves if out is None else out.unionByName(leaves)
            both_dirs = dirs[0].unionByName(dirs[1])
            whole = both_dirs if whole is None else whole.unionByName(both_dirs)
            level = deeper.select("repo", "commit", F.concat("path", F.lit("/")).alias("prefix"), F.col("s_n").alias("t_new"), F.col("s_o").alias("t_old"))
            if level.isEmpty():
                break
        under = whole.join(_leaves(trees, whole.select("repo", "root"), scratch, max_depth).withColumnRenamed("path", "below"), ["repo", "root"])
        return out.unionByName(under.select("repo", "commit", F.concat_ws("/", "path", "below").alias("path"))).distinct()

    return _by_slices(commits, entries, changed)


def snapshot_diff(pairs: DataFrame, entries: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """For flat snapshots: (commit, name) where the entries of ``commit`` and ``parent`` differ in value or presence."""
    side = lambda c, v: pairs.join(entries, pairs[c] == entries[key]).select("commit", name, F.col(value).alias(v))
    return side("commit", "new").join(side("parent", "old"), ["commit", name], "full_outer").where("not (new <=> old)").select("commit", name)
