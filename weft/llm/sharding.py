"""Sharding by extendible hashing.

A directory of hash-prefix bits: every bucket above the byte limit, and no other, splits on one more bit. The sizes of
all buckets of several depths come from one aggregation, so the splits of many levels are found at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ROW, drop, numbered, scratch, written

#: Depths looked at in one round.
LEVELS = 6
MAX_DEPTH = 62
#: Rows that all bits leave together are numbered in so many parts.
SALTS = 64
_AT = "__weft_at"


def _prefix(depth) -> F.Column:
    """The first depth bits of a 62-bit hash."""
    return F.shiftright(F.col("bits"), MAX_DEPTH - depth) if isinstance(depth, int) else F.expr(f"shiftright(bits, {MAX_DEPTH} - {depth})")


def assign(items: DataFrame, limit: int) -> DataFrame:
    """items (item long, bits long, bytes long) with depth and prefix of their shard; overflow numbers a bucket's pages.

    Each round settles the buckets that fit within some of the next depths; what is still too large goes on. Items that
    all bits leave together share a bucket in pages of whole items, of at most limit bytes or of one item above it.
    """
    total = items.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth, least = 0, total
    while least > limit and depth < MAX_DEPTH - LEVELS:
        depth, least = depth + 1, least / 2
    low, rest, done = max(0, depth - 2), items, []
    first = True
    while True:
        high = min(MAX_DEPTH, low + LEVELS)
        cells = rest.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0 if first else low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
        fits = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("sum")).where(F.col("sum") <= limit)
        settled = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        marked = written(rest.withColumn("cell", _prefix(high)).join(settled, "cell", "left").drop("cell"), "shards")
        done.append(marked.where("depth is not null").withColumn("overflow", F.lit(0).cast("long")))
        rest = marked.where("depth is null").drop("depth")
        if rest.isEmpty():
            break
        if high == MAX_DEPTH:
            at = written(rest.withColumn("at", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS))), "overflow")
            parts = at.groupBy("bits", "salt").agg(F.count("*").alias("n"), F.max("bytes").alias("most"))
            before = F.expr("sum(n) over (partition by bits order by salt) - n")
            a_page = F.expr(f"greatest(1, {limit} div max(most) over (partition by bits))")
            parts = parts.select("bits", "salt", before.alias("before"), a_page.alias("a_page"))
            number = F.expr("row_number() over (partition by bits, salt order by at) - 1")
            paged = at.withColumn("number", number).join(parts, ["bits", "salt"]).withColumn("overflow", F.expr("(before + number) div a_page"))
            done.append(paged.withColumn("depth", F.lit(MAX_DEPTH)).select(*rest.columns, "depth", "overflow"))
            break
        low, first = high, False
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("prefix", _prefix("depth"))


def shards(docs: DataFrame, limit: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, shard (its hash prefix as bits; after a dot the overflow page), depth, n_bytes of the text.

    The hash is of the id and the text. A null id hashes as null does, a null text has no bytes. Equal rows have equal
    hashes and stay together, in overflow pages if they pass the limit. A single text above the limit is a shard of its
    own with what shares its 62 bits. Other columns are not read; an empty table gives none.
    """
    return _assigned(docs, limit, id_col, text_col).select(F.col("item").alias("doc_id"), "shard", F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("n_bytes"))


def _assigned(docs: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """assign() of the rows of docs with their shard's name; of numbered() docs with the column ROW."""
    items = docs.select(
        F.col(id_col).cast("long").alias("item"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")), 2).alias("bits"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"),
        *([ROW] if ROW in docs.columns else []),
    )
    got = assign(written(items, "shard-items"), limit)
    bits = F.expr("if(depth = 0, '', right(lpad(bin(prefix), 64, '0'), depth))")
    name = F.when(F.col("overflow") > 0, F.concat(bits, F.lit("."), F.col("overflow").cast("string"))).otherwise(bits)
    return got.withColumn("shard", name)


def directory(assigned: DataFrame) -> DataFrame:
    """The directory of a result of shards(): bytes and documents of each shard."""
    return assigned.groupBy("shard", "depth").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))


def write_shards(docs: DataFrame, path: str, limit: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs, every row and all columns, as Parquet in one folder a shard: shard=<name>, of which "all" is the only
    one where nothing is split. Rows without an id and repeated rows go where shards() has them."""
    table = numbered(docs, "rows")
    with scratch():
        named = _assigned(table, limit, id_col, text_col).select(F.col(ROW).alias(_AT), F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias("shard"))
        table.join(named, F.col(ROW) == F.col(_AT)).drop(_AT, ROW).repartition("shard").write.partitionBy("shard").parquet(path)
    drop(table)
