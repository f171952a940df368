"""Benchmark decontamination by greedy string tiling.

Spark joins the rolling hashes of every k words of the texts to those of the benchmark items (shared-token seeds). Runs
of seeds along a diagonal are the matches of k words or more; the longest that touches no marked word is marked as a
tile, again and again, and an item counts as leaked when its tiles cover enough of it, in whatever order they stand.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .licenses import WORD
from .store import without_ids

#: Benchmarks of up to so many bytes of text are broadcast (some 40 bytes a word); larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def _words(raw: np.ndarray, off: np.ndarray):
    starts, ends = K.runs(WORD[raw], off)
    first, doc = K.doc_of(starts, off)
    return K.hash_slices(raw, starts, ends), first, doc


def _lower(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pc.utf8_lower(batch.column(at).fill_null("")))


def item_grams(benchmark: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (hash, item_id, pos, size) of every k-gram of the items, and the hash of its first word."""

    def run(batches):
        for batch, raw, off in K.blocks(map(_lower, batches)):
            h, first, doc = _words(raw, off)
            keys, at = K.windows(h, doc, k)
            ids = batch.column(0).take(pa.array(doc[at]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids, pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(np.diff(first)[doc[at]].astype(np.int32))], names=["hash", "item_id", "pos", "size"])

    chosen = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "hash long, item_id long, pos int, size int")


def text_grams(docs: DataFrame, k: int, vocabulary: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """Rows (row, doc_id, grams) with grams a list of (at, hash); with a vocabulary, only k-grams of its words, as no other can match."""

    def run(batches):
        for batch, raw, off in K.blocks(map(_lower, batches)):
            h, first, doc = _words(raw, off)
            keys, at = K.windows(h, doc, k)
            if vocabulary is not None and len(h):
                near = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                known = np.concatenate([[0], np.cumsum(vocabulary[near] == h)]) if len(vocabulary) else np.zeros(len(h) + 1)
                keep = known[at + k] - known[at] == k
                keys, at = keys[keep], at[keep]
            per = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(off) - 1))]).astype(np.int32)
            place = (at - first[doc[at]]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(place), pa.array(keys.view(np.int64))], ["at", "hash"]))
            some = pa.array(np.diff(per) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], names=["row", "doc_id", "grams"]).filter(some)

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "row long, doc_id long, grams array<struct<at:int,hash:long>>")


def tile(at: np.ndarray, pos: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the places of equal k-grams: tiles (at, pos, length) that share no word of either side."""
    order = np.lexsort((at, at - pos))
    at, pos = at[order], pos[order]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(at - pos) != 0)]))
    length = np.diff(np.append(edge, len(at))) + k - 1
    heap = [(-int(n), int(a), int(p)) for n, a, p in zip(length, at[edge], pos[edge], strict=True)]
    heapq.heapify(heap)
    text: set[int] = set()
    item: set[int] = set()
    tiles = []
    while heap:
        n, a, p = heapq.heappop(heap)
        free = [i for i in range(-n) if a + i not in text and p + i not in item]
        if len(free) == -n:
            tiles.append((a, p, -n))
            text.update(range(a, a - n))
            item.update(range(p, p - n))
            continue
        run = []
        for i in [*free, None]:
            if run and i != run[-1] + 1 if i is not None else run:
                if len(run) >= k:
                    heapq.heappush(heap, (-len(run), a + run[0], p + run[0]))
                run = []
            if i is not None:
                run.append(i)
    return tiles


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 4, min_cover: float = 0.5, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, cover, n_tiles, longest, first_word, last_word): texts whose tiles cover an item to min_cover
    at least and by min_words words (or the whole item, if it is shorter).

    Words are runs of letters and digits, lower-cased. Items of fewer than k words cannot match. Null and empty texts or
    items match nothing; each row of docs counts for itself, so equal ids give equal rows; other columns are not read;
    with an empty table on either side the result is empty.
    """
    grams = item_grams(benchmark, k)
    text_bytes = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    small = text_bytes <= broadcast_bytes
    vocabulary = None
    if small:

        def words(batches):
            for _, raw, off in K.blocks(map(_lower, batches)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_words(raw, off)[0]).view(np.int64))], names=["h"])

        found = benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(words, "h long").distinct().toPandas()["h"]  # below broadcast_bytes
        vocabulary = np.sort(found.to_numpy(dtype=np.int64).view(K.U))
    each = text_grams(docs, k, vocabulary, id_col, text_col).select("row", "doc_id", F.explode("grams").alias("g")).select("row", "doc_id", "g.at", "g.hash")
    seeds = each.join(F.broadcast(grams) if small else grams, "hash")
    pairs = (
        seeds.groupBy("row", "item_id")
        .agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.collect_list("at").alias("at"), F.collect_list("pos").alias("pos"))
        .where(F.size(F.array_distinct("pos")) * k >= F.least(F.col("size"), F.greatest(F.lit(float(min_words)), F.lit(min_cover) * F.col("size"))))
        .select("doc_id", "item_id", "size", "at", "pos")
    )
    names = ["doc_id", "item_id", "cover", "n_tiles", "longest", "first_word", "last_word"]

    def run(batches):
        for batch in batches:
            out = []
            for doc, item, size, at, pos in zip(*(batch.column(i) for i in range(5)), strict=True):
                tiles = tile(np.asarray(at.values), np.asarray(pos.values), k)
                covered, size = sum(t[2] for t in tiles), size.as_py()
                if covered >= min(size, max(min_words, min_cover * size)):
                    out.append((doc.as_py(), item.as_py(), covered / size, len(tiles), max(t[2] for t in tiles), min(t[0] for t in tiles), max(t[0] + t[2] - 1 for t in tiles)))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return pairs.mapInArrow(run, "doc_id long, item_id long, cover double, n_tiles long, longest long, first_word long, last_word long")


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    return without_ids(docs, contamination(docs, benchmark, **kw).where("doc_id is not null").select("doc_id"), "doc_id")
