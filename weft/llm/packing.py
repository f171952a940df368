"""Best-fit packing by bin completion.

Pieces differ only by length for the packer, so what is packed is the histogram of lengths, which never has more than
``capacity`` entries. Around the largest length left, branch and bound enumerates the undominated fillings of the rest
of a sequence, from the best-fit filling as incumbent; the least waste wins and is used as often as the counts allow.
Spark then deals the sequences' places out to the pieces.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import kernel as K
from .store import written
from .tokencount import load

#: Ids of so many distinct words are kept between blocks of a task.
MEMO = 300_000
#: Buckets in which pieces of one length are numbered side by side.
SALTS = 64

#: Classes of bytes in a word. Apostrophes (contractions), "<" (special strings), control bytes and all beyond ASCII but
#: accented Latin letters are left to the library.
LETTER, DIGIT, SIGN, HARD = range(4)
_KIND = np.full(256, HARD, dtype=np.int8)
_KIND[33:127] = SIGN
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3] = LETTER
_KIND[[0x27, 0x3C]] = HARD


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordIds:
    """Ids of texts by way of their distinct words: for vocabularies that drop white space, no token crosses it.

    Special strings are left as the library has them by default; they hold no white space.
    """

    def __init__(self, path: str):
        self.library, self.model = tokenizer(path), load(path)
        self.hashes, self.off, self.ids = np.zeros(0, dtype=K.U), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and the offsets of each document's."""
        starts, ends = K.runs(~K.SPACE[raw], off)
        first, _ = K.doc_of(starts, off)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(off), dtype=np.int64)
        h, at, inverse = np.unique(K.hash_slices(raw, starts, ends), return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        new = self.hashes[near] != h if len(self.hashes) else np.ones(len(h), dtype=bool)
        made, n_new = self._fresh(raw, starts[at[new]], ends[at[new]])
        old = np.flatnonzero(~new)
        n_old = np.diff(self.off)[near[old]]
        ids = np.concatenate([self.ids[K.ragged(self.off[:-1][near[old]], n_old)], made])
        where = np.concatenate([old, np.flatnonzero(new)])
        n, begin = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        n[where] = np.concatenate([n_old, n_new])
        begin[where] = np.concatenate([[0], np.cumsum(n[where])[:-1]])
        per = n[inverse]
        out = ids[K.ragged(begin[inverse], per)]
        to = np.concatenate([[0], np.cumsum(per)])
        self._keep(h, n, begin, ids, new)
        return out, to[first]

    def _fresh(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words not met before, in a row, and how many each has. Plain words merge as arrays, others in the library."""
        n = ends - starts
        if not len(n):  # a block may have met words alone
            return np.zeros(0, dtype=np.int32), n
        text = raw[K.ragged(starts, n)]
        to = np.concatenate([[0], np.cumsum(n)])
        kind = _KIND[text]
        lead = text == 0xC3  # Latin letters of two bytes
        after = np.concatenate([[False], lead[:-1]])
        kind[after & (text >= 0x80) & (text != 0x97) & (text != 0xB7)] = LETTER
        cut = np.zeros(len(text), dtype=bool)
        cut[to[:-1]] = True
        kind[np.concatenate([cut[1:] & lead[:-1], [bool(len(lead)) and bool(lead[-1])]])] = HARD
        hard = K.sums(kind == HARD, to) > 0
        text = K.LOWER[text]
        text[after & (text >= 0x80) & (text <= 0x9E)] += 32
        edge = cut | (kind == DIGIT)
        edge[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(edge)
        part_n = np.diff(np.append(begin, len(text)))
        owner = np.searchsorted(to, begin, side="right") - 1
        begin, part_n, owner = begin[~hard[owner]], part_n[~hard[owner]], owner[~hard[owner]]
        # distinct parts merge once
        _, first, same = np.unique(K.hash_slices(text, begin, begin + part_n), return_index=True, return_inverse=True)
        length = part_n[first]
        sym = self.model.of_byte[text[K.ragged(begin[first], length)]]
        last = np.cumsum(length) - 1
        sym[last] = self.model.of_last[text[(begin + part_n - 1)[first]]]
        size, where, pool, used = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64), [], 0
        for who, left, ids in self.model.merged(sym, length):
            size[who], where[who] = left, used + np.cumsum(left) - left
            pool.append(ids)
            used += len(ids)
        found = [x.ids for x in self.library.encode_batch_fast([raw[a:b].tobytes().decode() for a, b in zip(starts[hard], ends[hard], strict=True)], add_special_tokens=False)]
        pool.append(np.fromiter((t for x in found for t in x), dtype=np.int64, count=sum(map(len, found))))
        n_hard = np.array([len(x) for x in found], dtype=np.int64)
        owner = np.concatenate([owner, np.flatnonzero(hard)])
        size, where = np.concatenate([size[same], n_hard]), np.concatenate([where[same], used + np.cumsum(n_hard) - n_hard])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate(pool)[K.ragged(where[order], size[order])].astype(np.int32)
        return ids, np.bincount(owner, weights=size, minlength=len(n)).astype(np.int64)

    def _keep(self, h, n, begin, ids, new) -> None:
        if len(self.hashes) > MEMO:
            self.hashes, self.ids, self.off = h, ids[K.ragged(begin, n)], np.concatenate([[0], np.cumsum(n)])
            return
        hashes = np.concatenate([self.hashes, h[new]])
        order = np.argsort(hashes)
        n_all = np.concatenate([np.diff(self.off), n[new]])
        pool = np.concatenate([self.ids, ids])
        begins = np.concatenate([self.off[:-1], begin[new] + len(self.ids)])
        self.hashes, self.ids = hashes[order], pool[K.ragged(begins[order], n_all[order])]
        self.off = np.concatenate([[0], np.cumsum(n_all[order])])


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut at capacity ids."""
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        words = WordIds(vocabulary)
        for batch, raw, off in K.blocks(batches):
            ids, to = words.encode(raw, off)
            ids = np.insert(ids.astype("<u4"), to[1:], end_id)
            to = to + np.arange(len(to))
            n = np.diff(to)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = K.ragged(np.zeros(len(n), dtype=np.int64), count)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            flat = memoryview(ids.tobytes())
            begin = (to[doc] + start) * 4
            crc = np.array([zlib.crc32(flat[b : b + 4 * m]) for b, m in zip(begin.tolist(), length.tolist(), strict=True)], dtype=np.int64)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=names)

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Always the longest that fits."""
    out: list[int] = []
    used: dict[int, int] = {}
    while (i := bisect_right(lengths, room) - 1) >= 0:
        while i >= 0 and left[lengths[i]] - used.get(lengths[i], 0) <= 0:
            i -= 1
        if i < 0:
            break
        out.append(lengths[i])
        used[lengths[i]] = used.get(lengths[i], 0) + 1
        room -= lengths[i]
    return out


def fullest(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """A filling of room with the least waste, by a table of the sums that the first so many lengths reach, as bits."""
    reach, mask = [1], (1 << (room + 1)) - 1
    for n in lengths[: bisect_right(lengths, room)]:
        sums, count, step = reach[-1], min(left[n], room // n), 1
        while count > 0:
            step = min(step, count)
            sums |= (sums << (n * step)) & mask
            count, step = count - step, step * 2
        reach.append(sums)
        if sums >> room & 1:
            break
    rest, out = reach[-1].bit_length() - 1, []
    for i in range(len(reach) - 1, 0, -1):
        while not reach[i - 1] >> rest & 1:
            out.append(lengths[i - 1])
            rest -= lengths[i - 1]
    return out


def completion(lengths: list[int], left: dict[int, int], room: int, effort: int = 400) -> list[int]:
    """The filling of room with the least waste, from lengths (ascending) of which left[n] are there.

    Branch and bound over fillings in descending order of length. A branch is cut when all
    items that it may still take would leave no less waste than the incumbent. A filling is dominated if one of its items
    could give way to a longer one that still fits; it leaves more waste than that one, which comes first, so it is never
    taken, and among equal wastes the one with the longer items stays. A search of more than effort nodes is given up for
    fullest(), so the waste is the least in any case.
    """
    best = best_fit(lengths, left, room)
    waste = room - sum(best)
    nodes = 0
    total = list(accumulate(n * left[n] for n in lengths))  # of all items up to each length

    def grow(chosen: list[int], used: dict[int, int], rest: int, top: int) -> None:
        nonlocal best, waste, nodes
        i = min(top, bisect_right(lengths, rest) - 1)
        while i >= 0 and waste > 0 and nodes < effort and rest - total[i] < waste:
            n = lengths[i]
            if left[n] - used.get(n, 0) > 0:
                nodes += 1
                after = rest - n
                if after < waste:
                    best, waste = [*chosen, n], after
                if after >= lengths[0]:
                    used[n] = used.get(n, 0) + 1
                    grow([*chosen, n], used, after, i)
                    used[n] -= 1
            i -= 1

    if waste > 0 and lengths:
        grow([], {}, room, len(lengths) - 1)
        if waste > 0 and nodes >= effort:
            best = max(best, fullest(lengths, left, room), key=sum)
    return best


def _filled(histogram: dict[int, int], capacity: int, fill) -> list[tuple[list[int], int]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    out: list[tuple[list[int], int]] = []
    while lengths:
        big = lengths[-1]
        left[big] -= 1
        filling = [big, *fill(lengths, left, capacity - big)]
        left[big] += 1
        times = min(left[n] // filling.count(n) for n in set(filling))
        out.append((filling, times))
        for n in filling:
            left[n] -= times
        lengths = [n for n in lengths if left[n]]
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, longest first) and how many sequences have each; all pieces are placed.

    Full sequences early on can leave pieces that go badly together. So where bin completion does not meet the lower
    bound, the best-fit solution of the whole packing is held against it, and the one of fewer sequences stays.
    """
    completed = _filled(histogram, capacity, completion)
    used = lambda patterns: sum(times for _, times in patterns)
    if used(completed) <= -(-sum(n * c for n, c in histogram.items()) // capacity):
        return completed
    return min(completed, _filled(histogram, capacity, best_fit), key=used)


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from, to, sequence, offset): the pieces of a length numbered from..to-1 take that offset in sequence, sequence + 1, ..."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in patterns:
        offset = 0
        for n in filling:
            at = seen.get(n, 0)
            out.append((n, at, at + times, sequence, offset))
            seen[n] = at + times
            offset += n
        sequence += times
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece in its place.

    Null and empty texts are one piece of one id. Each row of docs is packed, equal rows and ids too; other columns are
    not read; an empty table gives no rows. To the driver goes one count for each length and salt, at most
    capacity * SALTS; a pattern is used until one of its lengths no longer suffices for it, so the patterns are about
    as many as the lengths, however many pieces there are.
    """
    table = written(pieces(docs, vocabulary, capacity, end_id, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(SALTS))), "pieces")
    spark = docs.sparkSession
    counts = table.groupBy("length", "salt").count().toPandas()  # at most capacity * SALTS rows
    counts = counts.sort_values(["length", "salt"])
    counts["before"] = counts.groupby("length")["count"].cumsum() - counts["count"]
    histogram = {int(n): int(c) for n, c in counts.groupby("length")["count"].sum().items()}
    slots = spark.createDataFrame(places(plan(histogram, capacity)) or [(0, 0, 0, 0, 0)], "length long, low long, high long, sequence long, offset long")
    first = spark.createDataFrame(list(counts[["length", "salt", "before"]].itertuples(index=False, name=None)) or [(0, 0, 0)], "length long, salt long, before long")
    number = F.expr("row_number() over (partition by length, salt order by row, piece) - 1")
    numbered = table.withColumn("n", number).join(F.broadcast(first), ["length", "salt"]).withColumn("n", F.col("n") + F.col("before"))
    # the slots of one length as one sorted array, in which the piece's is found by its number
    by_length = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "sequence", "offset"))).alias("slots"))
    got = numbered.join(F.broadcast(by_length), "length").withColumn("slot", F.expr("filter(slots, s -> s.low <= n and n < s.high)[0]"))
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("slot.sequence + n - slot.low").alias("sequence_id"), F.col("slot.offset").alias("offset"))
