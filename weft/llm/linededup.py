"""Line dedup by a deletion-neighbourhood join, with words as the unit of edits.

Two lines are within one edit if they are equal, or equal but for one word that differs, or one has a word more. So a
line emits, as hashed keys, itself and all variants with one word left out; lines whose variants are equal are joined,
their edit distance is verified on their words, and a line goes if an earlier line (by document id, then place) matches.

Equal lines are collapsed first. Of the rest only lines that share a half with another line, as any two lines within one
edit do, emit variants. Groups are never spelled out in pairs: a key keeps its earliest lines only.

Lines of more edits, in proportion to their length, have too many variants. They meet by winnowed windows of words, of
which two such lines share one for certain; there their lengths, the window's places and parities of their words by hash
bucket must fit the edit bound, and each line names only its earliest fitting lines. Their distance is verified as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .blobs import narrow
from .blobs import pack as _pack
from .blobs import unpack as _unpack
from .store import ROW, drop, numbered, scratch, small_batches, written

_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
#: Bits of a sieve for each hash that it lets through, at least (few hashes often sift many) and at most (32 MB): a full
#: sieve costs time, not results.
SIEVE_SHARE, SIEVE_LEAST, SIEVE_MOST = 16, 1 << 16, 1 << 28
#: Words of the windows by which lines of more than one edit are found.
WINDOW = 5
#: Bytes of text for each bucket of windows, and in each block; fitting lines held at a time.
PER_BUCKET, BLOCK, HELD = 8 << 20, 2 << 20, 1 << 20
#: Bits of the sketches of lines, and of those of more than LONG_LINE words; a print of more than OFTEN lines is frequent.
SHORT_BITS, LONG_BITS, LONG_LINE, OFTEN = 128, 1024, 256, 64
#: Lines that a line names at once; a line that matches none of them and has more asks again for all.
NAMED = 16
#: Lines of more words than this in all have their words compared as bags before their edits are counted.
BAGS = 160
#: Documents whose ids are broadcast when they are asked for again; more are found by a sieve.
FEW_DOCS = 1_000_000
#: A line is hot if more than one in so many of all lines are its copies.
HOT_LINES = 2000


#: Columns of without_lines() that no table of documents has.
_AT, _GONE = "__weft_at", "__weft_gone"


class Sums:
    """Polynomial hashes of segments of one sequence, from its prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power = np.ones(n + 1, dtype=K.U)
        inverse = np.ones(n + 2, dtype=K.U)
        power[1:] = K.U(_B)
        inverse[1:] = K.U(_B_INV)
        power, self.inverse = np.cumprod(power), np.cumprod(inverse)
        self.to = np.zeros(n + 1, dtype=K.U)
        np.cumsum(values * power[:-1], out=self.to[1:])

    def segment(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.to[b] - self.to[a]) * self.inverse[a]

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The segment from a to b with item i left out."""
        return (self.to[i] - self.to[a]) * self.inverse[a] + (self.to[b] - self.to[i + 1]) * self.inverse[a + 1]


def _key(h: np.ndarray, n: np.ndarray, side: int) -> np.ndarray:
    return K.mix(h ^ K.mix(n.astype(K.U) * K.U(2) + K.U(side)))


def _lines(raw: np.ndarray, off: np.ndarray):
    """Lines with a word: document, number within it, first word and end; and the hashes of all words."""
    low = K.LOWER[raw]
    starts, ends = K.runs(~K.SPACE[low], off)
    breaks = np.flatnonzero(low == 10)
    in_doc = np.searchsorted(breaks, off)
    _, doc = K.doc_of(starts, off)
    number = np.repeat(np.arange(len(breaks) + 1), np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(starts))) - in_doc[doc]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])) if len(starts) else np.zeros(0, dtype=np.int64)
    return doc[edge], number[edge], edge, np.append(edge[1:], len(starts)) if len(edge) else edge, K.hash_slices(low, starts, ends)


def _row(docs: DataFrame) -> F.Column:
    return F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


KEYS = "row long, doc_id long, line int, h long, k0 long, k1 long, k2 long, k3 long, part long, body binary"


def line_keys(docs: DataFrame, min_words: int, words_an_edit: int | None = None, bits: int = 0) -> DataFrame:
    """Rows (row, doc_id, line, h, k0..k3): each line with a word, its hash, and for lines of min_words words the hashes of
    its halves, as a line of n words (k0 first, k1 second half) and as one of n - 1 words and an extra one (k2, k3). With
    words_an_edit also rows (part, body), print_blobs() of the lines."""
    names = [x.split(" ")[0] for x in KEYS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.binary()]
    runs = -(-(2 * words_an_edit - 2) // 3) if words_an_edit else 0
    if words_an_edit and runs < WINDOW:
        raise ValueError("too many edits for windows of so many words")

    def run(batches):
        for batch, raw, off in K.blocks(batches, limit=BLOCK):
            doc, number, a, b, words = _lines(raw, off)
            sums, n = Sums(words), b - a
            h = K.mix(sums.segment(a, b) + n.astype(K.U))
            half, less = n // 2, np.maximum(n - 1, 0)
            short = n < min_words
            keys = [_key(sums.segment(a, a + half), n, 0), _key(sums.segment(a + half, b), n, 1), _key(sums.segment(a, a + less // 2), less, 0), _key(sums.segment(b - (less - less // 2), b), less, 1)]
            take = pa.array(doc)
            none = [pa.nulls(len(h), t) for t in types[8:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(h.view(np.int64)), *(pa.array(k.view(np.int64), mask=short) for k in keys), *none], names=names)
            if words_an_edit:
                long = n >= 2 * words_an_edit - 2
                of = batch.column(1)
                order = np.where(of.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, of.fill_null(0).to_numpy(zero_copy_only=False))
                parts, out = print_blobs(words, sums, a[long], n[long], h[long], order[doc[long]], runs, bits)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(out), t) for t in types[:8]), pa.array(parts, pa.int64()), pa.array(out, pa.binary())], names=names)

    return _chosen(docs).mapInArrow(run, KEYS)


def _bits(h: np.ndarray, n_bits: int) -> np.ndarray:
    h, last = h.view(K.U), K.U(n_bits - 1)
    return np.concatenate([h & last, K.mix(h) & last]).astype(np.int64)


def sieve(lines: DataFrame) -> bytes:
    """A Bloom filter of the column h, of SIEVE_SHARE bits or more for each row, SIEVE_LEAST at least and SIEVE_MOST at most."""
    n_bits = min(SIEVE_MOST, max(SIEVE_LEAST, 1 << (SIEVE_SHARE * lines.count()).bit_length()))

    def run(batches):
        found = np.zeros(n_bits, dtype=bool)
        for batch in batches:
            found[_bits(batch.column(0).to_numpy(zero_copy_only=False), n_bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found).tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in lines.select("h").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():  # one at a time, of eight
        whole |= np.frombuffer(r.bits, dtype=np.uint8)
    return whole.tobytes()


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the sieve lets each hash through."""
    at = _bits(h, 8 * len(bits))
    hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return hit[: len(h)] & hit[len(h) :]


def line_words(docs: DataFrame, passes: bytes, of_docs: bytes) -> DataFrame:
    """Rows (h, doc_id, line, words) of the lines that the sieve lets through, in documents whose id of_docs lets through;
    words as 32-bit hashes."""
    names = ["h", "doc_id", "line", "words"]
    held = docs.sparkSession.sparkContext.broadcast((passes, of_docs))

    def asked(batches, ids):
        for batch in batches:
            yield batch.filter(pa.array(_passes(ids, batch.column(3).to_numpy(zero_copy_only=False))))

    def run(batches):
        bits, ids = (np.frombuffer(x, dtype=np.uint8) for x in held.value)
        for batch, raw, off in K.blocks(asked(batches, ids), limit=BLOCK):
            doc, number, a, b, words = _lines(raw, off)
            n = b - a
            h = K.mix(Sums(words).segment(a, b) + n.astype(K.U))
            keep = np.flatnonzero(_passes(bits, h))
            code = (words >> K.U(32)).astype("<u4")[K.ragged(a[keep], n[keep])]
            offsets = np.concatenate([[0], np.cumsum(n[keep] * 4)]).astype(np.int32)
            take = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), batch.column(1).take(take), pa.array(number[keep].astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(offsets), pa.py_buffer(code.tobytes())])], names=names)

    return _chosen(docs).withColumn("id", F.xxhash64("doc_id")).mapInArrow(run, "h long, doc_id long, line int, words binary")


def variants(lines: DataFrame) -> DataFrame:
    """Rows (key, pos, doc_id, row, line): each line itself (pos -1) and with the word at pos left out, in the halves that need it."""
    names = ["key", "pos", "doc_id", "row", "line"]

    def run(batches):
        for batch in batches:
            for part in range(0, batch.num_rows, 4000):
                some = batch.slice(part, 4000)
                raw, off = K.text_of(some.column(3).cast(pa.large_binary()).view(pa.large_string()))
                words = K.mix(np.frombuffer(raw.tobytes(), dtype="<u4").astype(K.U) + K.U(1))
                to = off // 4
                a, n = to[:-1], np.diff(to)
                sums = Sums(words)
                less = n - 1
                front, back = (some.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (4, 5))
                low = np.where(front, 0, less // 2)
                high = np.where(back, n, np.maximum(n // 2, n - (less - less // 2)))
                count = np.maximum(high - low, 0)
                line = np.repeat(np.arange(len(n)), count)
                pos = K.ragged(low, count)
                key = np.concatenate([sums.segment(a, a + n) + n.astype(K.U), sums.without(a[line], a[line] + n[line], a[line] + pos) + less[line].astype(K.U)])
                line, pos = np.concatenate([np.arange(len(n)), line]), np.concatenate([np.full(len(n), -1), pos])
                take = pa.array(line)
                yield pa.RecordBatch.from_arrays([pa.array(K.mix(key).view(np.int64)), pa.array(pos.astype(np.int32)), *(some.column(i).take(take) for i in (1, 0, 2))], names=names)

    return lines.select("row", "doc_id", "line", "words", "front", "back").mapInArrow(run, "key long, pos int, doc_id long, row long, line int")


def _one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    differ = np.flatnonzero(a[: len(b)] != b)
    if not len(differ):
        return True
    i = int(differ[0])
    return bool((a[i + 1 :] == b[i + 1 :]).all() if len(a) == len(b) else (a[i + 1 :] == b[i:]).all())


def halves(distinct: DataFrame) -> DataFrame:
    """Rows (h, back, front) of the distinct lines (h, k0..k3) that share a half with another: in which halves an edit may be."""
    keys = distinct.where("k0 is not null").select("h", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("side", "key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    # a shared first half leaves the edit to the back, a shared second half to the front
    return keys.join(shared, "key").groupBy("h").agg(F.max(F.col("side").isin(0, 2)).alias("back"), F.max(F.col("side").isin(1, 3)).alias("front"))


def words_of(docs: DataFrame, distinct: DataFrame, sides: DataFrame | None, also: DataFrame | None) -> DataFrame:
    """A written table (h, row, doc_id, line, words, front, back) of the distinct lines (h, id) that are in sides, which are
    halves(), or in also (h); front and back tell in which half an edit may be."""
    if also is not None:
        no = F.lit(False)
        also = also.select("h", no.alias("back"), no.alias("front"))
        sides = also if sides is None else sides.unionByName(also).groupBy("h").agg(F.max("back").alias("back"), F.max("front").alias("front"))
    some = written(sides.join(distinct.select("h", "id"), "h"), "halves")
    of = some.select(F.col("id.doc_id").alias("__weft_of")).distinct()
    if of.limit(FEW_DOCS + 1).count() <= FEW_DOCS:  # their texts alone go to the workers
        docs = docs.join(F.broadcast(of), F.col("doc_id").cast("long").eqNullSafe(F.col("__weft_of")), "left_semi")
    words = line_words(docs, sieve(some), sieve(some.select(F.xxhash64("id.doc_id").alias("h"))))
    # by place as well as by hash, so that the copies of a common line do not meet; of rows with one id, either has the words
    place = some.select(F.col("h").alias("_h"), "front", "back", F.col("id.doc_id").alias("d"), F.col("id.row").alias("row"), F.col("id.line").alias("l"))
    found = words.join(place, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l")))
    lines = written(found.dropDuplicates(["h"]).select("h", "row", "doc_id", "line", "words", "front", "back"), "lines")
    drop(some)
    return lines


def near_lines(lines: DataFrame) -> DataFrame:
    """Rows (h, best): for lines of words_of(), the earliest line before it that is one edit away."""
    every = variants(lines.where("front or back"))
    many = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    ids = written(every.join(many, "key").select("key", "pos", F.struct("doc_id", "row", "line").alias("id")), "variants")
    same = ids.groupBy("key", "pos").agg(F.min("id").alias("same"))
    cross = same.groupBy("key").agg(F.min(F.expr("if(pos < 0, same, null)")).alias("whole"), F.min(F.expr("if(pos < 0, null, same)")).alias("longer"))
    # the earliest line with the same word left out, and the earliest that has one word more or less
    best = same.join(cross, "key").select("key", "pos", F.expr("least(same, if(pos < 0, longer, whole))").alias("best"))
    pairs = ids.join(best, ["key", "pos"]).where("best < id").groupBy("id").agg(F.min("best").alias("best"))
    of = lines.select(F.struct("doc_id", "row", "line").alias("at"), "h", "words")
    checked = pairs.join(of, F.col("id").eqNullSafe(F.col("at"))).select("h", "best", F.col("words").alias("a")).join(of.select("at", F.col("words").alias("b")), F.col("best").eqNullSafe(F.col("at"))).select("h", "best", "a", "b")

    def verify(batches):
        for batch in batches:
            ok = [_one_edit(np.frombuffer(a.as_py(), dtype="<u4"), np.frombuffer(b.as_py(), dtype="<u4")) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["h", "best"]).filter(pa.array(ok, pa.bool_()))

    return checked.mapInArrow(verify, "h long, best struct<doc_id:long,row:long,line:int>").groupBy("h").agg(F.min("best").alias("best"))


def _left_over(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words of a, and of b, the other has not, each as often as it stands there. An edit changes each by one at most."""
    words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(at[: len(a)], minlength=len(words)) - np.bincount(at[len(a) :], minlength=len(words))
    return int(more[more > 0].sum()), int(-more[more < 0].sum())


def _edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to replace, put in or leave out to make b of a; -1 if more than most. By the furthest reach on each diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > most or n + m > BAGS and max(_left_over(a, b)) > most:
        return -1
    stops: dict[int, np.ndarray] = {}

    def slide(i: int, k: int) -> int:
        low, end = max(0, -k), min(n, m - k)
        if k not in stops:
            stops[k] = np.flatnonzero(a[low:end] != b[low + k : end + k]) + low
        at = int(np.searchsorted(stops[k], i))
        return int(stops[k][at]) if at < len(stops[k]) else end

    reach = {0: slide(0, 0)}
    for d in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return d
        after = {}
        for k in range(max(-d - 1, m - n - most + d + 1), min(d + 1, m - n + most - d - 1) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -1), reach.get(k + 1, -2) + 1)
            if i >= 0:
                after[k] = slide(min(i, n, m - k), k)
        reach = after
    return -1


def _sketch(words: np.ndarray, first: np.ndarray, n_bits: int) -> np.ndarray:
    """Of each run of words, from first[i] to first[i + 1], the parities of its words by hash bucket: n_bits in numbers of
    64. An edit changes two at most."""
    n = len(first) - 1
    bucket = (words >> K.U(32)) & K.U(n_bits - 1)
    at = np.repeat(np.arange(n) * (n_bits // 64), np.diff(first)) + (bucket >> K.U(6)).astype(np.int64)
    out = np.zeros(n * n_bits // 64, dtype=K.U)
    np.bitwise_xor.at(out, at, K.U(1) << (bucket & K.U(63)))
    return out.reshape(n, n_bits // 64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many parities sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k values in a row, from those of 1, 2, 4, ... in a row."""
    size = 1
    while size < k:
        step = min(size, k - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def print_blobs(words: np.ndarray, sums: Sums, a: np.ndarray, n: np.ndarray, h: np.ndarray, doc: np.ndarray, runs: int, bits: int) -> tuple[list[int], list[bytes]]:
    """Hash buckets, and for each the windows' hashes of the lines of n words from a that may be two edits or more from others.

    Of n words with n // words_an_edit edits, at least runs in a row stay as they are. Of as many windows as fit in a run
    the least hash is taken, so two lines with a common run have a common print.
    """
    if not len(a):
        return [], []
    pick = runs - WINDOW + 1
    at = K.ragged(a, n - WINDOW + 1)
    hashes = K.mix(sums.segment(at, at + WINDOW))
    first = np.cumsum(n - WINDOW + 1) - (n - WINDOW + 1)
    count = n - runs + 1
    begin = K.ragged(first, count)
    view = np.lib.stride_tricks.sliding_window_view(hashes, pick)
    least = _least(hashes, pick)[begin]
    owner = np.repeat(np.arange(len(a)), count)
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
    prints, owner = least[new], owner[new]
    place = begin[new] + view[begin[new]].argmin(axis=1) - first[owner]
    sketch = _sketch(words[K.ragged(a, n)], np.concatenate([[0], np.cumsum(n)]), SHORT_BITS)
    long = n > LONG_LINE
    fine = _sketch(words[K.ragged(a[long], n[long])], np.concatenate([[0], np.cumsum(n[long])]), LONG_BITS)
    nth = np.cumsum(long) - 1
    part = (prints >> K.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), dtype=np.int64)
    order = np.argsort(part, kind="stable")
    parts, cut = np.unique(part[order], return_index=True)
    out = []
    for x, y in zip(cut, [*cut[1:], len(order)], strict=True):
        mine = order[x:y]
        who, line = np.unique(owner[mine], return_inverse=True)
        out.append(_pack(print=prints[mine], line=narrow(line), place=narrow(place[mine]), h=h[who], doc=doc[who], n=narrow(n[who]), s0=sketch[who, 0], s1=sketch[who, 1], fine=fine[nth[who[long[who]]]].reshape(-1)))
    return parts.tolist(), out


def fitting(blobs: DataFrame, words_an_edit: int, asking: bytes | None = None) -> DataFrame:
    """Rows (h, other, more): for a line, lines of the same or a lesser document id that share a print with it and fit the bound.

    Of each bucket a line names the NAMED first or so, and more tells that it has others yet. With asking, a sieve, only
    the lines that it lets through name any, and they name all.
    """
    held = blobs.sparkSession.sparkContext.broadcast(asking) if asking else None
    schema = "h long, other long, more boolean"

    def meet(table: pa.Table) -> pa.Table:
        got = [_unpack(x) for x in table.column("body").to_pylist()]
        base = np.cumsum([0, *(len(g["h"]) for g in got)])
        prints = np.concatenate([g["print"] for g in got])
        line = np.concatenate([g["line"].astype(np.int64) + b for g, b in zip(got, base, strict=False)])
        place = np.concatenate([g["place"] for g in got]).astype(np.int64)
        h, doc, size = np.concatenate([g["h"] for g in got]), np.concatenate([g["doc"] for g in got]), np.concatenate([g["n"] for g in got]).astype(np.int64)
        sketch = np.stack([np.concatenate([g[c] for g in got]) for c in ("s0", "s1")], axis=1)
        fine = np.concatenate([g["fine"] for g in got]).reshape(-1, LONG_BITS // 64)
        nth = np.cumsum(size > LONG_LINE) - 1
        del got
        some = K.clashing(prints)  # most prints are of one line only
        prints, line, place = prints[some], line[some], place[some]
        # lines are numbered by document id, and of equal lines the first stands for all
        lines, at = np.unique(line, return_inverse=True)
        by_doc = np.argsort(doc[lines], kind="stable")
        lines = lines[by_doc]
        rank = np.empty(len(lines), dtype=np.int64)
        rank[by_doc] = np.arange(len(lines))
        h, doc, size, sketch, nth = h[lines], doc[lines], size[lines], sketch[lines], nth[lines]
        _, where, same = np.unique(h, return_index=True, return_inverse=True)
        line = where[same][rank[at]]
        order = np.lexsort((line, place, prints))
        prints, line, place = prints[order], line[order], place[order]
        fresh = np.ones(len(prints), dtype=bool)
        fresh[1:] = (prints[1:] != prints[:-1]) | (line[1:] != line[:-1]) | (place[1:] != place[:-1])
        prints, line, place = prints[fresh], line[fresh], place[fresh]
        step = np.zeros(len(prints), dtype=np.int64)
        step[1:] = prints[1:] != prints[:-1]
        which = np.cumsum(step)
        often = np.bincount(which)[which] > OFTEN
        asks = _passes(np.frombuffer(held.value, dtype=np.uint8), h) if held else np.ones(len(h), dtype=bool)
        found = [np.zeros(0, dtype=np.int64)]  # line << 32 | other line
        sides = (_by_place(which[~often], place[~often], line[~often], size, words_an_edit), _by_length(which[often], place[often], line[often], size, words_an_edit))
        for x, y in (pair for side in sides for pair in _spelled(*side)):
            edits = np.maximum(size[x], size[y]) // words_an_edit
            keep = (x != y) & (np.abs(size[x] - size[y]) <= edits)
            keep &= asks[x] | asks[y]
            x, y, edits = x[keep], y[keep], edits[keep]
            keep = _apart(sketch[x], sketch[y]) <= 2 * edits
            x, y, edits = x[keep], y[keep], edits[keep]
            both = np.flatnonzero((size[x] > LONG_LINE) & (size[y] > LONG_LINE))
            keep = np.ones(len(x), dtype=bool)
            keep[both] = _apart(fine[nth[x[both]]], fine[nth[y[both]]]) <= 2 * edits[both]
            x, y = x[keep], y[keep]
            early, late = np.minimum(x, y), np.maximum(x, y)
            tie = doc[early] == doc[late]  # which of the two comes first is told later
            found.append(K.distinct(np.concatenate([(late << 32 | early)[asks[late]], (early << 32 | late)[tie & asks[early]]])))
            if held is None and sum(map(len, found)) > HELD:
                found = [_some(found)[0]]
        if held is None:
            pairs, more = _some(found)
        else:
            pairs = K.distinct(np.concatenate(found))
            more = np.zeros(len(pairs), dtype=bool)
        return pa.table({"h": h[pairs >> 32].view(np.int64), "other": h[pairs & 0xFFFFFFFF].view(np.int64), "more": more})

    return blobs.groupBy("part").applyInArrow(K.trimmed(meet), schema)


def _by_place(which: np.ndarray, place: np.ndarray, line: np.ndarray, size: np.ndarray, words_an_edit: int):
    """Lines, and for each a range of others (in the last array) that have a print at about the same place. Sorted by
    print and place; each pair of lines once."""
    key = which << 32 | place
    low = np.arange(1, len(key) + 1)
    # a line of n words matches at most n // (words_an_edit - 1) edits away; places differ by no more
    high = np.searchsorted(key, key + size[line] // (words_an_edit - 1), side="right")
    return line, low, np.maximum(0, high - low), line


def _by_length(which: np.ndarray, place: np.ndarray, line: np.ndarray, size: np.ndarray, words_an_edit: int):
    """As _by_place, for frequent prints: one range for each length that the other line may have."""
    n = size[line]
    order = np.lexsort((place, n, which))
    which, place, line, n = which[order], place[order], line[order], n[order]
    kind = which * (int(n.max()) + 1 if len(n) else 1) + n
    kinds, at = np.unique(kind, return_inverse=True)
    key = at << 32 | place
    who, low, high = [line], [np.arange(1, len(key) + 1)], [np.searchsorted(key, key + n // words_an_edit, side="right")]
    more, asking = 1, np.arange(len(key))
    while len(asking := asking[(n[asking] + more) // words_an_edit >= more]):
        target = kind[asking] + more
        to = np.minimum(np.searchsorted(kinds, target), len(kinds) - 1)
        there = kinds[to] == target
        mine, to = asking[there], to[there] << 32
        edits = (n[mine] + more) // words_an_edit
        who.append(line[mine])
        low.append(np.searchsorted(key, to | np.maximum(place[mine] - edits, 0)))
        high.append(np.searchsorted(key, to | (place[mine] + edits), side="right"))
        more += 1
    who, low, high = (np.concatenate(x) for x in (who, low, high))
    return who, low, np.maximum(0, high - low), line


def _spelled(who: np.ndarray, low: np.ndarray, count: np.ndarray, line: np.ndarray):
    """The pairs of lines of such ranges, HELD or so at a time."""
    to, i = np.concatenate([[0], np.cumsum(count)]), 0
    while i < len(who):
        j = max(i + 1, int(np.searchsorted(to, to[i] + HELD, side="right")) - 1)
        yield np.repeat(who[i:j], count[i:j]), line[K.ragged(low[i:j], count[i:j])]
        i = j


def _some(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs line << 32 | other, the first NAMED + 1 of each line, and whether that is more than NAMED."""
    pairs = K.distinct(np.concatenate(found))
    line = pairs >> 32
    first = np.searchsorted(line, line, side="left")
    n = np.searchsorted(line, line, side="right") - first
    keep = np.arange(len(line)) - first <= NAMED
    return pairs[keep], (n > NAMED)[keep]


def _kept(g: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
    """Of a blob's arrays the prints to keep, and the lines that have one of them."""
    who, line = np.unique(g["line"][keep], return_inverse=True)
    long = g["n"] > LONG_LINE
    nth, fine = np.cumsum(long) - 1, g["fine"].reshape(-1, LONG_BITS // 64)
    of_lines = {c: g[c][who] for c in ("h", "doc", "n", "s0", "s1")}
    return {"print": g["print"][keep], "line": narrow(line), "place": g["place"][keep], **of_lines, "fine": fine[nth[who[long[who]]]].reshape(-1)}


def asked_blobs(blobs: DataFrame, rest: DataFrame) -> tuple[DataFrame, bytes]:
    """Of blobs the windows that some line of rest (h) has, by sieves, and the sieve of these lines."""
    asking = sieve(rest)
    held = blobs.sparkSession.sparkContext.broadcast(asking)

    def prints(batches):
        bits = np.frombuffer(held.value, dtype=np.uint8)
        for batch in batches:
            found = [np.zeros(0, dtype=K.U)]
            for body in batch.column(0).to_pylist():
                ask = _passes(bits, _unpack(body, ("h",))["h"])
                if ask.any():
                    g = _unpack(body, ("print", "line"))
                    found.append(g["print"][ask[g["line"]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    wanted = blobs.sparkSession.sparkContext.broadcast(sieve(written(blobs.select("body").mapInArrow(prints, "h long"), "asked")))

    def kept(batches):
        bits = np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            parts, bodies = [], []
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep = _passes(bits, _unpack(body, ("print",))["print"])
                if keep.any():
                    parts.append(part)
                    bodies.append(_pack(**_kept(_unpack(body), keep)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(bodies, pa.binary())], names=["part", "body"])

    return blobs.select("part", "body").mapInArrow(kept, "part long, body binary"), asking


def far_lines(pairs: DataFrame, lines: DataFrame, words_an_edit: int, done: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Of pairs of fitting(), for lines that are not in done (h): rows (h, best, edits), the earliest line at most 1 edit in
    words_an_edit away; and the lines (h) that match none of those they named and have others yet. With few, of pairs of
    NAMED lines or so each, a line's pairs meet in order in one task, which looks no further than its first match."""
    side = lambda name: lines.select(F.col("h").alias(name), F.struct("doc_id", "row", "line").alias(f"{name}_id"), F.col("words").alias(f"{name}_words"))
    asked = pairs.groupBy("h", "other").agg(F.max("more").alias("more")).join(done.select("h"), "h", "left_anti")
    of = asked.join(side("h"), "h").join(side("other"), "other").select("h", F.col("other_id").alias("best"), "more", (F.col("other_id") < F.col("h_id")).alias("before"), F.col("h_words").alias("a"), F.col("other_words").alias("b"))
    if few:
        of = of.repartition("h").sortWithinPartitions("h", "best")
    names = ["h", "best", "more", "edits"]

    def verify(batches):
        matched = None
        for batch in batches:
            found = []
            for h, before, a, b in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                edits = -1
                if before and not (few and h == matched):
                    a, b = (np.frombuffer(x.as_buffer(), dtype="<u4") for x in (a, b))
                    edits = _edits(a, b, max(len(a), len(b)) // words_an_edit)
                    matched = h if edits >= 0 else matched
                found.append(edits)
            edits = np.array(found, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(edits, mask=edits < 0)], names=names)

    tried = of.mapInArrow(verify, "h long, best struct<doc_id:long,row:long,line:int>, more boolean, edits int")
    hit = F.expr("if(edits is null, null, struct(best, edits))")
    got = written(tried.groupBy("h").agg(F.min(hit).alias("hit"), F.max("more").alias("more")), "far")
    return got.where("hit is not null").select("h", "hit.best", "hit.edits"), got.where("hit is null and more").select("h")


def duplicate_lines(docs: DataFrame, min_words: int = 8, words_an_edit: int | None = None) -> DataFrame:
    """Rows (row, doc_id, line, kept_doc_id, kept_line, edits): every line that goes, and the earlier line it repeats.

    Words are separated by white space, A-Z lower-cased. Lines of fewer than min_words words go only if an equal line
    stands earlier; longer ones also if an earlier line is one word away (a word replaced, put in or left out). Earlier
    is by doc_id (null first), row of the table and line number from 0. With words_an_edit, two lines the longer of which
    has n words also match at n // words_an_edit edits; kept is the earliest line one word away, or where there is none,
    an earlier line within that bound, and edits is the distance to it. Lines without a word stay. A null text has no
    lines; repeated rows are documents of their own, so all but the first lose their lines; other columns are not read;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with scratch() as keep:
        bits = 0
        if words_an_edit:
            total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
            bits = min(40, max(0, math.ceil(math.log2(max(1, total / PER_BUCKET)))))
        keys = keep(written(line_keys(docs, min_words, words_an_edit, bits), "line-keys"))
        blobs, table = keys.where("part is not null").select("part", "body"), keys.where("part is null").drop("part", "body")
        distinct = written(table.groupBy("h").agg(F.min(F.struct("doc_id", "row", "line")).alias("id"), *(F.max(f"k{i}").alias(f"k{i}") for i in range(4)), F.count("*").alias("copies")), "distinct-lines")
        pairs = written(fitting(blobs, words_an_edit), "fitting") if words_an_edit else None
        named = lambda p: p.select("h").unionByName(p.select(F.col("other").alias("h"))).distinct()
        lines = words_of(docs, distinct, halves(distinct), named(pairs) if words_an_edit else None)
        near = written(near_lines(lines).withColumn("edits", F.lit(1)), "near")
        if words_an_edit:
            far, rest = far_lines(pairs, lines, words_an_edit, near, few=True)
            done = near.unionByName(far)
            if not rest.isEmpty():
                some, asking = asked_blobs(blobs, rest)
                pairs = written(fitting(some, words_an_edit, asking).join(rest, "h"), "fitting")
                done = done.unionByName(far_lines(pairs, words_of(docs, distinct, None, named(pairs)), words_an_edit, done, few=False)[0])
            near = done
        classes = keep(written(distinct.join(near, "h", "left").where("copies > 1 or best is not null").select("h", "id", "best", "copies", F.coalesce("edits", F.lit(0)).alias("edits")), "classes"))
    lines = table.select("row", "doc_id", "line", "h")
    # lines with so many copies are HOT_LINES at most, so they are broadcast; the copies of any other fit in a task
    often = max(1000, lines.count() // HOT_LINES)
    hot, cold = F.broadcast(classes.where(F.col("copies") > often)), classes.where(F.col("copies") <= often)
    both = lines.join(hot, "h").unionByName(lines.join(hot.select("h"), "h", "left_anti").join(cold, "h"))
    hit = both.where("best is not null or not (row = id.row and line = id.line)")
    kept = F.coalesce("best", "id")
    return hit.select("row", "doc_id", "line", kept.getField("doc_id").alias("kept_doc_id"), kept.getField("line").alias("kept_line"), "edits")


def without_lines(docs: DataFrame, gone: DataFrame, broadcast_lines: int = 1_000_000) -> DataFrame:
    """docs without the lines (row, line) of gone, n_chars counted anew; documents that lose their last word go.

    gone is of duplicate_lines(docs). Where docs is not of numbered(), its rows must come in one order whenever it is
    read. Up to broadcast_lines lines are broadcast (some ten bytes each), more are joined by a shuffle.
    """
    if not hasattr(gone, "_weft_path"):
        gone = written(gone.select("row", "line"), "gone-lines")
    lists = gone.groupBy(F.col("row").alias(_AT)).agg(F.collect_set("line").alias(_GONE))
    if gone.count() <= broadcast_lines:
        lists = F.broadcast(lists)
    text = F.expr("if(__weft_gone is null, text, array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(__weft_gone, i)), '\\n'))")
    out = docs.withColumn(ROW, _row(docs)).join(lists, F.col(ROW) == F.col(_AT), "left").withColumn("text", text)
    out = out.where(f"{_GONE} is null or text rlike '[^ \\\\t-\\\\r]'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(_GONE).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def deduped(docs: DataFrame, **kw) -> DataFrame:
    """docs without the lines that duplicate_lines() names: of rows that repeat each other, the first keeps its lines."""
    table = numbered(docs, "rows")
    with scratch() as keep:
        gone = keep(written(duplicate_lines(table, **kw).select("row", "line"), "gone-lines"))
    return without_lines(table, gone).drop(ROW)
