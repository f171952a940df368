"""Language-model scores by a Katz bigram model.

Good-Turing discounted counts; what the discounts free goes, by an exactly normalised backoff weight, to the words that
a history was not seen with, in proportion to the unigram model, which in turn leaves its freed mass to unknown words:

    P(w | h) = d(c(h, w)) c(h, w) / c(h)   if c(h, w) > 0
             = a(h) P(w)                   if c(h) > 0
             = P(w)                        otherwise
    P(w)     = d'(c(w)) c(w) / N           if c(w) > 0, else the mass that is left
    a(h)     = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over seen w)

Counts above the cutoff of the Good-Turing estimate give up DELTA, so that every history keeps mass for unseen words.

Tokens travel once, packed by hash bucket of the predicted word; there all counts of the word and of its bigrams are at
hand, and what a text's tokens yield is summed before it travels back. Only bigrams not seen in training, which texts
outside it alone can have, ask for the backoff weight of their history, from the table of histories, partitioned by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .blobs import narrow as _narrow
from .blobs import pack as _pack
from .blobs import unpack as _unpack
from .store import drop, written

#: Words are 56-bit hashes: the low byte of all is 0.
WORD_BITS = K.U(0xFFFFFFFFFFFFFF00)
START, END = K.U(0x53A7C1D2E4F60B00), K.U(0x1E9D58B3C6274F00)
DELTA = 0.1
#: Counts up to the cutoff are discounted by Good-Turing.
CUTOFF = 5
#: Bytes of text for each bucket, and in each block.
PER_BUCKET, BLOCK = 16 << 20, 8 << 20
#: Bytes of the batches that workers give back, as far as single blobs allow.
OUT = 1 << 20
#: A word is hot with this share of all tokens at least; there are at most 1 / HOT such words.
HOT = 1 / 2000

BLOB = "kind int, part long, body binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, body = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int64()), pa.array(body, pa.binary())], names=["kind", "part", "body"])


def _batches(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about OUT bytes, as the machine that takes them holds each as a whole."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[2]) > OUT:
            yield _batch(held)
            held, size = [], 0
        held.append(row)
        size += len(row[2])
    yield _batch(held)


def _group(part: np.ndarray, n_parts: int):
    order = np.argsort(part.astype(np.uint16) if n_parts <= 65536 else part, kind="stable")
    parts, edge = np.unique(part[order], return_index=True)
    return order, parts, np.append(edge, len(part))


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and each value's place among them."""
    values, at = np.unique(x, return_inverse=True)
    return values, at.astype(np.int32)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> K.U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each document's words and END, each token's document, and where the documents begin."""
    low = K.LOWER[raw]
    starts, ends = K.runs(~K.SPACE[low], off)
    first, _ = K.doc_of(starts, off)
    h = np.insert(K.hash_slices(low, starts, ends) & WORD_BITS, first[1:], END)
    first = first + np.arange(len(first))
    return h, np.repeat(np.arange(len(off) - 1), np.diff(first)), first


def _texts(docs: DataFrame, learn) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(True)).alias("learn"), F.col("text").cast("string").alias("text"))


def _learn(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).to_numpy(zero_copy_only=False).astype(bool)


def unigrams(texts: DataFrame, bits: int) -> DataFrame:
    """Training counts of words in tables by bucket: rows (part, words, counts) as packed arrays, one a bucket."""

    def run(batches):
        for batch, raw, off in K.blocks(batches, limit=BLOCK):
            h, doc, _ = tokens(raw, off)
            words, n = np.unique(h[_learn(batch)[doc]], return_counts=True)
            order, parts, at = _group(_bucket(words, bits), 1 << bits)
            yield from _batches([(0, int(p), _pack(w=words[order[a:b]], n=_narrow(n[order[a:b]]))) for p, a, b in zip(parts, at[:-1], at[1:], strict=True)])

    def merge(table: pa.Table) -> pa.Table:
        got = [_unpack(x) for x in table.column("body").to_pylist()]
        words, inverse = np.unique(np.concatenate([g["w"] for g in got]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([g["n"] for g in got])).astype(np.int64)
        return pa.Table.from_arrays([table.column("part").slice(0, 1), pa.array([_pack(w=words, n=n)], pa.binary()), pa.array([int(n.sum())]), pa.array([len(n)]), pa.array([np.bincount(np.minimum(n, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()], pa.list_(pa.int64()))], names=["part", "body", "total", "types", "of_count"])

    return texts.mapInArrow(run, BLOB).groupBy("part").applyInArrow(K.trimmed(merge), "part long, body binary, total long, types long, of_count array<long>")


def discounts(of_count: list[int]) -> np.ndarray:
    """d for the counts 1..CUTOFF (at 0: unused), from the numbers of types with counts 1..CUTOFF + 1."""
    n = [0, *of_count]
    k = CUTOFF
    if all(n[1 : k + 2]):
        cut = (k + 1) * n[k + 1] / n[1]
        found = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut < 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return np.array([1.0, *found])
    give = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5  # too few types for Good-Turing: an absolute discount
    give = min(max(give, 0.01), 0.99)
    return np.array([1.0, *((r - give) / r for r in range(1, k + 1))])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c, also for counts above the cutoff; 0 for 0."""
    c = counts.astype(np.float64)
    return np.where(counts > CUTOFF, c - DELTA, d[np.minimum(counts, CUTOFF)] * c)


class Unigram:
    """What all buckets share: totals, discounts, the mass of unknown words, and the counts of hot words."""

    def __init__(self, total: int, types: int, of_count: list[int], big: int, hot: dict[int, int], n_docs: int):
        self.total, self.types, self.n_docs = total, types, n_docs
        self.d = discounts(of_count)
        freed = sum(r * n * (1 - self.d[r]) for r, n in enumerate(of_count[:CUTOFF], 1)) + DELTA * big
        self.unknown = freed / total if total else 1.0
        self.hot = np.array(sorted(hot), dtype=K.U)
        self.hot_count = np.array([hot[int(h)] for h in self.hot], dtype=np.int64)

    def prob(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / max(self.total, 1), self.unknown)

    def is_hot(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return self.hot[at] == h, at


PAIRS, FACTS, SUMS, HISTORY, ASK, ASK_HOT, STATS, WEIGHT = range(8)


def pairs(texts: DataFrame, bits: int, uni: Unigram) -> DataFrame:
    """Blobs of all (history, word, document) by bucket of the word (hot words by the pair), and of the documents' facts by document group."""
    n_parts = 1 << bits

    def run(batches):
        for batch, raw, off in K.blocks(batches, limit=BLOCK):
            rows, learn = batch.column(0).to_numpy(zero_copy_only=False), _learn(batch)
            h, doc, first = tokens(raw, off)
            before = np.concatenate([[START], h[:-1]]).astype(K.U)
            before[first[:-1]] = START
            words, code = _numbered(h)
            histories, past = _numbered(before)
            hot, _ = uni.is_hot(words)
            part = _bucket(words, bits).astype(np.int32)[code]
            spread = hot[code]
            part[spread] = _bucket(K.mix(h[spread] ^ K.mix(before[spread])), bits)
            order, parts, at = _group(part, n_parts)
            del h, before, part, spread
            out = []
            for p, a, b in zip(parts, at[:-1], at[1:], strict=True):
                mine = order[a:b]
                w, w_at = np.unique(code[mine], return_inverse=True)
                by = np.argsort(w_at.astype(np.uint32), kind="stable")
                mine = mine[by]
                v, v_at = np.unique(past[mine], return_inverse=True)
                out.append((PAIRS, int(p), _pack(w=words[w], run=_narrow(np.bincount(w_at)), h=histories[v], past=_narrow(v_at), doc=_narrow(doc[mine]), base=rows[:1], learn=np.packbits(learn))))
            ids = batch.column(1)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            order, parts, at = _group((K.mix(rows.astype(K.U)) % K.U(n_parts)).astype(np.int64), n_parts)
            n = np.diff(first)
            for p, a, b in zip(parts, at[:-1], at[1:], strict=True):
                who = order[a:b]
                out.append((FACTS, -1 - int(p), _pack(row=rows[who], id=ids[who], null=null[who], learn=learn[who], n=n[who])))
            yield from _batches(out)

    return texts.mapInArrow(run, BLOB)


def _by_doc(rows: np.ndarray, n_parts: int, kind: int, **values: np.ndarray) -> list[tuple[int, int, bytes]]:
    order, parts, at = _group((K.mix(rows.astype(K.U)) % K.U(n_parts)).astype(np.int64), n_parts)
    return [(kind, -1 - int(p), _pack(row=rows[order[a:b]], **{k: v[order[a:b]] for k, v in values.items()})) for p, a, b in zip(parts, at[:-1], at[1:], strict=True)]


def _by_word(words: np.ndarray, bits: int, kind: int, **values: np.ndarray) -> list[tuple[int, int, bytes]]:
    order, parts, at = _group(_bucket(words, bits), 1 << bits)
    return [(kind, int(p), _pack(w=words[order[a:b]], **{k: v[order[a:b]] for k, v in values.items()})) for p, a, b in zip(parts, at[:-1], at[1:], strict=True)]


def counted(blobs: DataFrame, bits: int, uni: Unigram) -> DataFrame:
    """Each bucket's counts, and what they give: sums by document, the seen bigrams' sums by history, questions for unseen bigrams."""
    n_parts = 1 << bits

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            return table
        got = [_unpack(x) for x in table.column("body").to_pylist()]
        words, w_all = _numbered(np.concatenate([g["w"] for g in got]))
        histories, h_all = _numbered(np.concatenate([g["h"] for g in got]))
        w_id, h_id, doc, learn, row_of = [], [], [], [], []
        w_at = h_at = n_docs = 0
        for g in got:
            w_id.append(np.repeat(w_all[w_at : w_at + len(g["w"])], g["run"]))
            h_id.append(h_all[h_at : h_at + len(g["h"])][g["past"]])
            local, where = _numbered(g["doc"])
            doc.append(where + np.int32(n_docs))
            flags = np.unpackbits(g["learn"])[local].astype(bool)
            learn.append(flags)
            row_of.append(g["base"][0] + local.astype(np.int64))
            w_at, h_at, n_docs = w_at + len(g["w"]), h_at + len(g["h"]), n_docs + len(local)
        w_id, h_id, doc, learn, row_of = (np.concatenate(x) for x in (w_id, h_id, doc, learn, row_of))
        del got, w_all, h_all
        train = learn[doc]
        hot, hot_at = uni.is_hot(words)
        c_word = np.bincount(w_id, weights=train, minlength=len(words)).astype(np.int64)
        if hot.any():
            c_word[hot] = uni.hot_count[hot_at[hot]]
        key = w_id.astype(np.int64) * len(histories) + h_id
        order = np.argsort(key, kind="stable")
        s = key[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        c_pair = np.add.reduceat(train[order].astype(np.int64), edge)
        of = np.empty(len(key), dtype=np.int32)
        of[order] = np.repeat(c_pair.astype(np.int32), np.diff(np.append(edge, len(s))))
        at = order[edge]
        del key, s, order
        c2, seen = c_word[w_id], of > 0
        p_word = uni.prob(c_word)
        log_word = np.log10(p_word)
        value = np.where(seen, np.log10(np.where(of > CUTOFF, of - DELTA, np.maximum(of, 1))), log_word[w_id])
        # as a history the word divides what follows it by its count; for unseen bigrams WEIGHT takes that back
        follows = (words != END) & (c_word > 0)
        value -= np.where(follows[w_id], np.log10(np.maximum(c2, 1)), 0.0)
        opening = histories == START
        if uni.n_docs:
            value -= np.where(opening[h_id], math.log10(uni.n_docs), 0.0)
        per = lambda x: np.bincount(doc, weights=x, minlength=n_docs)
        out = _by_doc(row_of, n_parts, SUMS, base=per(np.log10(c2 + 0.5)), score=per(value), known=_narrow(per(c2 > 0)), **{f"r{r}": _narrow(per(of == r)) for r in range(1, CUTOFF + 1)})

        del value, c2
        here = c_pair > 0
        h_of, c_of, p_of = h_id[at][here], c_pair[here], p_word[w_id[at][here]]
        by = lambda x: np.bincount(h_of, weights=x, minlength=len(histories))
        n_seen = by(c_of)
        held = n_seen > 0
        out += _by_word(histories[held], bits, HISTORY, p=by(p_of)[held], more=_narrow(by(c_of > CUTOFF)[held]), **{f"m{r}": _narrow(by(c_of == r)[held]) for r in range(1, CUTOFF + 1)})

        ask = np.flatnonzero(~seen)
        if len(ask):
            h_hot, _ = uni.is_hot(histories)
            h_hot |= opening
            often = h_hot[h_id[ask]]
            rare = ask[~often]
            out += _by_word(histories[h_id[rare]], bits, ASK, row=row_of[doc[rare]])
            if often.any():
                out += _by_doc(row_of[doc[ask[often]]], n_parts, ASK_HOT, w=histories[h_id[ask[often]]])
        of_count = np.bincount(np.minimum(c_pair, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
        out.append((STATS, part, _pack(n=of_count)))
        return pa.Table.from_batches(_batches(out))

    return blobs.groupBy("part").applyInArrow(K.trimmed(run), BLOB)


def _history(got: list[dict], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories, ascending, and the log10 of their backoff weight times their count, which is the mass that their bigrams free."""
    words, inverse = np.unique(np.concatenate([g["w"] for g in got]), return_inverse=True)
    total = lambda name: np.bincount(inverse, weights=np.concatenate([g[name] for g in got]), minlength=len(words))
    freed = sum(r * total(f"m{r}") * (1 - d[r]) for r in range(1, CUTOFF + 1)) + DELTA * total("more")
    return words, np.log10(freed) - np.log10(1 - total("p"))


def answers(table: DataFrame, bits: int, d: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Backoff weights of the histories asked for, summed by document."""
    n_parts = 1 << bits

    def run(group: pa.Table) -> pa.Table:
        kinds, bodies = group.column("kind").to_pylist(), group.column("body").to_pylist()
        got = {k: [_unpack(b) for kind, b in zip(kinds, bodies, strict=True) if kind == k] for k in (HISTORY, ASK, ASK_HOT)}
        rows, logs = [], []
        for k in (ASK, ASK_HOT):
            if not got[k]:
                continue
            words, value = hot if k == ASK_HOT else (_history(got[HISTORY], d) if got[HISTORY] else (np.zeros(0, dtype=K.U), np.zeros(0)))
            w = np.concatenate([g["w"] for g in got[k]])
            if not len(words):
                continue
            at = np.minimum(np.searchsorted(words, w), len(words) - 1)
            known = words[at] == w  # an unknown history has weight 1 and no count
            rows.append(np.concatenate([g["row"] for g in got[k]])[known])
            logs.append(value[at[known]])
        if not rows:
            return pa.Table.from_batches([_batch([])])
        who, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        return pa.Table.from_batches([_batch(_by_doc(who, n_parts, WEIGHT, score=np.bincount(inverse, weights=np.concatenate(logs))))])

    return table.where(F.col("kind").isin(HISTORY, ASK, ASK_HOT)).groupBy("part").applyInArrow(K.trimmed(run), BLOB)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(blobs: DataFrame, uni: Unigram, d: np.ndarray) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        facts, got = [], []
        for kind, body in zip(group.column("kind").to_pylist(), group.column("body").to_pylist(), strict=True):
            (facts if kind == FACTS else got).append(_unpack(body))
        fact = {k: np.concatenate([f[k] for f in facts]) for k in facts[0]}
        order = np.argsort(fact["row"])
        fact = {k: v[order] for k, v in fact.items()}
        n = len(order)
        base, score, known = np.zeros(n), np.zeros(n), np.zeros(n)
        for g in got:
            at = np.searchsorted(fact["row"], g["row"])
            score += np.bincount(at, weights=g["score"], minlength=n)
            if "base" in g:
                base += np.bincount(at, weights=g["base"], minlength=n)
                known += np.bincount(at, weights=g["known"], minlength=n)
                for r in range(1, CUTOFF + 1):
                    score += np.bincount(at, weights=g[f"r{r}"] * math.log10(d[r]), minlength=n)
        base -= fact["n"] * math.log10(uni.total + 0.5 * (uni.types + 1))
        return pa.Table.from_arrays([pa.array(fact["id"], mask=fact["null"]), pa.array(~fact["learn"]), pa.array(fact["n"]), pa.array(known.astype(np.int64)), pa.array(np.full(n, uni.total, dtype=np.int64)), pa.array(base), pa.array(score)], names=[x.split(" ")[0] for x in RESULT.split(", ")])

    return blobs.groupBy("part").applyInArrow(K.trimmed(run), RESULT)


def katz_scores(docs: DataFrame, learn=None) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, n_known, train_tokens, base_score and score, in log10.

    learn: a condition for the rows to learn from (all by default; null counts as true). Words are separated by white
    space, A-Z lower-cased; each text ends with one end token. A null or empty text is its end token alone. Repeated
    rows count as often as they stand there; other columns are not read; an empty table gives no rows. With nothing to
    learn from every word is unknown.
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else learn
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    bits = min(20, max(0, math.ceil(math.log2(max(1, total / PER_BUCKET)))))
    texts = _texts(docs, learn)
    counts = written(unigrams(texts, bits), "unigrams")
    sums = counts.agg(F.sum("total"), F.sum("types"), *(F.sum(F.col("of_count")[r]) for r in range(CUTOFF + 1))).first()
    n, types, of_count = sums[0] or 0, sums[1] or 0, [x or 0 for x in sums[2:]]

    def often(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                g = _unpack(body)
                keep = (g["n"] >= HOT * n) | (g["w"] == END)
                yield pa.RecordBatch.from_arrays([pa.array(g["w"][keep].view(np.int64)), pa.array(g["n"][keep].astype(np.int64))], names=["w", "n"])

    hot = {int(np.int64(r.w).view(K.U)): r.n for r in counts.select("body").mapInArrow(often, "w long, n long").collect()}  # at most 1 / HOT words, and END
    uni = Unigram(n, types, of_count, types - sum(of_count[:CUTOFF]), hot, hot.get(int(END), 0))
    table = written(counted(pairs(texts, bits, uni), bits, uni), "ngrams")

    of_pairs = np.zeros(CUTOFF + 1, dtype=np.int64)
    for r in table.where(F.col("kind") == STATS).select("body").toLocalIterator():  # one small row a bucket
        of_pairs += _unpack(r.body)["n"]
    d = discounts(of_pairs.tolist())

    def hot_parts(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                g = _unpack(body)
                keep = uni.is_hot(g["w"])[0] | (g["w"] == START)
                if keep.any():
                    columns = {k: v[keep] for k, v in g.items()}
                    columns["w"] = columns["w"].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[k].astype(np.float64) if k != "w" else columns[k]) for k in HOT_COLUMNS], names=HOT_COLUMNS)

    parts = table.where(F.col("kind") == HISTORY).select("body").mapInArrow(hot_parts, ", ".join(f"{c} {'long' if c == 'w' else 'double'}" for c in HOT_COLUMNS))
    found = parts.groupBy("w").agg(*(F.sum(c).alias(c) for c in HOT_COLUMNS[1:])).collect()  # at most 1 / HOT + 2 rows
    hot_log = _history([{c: np.array([r[c] for r in found], dtype=np.int64 if c == "w" else float) for c in HOT_COLUMNS} | {"w": np.array([r["w"] for r in found], dtype=np.int64).view(K.U)}], d) if found else (np.zeros(0, dtype=K.U), np.zeros(0))

    weights = answers(table, bits, d, hot_log)
    return scores(table.where(F.col("kind").isin(FACTS, SUMS)).unionByName(weights), uni, d)


HOT_COLUMNS = ["w", "p", "more", *(f"m{r}" for r in range(1, CUTOFF + 1))]


def katz_report(docs: DataFrame) -> DataFrame:
    """The scores with a fifth of the documents, by crc32 of the id as text modulo 5 being 1, kept out of training."""
    return katz_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1)
