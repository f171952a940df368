"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into classes (insult, threat, target, negation, reported speech, quotation mark); three
further transducers, composed into one, carry negation, reported speech and targets across a clause and weigh what they
find. Clauses are scored as a whole, and a text by its clauses. The insults and their weights are learned from labels.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

# Closed word classes of the grammar, in the languages of the corpus.
THREATS = "kill hurt destroy shoot stab beat burn attack töten schlagen verletzen matar golpear herir tuer frapper blesser".split()
TARGETS = "you your youre he she they them him her people du dich dir ihr euch sie tú usted ustedes te vosotros ellos tu toi vous ils elles".split()
NEGATIONS = "not never no nor neither isnt arent dont nicht kein keine nie nunca jamás tampoco pas jamais aucun".split()
REPORTS = "said says called calls quoted reported wrote claimed sagte nannte schrieb dijo llamó escribió dit appelé écrit".split()
#: Insults known without labels, at a modest weight.
SEED_INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown idioten dumm arschloch imbécil estúpido connard".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, QUIET, SAID, AIMED = range(10)
#: Lengths in code points of the stems that can stand for all their continuations.
STEMS = (3, 4, 5, 6, 7)
WHOLE = 99
WORD = K.table(bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
CLAUSE_END = K.table(b".,;:!?\n")


class Transducer:
    """An epsilon-free sequential transducer: arcs[state][symbol] = (symbol out, weight, next state); symbols without an arc pass unchanged."""

    def __init__(self, arcs: list[dict[int, tuple[int, float, int]]]):
        self.arcs = arcs

    def step(self, state: int, symbol: int) -> tuple[int, float, int]:
        return self.arcs[state].get(symbol, (symbol, 1.0, state))

    def then(self, other: Transducer, alphabet: range) -> Transducer:
        """The composition: other reads what this one writes; weights multiply."""
        number, arcs, todo = {(0, 0): 0}, [{}], [(0, 0)]
        while todo:
            p, q = todo.pop()
            for symbol in alphabet:
                mid, w1, p2 = self.step(p, symbol)
                out, w2, q2 = other.step(q, mid)
                if (p2, q2) not in number:
                    number[p2, q2] = len(arcs)
                    arcs.append({})
                    todo.append((p2, q2))
                arcs[number[p, q]][symbol] = (out, w1 * w2, number[p2, q2])
        return Transducer(arcs)


def grammar(quiet: float = 0.4, said: float = 0.6, aimed: float = 1.3, reach: int = 3) -> Transducer:
    """Negation quiets an insult or threat up to reach words on; reported speech and quotation marks soften what follows
    in the clause; a target makes later insults and threats weigh more, and a threat without a target weighs half."""
    both = (INSULT, THREAT)
    away = [{NEGATION: (OTHER, 1.0, 1)}]
    for i in range(1, reach + 1):
        after = (i + 1) % (reach + 1)
        away.append({NEGATION: (OTHER, 1.0, 1)} | {s: (s, quiet, after) for s in both} | {s: (s, 1.0, after) for s in (OTHER, TARGET, REPORT, QUOTE)})
    report = [{s: (OTHER, 1.0, 1) for s in (REPORT, QUOTE)}, {s: (s, said, 1) for s in both} | {QUOTE: (OTHER, 1.0, 0)}]
    target = [{TARGET: (AIMED, 1.0, 1), THREAT: (THREAT, 0.5, 0)}, {s: (s, aimed, 1) for s in both}]
    full = range(AIMED + 1)
    return Transducer(away).then(Transducer(report), full).then(Transducer(target), full)


@dataclass(frozen=True)
class ToxicityModel:
    """stems: 64-bit form hash to weight, for each stem length or WHOLE; coefficients of the calibration."""

    stems: tuple
    coef: tuple = (-3.0, 1.0, 0.0)


@functools.lru_cache(maxsize=4)
def _arrays(stems: tuple) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for k, pairs in stems:
        h = np.array([x for x, _ in pairs], dtype=np.int64).view(K.U)
        order = np.argsort(h)
        out[k] = h[order], np.array([w for _, w in pairs])[order]
    return out


def form_hash(words: list[str], seed: int = WHOLE) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return K.hash_slices(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(w) for w in raw], ends, seed)


def _lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pc.utf8_lower(batch.column(at).fill_null("")))


def stem_ends(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, points: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of more than k code points: their indices, and where their first k code points end."""
    long = np.flatnonzero(points[ends] - points[starts] > k)
    return long, begins[points[starts[long]] + k]


def block_words(raw: np.ndarray, off: np.ndarray):
    starts, ends = K.runs(WORD[raw], off)
    first, doc = K.doc_of(starts, off)
    return starts, ends, first, doc, K.code_points(raw), np.flatnonzero((raw & 0xC0) != 0x80)


def count_forms(texts: DataFrame) -> DataFrame:
    """Rows (kind, hash, n_toxic, n_docs, form) over texts (text, toxic): documents that hold each word and each stem.

    Each task sums its own blocks first; a form is spelled out only where toxic documents hold it in the main.
    """

    def run(batches):
        for batch, raw, off in K.blocks(map(_lowered, batches)):
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False).astype(np.int64)
            starts, ends, _, doc, points, begins = block_words(raw, off)
            for kind in (WHOLE, *STEMS):
                at, stop = (np.arange(len(starts)), ends) if kind == WHOLE else stem_ends(raw, starts, ends, points, begins, kind)
                if not len(at):
                    continue
                h = K.hash_slices(raw, starts[at], stop, kind)
                key = np.lexsort((doc[at], h))
                hs, ds = h[key], doc[at][key]
                fresh = np.ones(len(hs), dtype=bool)
                fresh[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
                hs, ds, src = hs[fresh], ds[fresh], at[key][fresh]
                edge = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                n, t = np.diff(np.append(edge, len(hs))), np.add.reduceat(toxic[ds], edge)
                rep = src[edge]
                ending = np.zeros(len(starts), dtype=np.int64)
                ending[at] = stop
                forms = [raw[starts[i] : ending[i]].tobytes().decode() if show else None for i, show in zip(rep, 2 * t > n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), kind, dtype=np.int32)), pa.array(hs[edge].view(np.int64)), pa.array(t), pa.array(n), pa.array(forms, pa.string())], names=["kind", "hash", "n_toxic", "n_docs", "form"])

    parts = texts.select("text", "toxic").mapInArrow(run, "kind int, hash long, n_toxic long, n_docs long, form string")
    return parts.groupBy("kind", "hash").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_docs").alias("n_docs"), F.max("form").alias("form"))


def score_block(raw: np.ndarray, off: np.ndarray, stems: dict, machine: Transducer, classes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: its best clause's weight, the sum over clauses, and the number of clauses that match."""
    n_docs = len(off) - 1
    best, total, count = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs, dtype=np.int64)
    starts, ends, _, doc, points, begins = block_words(raw, off)
    weight = np.zeros(len(starts))
    kind = np.zeros(len(starts), dtype=np.int8)
    if not len(starts):
        return best, total, count
    h = K.hash_slices(raw, starts, ends, WHOLE)
    at = np.minimum(np.searchsorted(classes[0], h), len(classes[0]) - 1)
    kind = np.where(classes[0][at] == h, classes[1][at], kind)
    weight[kind == THREAT] = 1.0
    for k, (hashes, w) in stems.items():
        where, mine = (np.arange(len(starts)), h) if k == WHOLE else (lambda x: (x[0], K.hash_slices(raw, starts[x[0]], x[1], k)))(stem_ends(raw, starts, ends, points, begins, k))
        if not len(hashes) or not len(where):
            continue
        at = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
        hit = hashes[at] == mine
        weight[where[hit]] = np.maximum(weight[where[hit]], w[at[hit]])
        kind[where[hit]] = INSULT
    hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(hits):
        return best, total, count
    # clauses: an end mark, a new document, or a quotation mark between words (which is a symbol of its own)
    marks = np.flatnonzero(CLAUSE_END[raw])
    clause = np.searchsorted(marks, starts) + doc
    edges = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]]))
    which = np.unique(np.searchsorted(edges, hits, side="right") - 1)
    edges = np.append(edges, len(starts))
    for c in which:
        state, got = 0, 0.0
        for i in range(edges[c], edges[c + 1]):
            if raw[starts[i] - 1] == 34 and starts[i] > off[doc[i]]:
                _, _, state = machine.step(state, QUOTE)
            out, w, state = machine.step(state, int(kind[i]))
            if kind[i] in (INSULT, THREAT):
                got += w * weight[i]
        d = doc[edges[c]]
        best[d] = max(best[d], got)
        total[d] += got
        count[d] += 1
    return best, total, count


def closed_classes() -> tuple[np.ndarray, np.ndarray]:
    of = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
    h = form_hash(list(of))
    order = np.argsort(h)
    return h[order], np.array(list(of.values()), dtype=np.int8)[order]


def clause_scores(docs: DataFrame, stems: tuple, keep: list[str]) -> DataFrame:
    """The columns kept, and best, total, n_clauses, over docs with a column text."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "best double", "total double", "n_clauses long"])

    def run(batches):
        machine, arrays, classes = grammar(), _arrays(stems), closed_classes()
        for batch, raw, off in K.blocks(map(_lowered, batches)):
            got = score_block(raw, off, arrays, machine, classes)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *map(pa.array, got)], names=[*keep, "best", "total", "n_clauses"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _design(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(best)), np.log1p(best), np.log1p(total)], axis=1)


def _calibrate(best: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple:
    """Ridge logistic regression by Newton steps."""
    x, b = _design(best, total), np.array([-3.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * b)
        b = b + np.clip(step, -5, 5)
    return tuple(float(v) for v in b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_docs: int = 60_000, max_entries: int = 20_000, min_share: float = 0.7, z: float = 1.96) -> ToxicityModel:
    """Learns insults, weights and calibration from labels (doc_id, toxic).

    The sample is bounded: of the labelled documents the max_docs with the least hash of their id. Two thirds of them
    give the lexicon: words and stems whose share of toxic documents is min_share at least even at the lower end of its
    Wilson interval (at most max_entries); the others give the calibration. Without labels the seed words remain.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_docs).select(F.col("doc_id").alias("_id"), "toxic", (F.pmod("order", F.lit(3)) == 0).alias("check"))
    # at most max_docs ids of 16 bytes
    texts = docs.select(F.col(id_col).alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "toxic", "check")
    n1, n0 = chosen.where("not check").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    n = F.col("n_docs")
    p = F.col("n_toxic") / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    weight = F.log(((F.col("n_toxic") + 0.5) / (n1 + 1)) / ((n - F.col("n_toxic") + 0.5) / (n0 + 1)))
    rows = count_forms(texts.where("not check")).where(low >= min_share).select("kind", "hash", weight.alias("weight")).orderBy(F.desc("weight"), "kind", "hash").limit(max_entries).collect()
    by: dict[int, dict[int, float]] = {k: {} for k in (WHOLE, *STEMS)}
    for h in form_hash(SEED_INSULTS).view(np.int64):
        by[WHOLE][int(h)] = 2.0
    for r in rows:
        if r.weight > 0:
            by[r.kind][r.hash] = r.weight
    stems = tuple((k, tuple(sorted(v.items()))) for k, v in by.items() if v)
    seen = clause_scores(texts.where("check"), stems, ["toxic"]).select("best", "total", "toxic").toPandas()  # at most max_docs rows
    if seen["toxic"].nunique() < 2:
        return ToxicityModel(stems)
    return ToxicityModel(stems, _calibrate(seen["best"].to_numpy(), seen["total"].to_numpy(), seen["toxic"].to_numpy(dtype=float)))


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1), predicted (score at threshold or above), the clauses that matched and their best weight.

    Null and empty texts match nothing and get the score of such texts. Rows are scored one by one, whatever their ids;
    no column but the id and text is read; an empty table gives no rows.
    """
    got = clause_scores(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"), model.stems, ["doc_id"])
    a, b, c = model.coef
    score = 1 / (1 + F.exp(-(F.lit(a) + b * F.log1p("best") + c * F.log1p("total"))))
    return got.select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_clauses", "best")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; filtered in place, without a shuffle."""
    low, times, plus = model.coef
    at = docs.columns.index("text")

    def run(batches):
        machine, arrays, classes = grammar(), _arrays(model.stems), closed_classes()
        for batch in batches:
            done = 0
            text = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            for part, raw, off in K.blocks([_lowered(text)]):
                best, total, _ = score_block(raw, off, arrays, machine, classes)
                p = 1 / (1 + np.exp(-(low + times * np.log1p(best) + plus * np.log1p(total))))
                yield batch.slice(done, part.num_rows).filter(pa.array(p < threshold))
                done += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those whose crc32 of the id as text is not 2 modulo 4."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).select("doc_id", "toxic")


def toxicity_report(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    model = fit(docs, training_labels(labels), **kw)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    got = toxicity(docs, model)
    return got.select("doc_id", held.alias("held_out"), "score", "predicted", "n_clauses", "best")
