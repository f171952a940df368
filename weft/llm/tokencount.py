"""Token counts by rank-synchronous merging.

The pre-tokens of a block lie in one ragged array of symbols. In each round every sequence merges all places of its
own lowest-ranked pair at once, and sequences without a mergeable pair leave with their count. A pair made by a merge
always has a later rank than that merge, so this gives what merging one place at a time gives.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

# The white space and the pre-token pattern of byte-level BPE.
FAR = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WHITE = r"\t-\r " + FAR
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space outside ASCII; texts with any are split as a whole by the pattern.
FAR_WHITE = regex.compile(f"[{FAR}]")
_LETTER = K.table(bytes(range(65, 91)) + bytes(range(97, 123)))
_NONE = np.int64(1 << 40)
#: Counts of so many distinct chunks are kept between blocks of a task.
MEMO = 400_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary as sorted arrays of symbol pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        ending = spec["model"].get("end_of_word_suffix") or ""
        self.of_last = np.array([vocab[c + ending] for c in byte_symbols()], dtype=np.int64)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def counts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Symbols left of each byte sequence raw[off[i]:off[i + 1]] when no pair can merge."""
        out = np.diff(off)
        who = np.flatnonzero(out > 1)
        n = out[who]
        for done, left, _ in self.merged(self.of_byte[raw[K.ragged(off[:-1][who], n)]], n):
            out[who[done]] = left
        return out

    def merged(self, sym: np.ndarray, n: np.ndarray):
        """Merges sequences of n[i] > 0 symbols each; yields (sequences, their lengths, their symbols) as they are done."""
        who = np.arange(len(n))
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        while len(who):
            start = np.cumsum(n) - n
            rank[start + n - 1] = _NONE  # the last symbol has no right neighbour
            least = np.minimum.reduceat(rank, start)
            go = least < _NONE
            if not go.all():
                keep = np.repeat(go, n)
                yield who[~go], n[~go], sym[~keep]
                who, n, least, sym, rank = who[go], n[go], least[go], sym[keep], rank[keep]
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, n))
            fresh = np.ones(len(hit), dtype=bool)
            fresh[1:] = hit[1:] != hit[:-1] + 1
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - lead) % 2 == 0]  # of places that overlap, every other one from the left
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            to = np.cumsum(stay) - 1
            n = np.diff(np.append(0, to[np.cumsum(n) - 1] + 1))
            sym, rank, at = sym[stay], rank[stay], to[hit]
            # only pairs that a merged symbol is part of have a new rank
            at = np.concatenate([at, at[at > 0] - 1])
            at = at[at < len(sym) - 1]
            rank[at] = self.ranks(sym[at], sym[at + 1])


@functools.lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


def chunks(raw: np.ndarray, off: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte slices that pre-tokens never cross: starts, ends and documents, and the special strings of each document.

    A word takes one blank before it along; of other white space before a word, all but the last byte is one slice and
    that byte another; white space at the end of a text is one slice. Texts with special strings, or with white space
    outside ASCII, are cut at the special strings only.
    """
    n_docs = len(off) - 1
    n_special = np.zeros(n_docs, dtype=np.int64)
    whole = np.zeros(n_docs, dtype=bool)
    body = raw.tobytes()
    own: list[tuple[int, int, int]] = []
    pattern = regex.compile(b"|".join(map(regex.escape, special))) if special and any(s in body for s in special) else None
    odd = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(odd) or pattern:
        nxt = raw[np.minimum(odd + 1, len(raw) - 1)]
        far = odd[((raw[odd] == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))) | ((raw[odd] == 0xE1) & (nxt == 0x9A)) | ((raw[odd] == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((raw[odd] == 0xE3) & (nxt == 0x80))]
        whole[np.searchsorted(off, far, side="right") - 1] = True
        if pattern:
            whole[[int(np.searchsorted(off, m.start(), side="right")) - 1 for m in pattern.finditer(body)]] = True
        for d in np.flatnonzero(whole):
            text = body[off[d] : off[d + 1]]
            marks = list(pattern.finditer(text)) if pattern else []
            if not marks and not FAR_WHITE.search(text.decode()):
                whole[d] = False
                continue
            n_special[d] = len(marks)
            at = int(off[d])
            for a, b in zip([0, *(m.end() for m in marks)], [*(m.start() for m in marks), len(text)], strict=True):
                if b > a:
                    own.append((at + a, at + b, d))
    space = K.SPACE[raw]
    if whole.any():
        space = space.copy()
    starts, ends = K.runs(~space, off)
    first, doc = K.doc_of(starts, off)
    gap_from = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    gap_from = np.maximum(gap_from, off[doc])  # white space before each word, within its document
    m = starts - gap_from
    blank = (m > 0) & (raw[np.maximum(starts - 1, 0)] == 32)
    lone = (m > 0) & ~blank
    tail_from = off[:-1].copy()
    has = np.diff(first) > 0
    tail_from[has] = ends[first[1:][has] - 1]
    tail = tail_from < off[1:]
    many = m > 1
    s = np.concatenate([starts - blank, gap_from[many], starts[lone] - 1, tail_from[tail]])
    e = np.concatenate([ends, starts[many] - 1, starts[lone], off[1:][tail]])
    d = np.concatenate([doc, doc[many], doc[lone], np.flatnonzero(tail)])
    if whole.any():
        keep = ~whole[d]
        extra = np.array(own, dtype=np.int64).reshape(-1, 3)
        s, e, d = (np.concatenate([x[keep], y]) for x, y in zip((s, e, d), extra.T, strict=True))
    return s, e, d, n_special


def split_chunks(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of each slice: their bytes, offsets, and how many each slice has. ASCII words need no pattern."""
    letters = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_LETTER[raw], out=letters[1:])
    lead = raw[s] == 32
    plain = (letters[e] - letters[s] == e - s - lead) & (e - s > lead)
    parts: list[bytes] = []
    many = np.ones(len(s), dtype=np.int64)
    hard = np.flatnonzero(~plain)
    for i in hard:
        found = [x.encode() for x in PRETOKEN.findall(raw[s[i] : e[i]].tobytes().decode())]
        many[i] = len(found)
        parts += found
    # plain slices first, then the parts of the others
    size = (e - s)[plain]
    body = np.concatenate([raw[K.ragged(s[plain], size)], np.frombuffer(b"".join(parts), dtype=np.uint8)])
    off = np.concatenate([[0], np.cumsum(np.concatenate([size, np.array([len(x) for x in parts], dtype=np.int64)]))]).astype(np.int64)
    owner = np.concatenate([np.flatnonzero(plain), np.repeat(hard, many[hard])])
    return body, off, owner


def count_block(model: Merges, raw: np.ndarray, off: np.ndarray, memo: list) -> np.ndarray:
    """Tokens of each document. memo: sorted hashes of chunks met before, and their counts."""
    s, e, d, total = chunks(raw, off, model.special)
    if not len(s):
        return total
    hashes, first, inverse = np.unique(K.hash_slices(raw, s, e), return_index=True, return_inverse=True)
    known, counts = memo
    value = np.zeros(len(hashes), dtype=np.int64)
    new = np.ones(len(hashes), dtype=bool)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        new = known[at] != hashes
        value[~new] = counts[at[~new]]
    pick = first[new]
    body, body_off, owner = split_chunks(raw, s[pick], e[pick])
    value[new] = np.bincount(owner, weights=model.counts(body, body_off), minlength=len(pick)).astype(np.int64)
    if len(known) > MEMO:
        memo[:] = [hashes, value]
    else:
        both = np.concatenate([known, hashes[new]])
        order = np.argsort(both)
        memo[:] = [both[order], np.concatenate([counts, value[new]])[order]]
    return total + np.bincount(d, weights=value[inverse], minlength=len(off) - 1).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its UTF-8 bytes, its tokens under the byte-level BPE file, and whether they pass the limit.

    One pass over whole texts without a shuffle. A null text is the empty text and has no tokens. Rows are counted one
    by one, repeated rows too; other columns are not read. An empty table gives no rows. The file must exist on the
    executors under the path given. Chunks met before are recognised by 64-bit hashes.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches):
        model = load(vocabulary)
        memo = [np.zeros(0, dtype=K.U), np.zeros(0, dtype=np.int64)]
        for batch, raw, off in K.blocks(batches):
            n = count_block(model, raw, off, memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
