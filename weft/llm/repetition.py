"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, as numpy over whole blocks of texts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the rules; a fraction above its limit rejects the document.

    top: for n, the share of word characters in all occurrences of the most covering n-gram that occurs twice or more.
    dup: for n, the share of word characters inside n-grams that stood earlier in the text.
    dup_lines holds for texts of at least min_lines lines with a word; dup_line_chars for all.
    """

    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    top: dict = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    dup: dict = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    dup_lines: float = 0.30
    min_lines: int = 5
    dup_line_chars: float = 0.20
    symbols_per_word: float = 0.10


SYMBOLS = K.table(b"#*$%&|<>")


def schema_of(rules: RepetitionRules) -> str:
    shares = [f"top_{k}" for k in sorted(rules.top)] + [f"dup_{k}" for k in sorted(rules.dup)] + ["dup_line_share", "dup_line_char_share"]
    base = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return base + "".join(f", {x} double" for x in shares)


def _covered(at: np.ndarray, hit: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Per word, whether it lies in a window that hit."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(step, at[hit], 1)
    np.add.at(step, at[hit] + k, -1)
    return np.cumsum(step[:-1]) > 0


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def measure(raw: np.ndarray, off: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The measures of every document of a block."""
    n_docs = len(off) - 1
    starts, ends = K.runs(~K.SPACE[raw], off)
    first, doc = K.doc_of(starts, off)
    n_words = np.diff(first)
    points = K.code_points(raw)
    chars = points[ends] - points[starts]
    word_chars = K.sums(chars, first)
    salt = K.mix(np.arange(1, n_docs + 1, dtype=K.U))
    h = K.hash_slices(raw, starts, ends)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": K.sums(SYMBOLS[raw], off)}

    line_starts, line_ends = K.runs(raw != 10, off)  # an empty line has no word
    line_first, line_doc = K.doc_of(line_starts, off)
    words_to = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    _, again = K.repeated(K.hash_slices(raw, line_starts, line_ends) ^ salt[line_doc])
    again &= words_to > 0
    out["n_dup_lines"] = K.sums(again, line_first)
    line_chars = (points[line_ends] - points[line_starts]) * (words_to > 0)
    n_lines = K.sums(words_to > 0, line_first)
    out["dup_line_share"] = _share(out["n_dup_lines"], n_lines)
    out["dup_line_char_share"] = _share(K.sums(line_chars * again, line_first), K.sums(line_chars, line_first))

    for k in sorted({*rules.top, *rules.dup, rules.window}):
        keys, at = K.windows(h, doc, k)
        keys = keys ^ salt[doc[at]] if len(at) else keys
        both, later = K.repeated(keys)
        if k == rules.window:
            out["n_repeat_words"] = K.sums(_covered(at, both, k, len(h)), first)
        if k in rules.dup:
            out[f"dup_{k}"] = _share(K.sums(chars * _covered(at, later, k, len(h)), first), word_chars)
        if k in rules.top:
            top = np.zeros(n_docs)
            if both.any():
                which, inverse, count = np.unique(keys[both], return_inverse=True, return_counts=True)
                to = np.concatenate([[0], np.cumsum(chars)])
                size = np.zeros(len(which), dtype=np.int64)
                size[inverse] = to[at[both] + k] - to[at[both]]
                owner = np.zeros(len(which), dtype=np.int64)
                owner[inverse] = doc[at[both]]
                np.maximum.at(top, owner, np.minimum(1.0, _share(size * count, word_chars[owner])))
            out[f"top_{k}"] = top

    failed = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * n_words)
    bad = failed | ((out["dup_line_share"] > rules.dup_lines) & (n_lines >= rules.min_lines)) | (out["dup_line_char_share"] > rules.dup_line_chars)
    bad |= out["n_symbols"] > rules.symbols_per_word * n_words
    for name, limits in (("top", rules.top), ("dup", rules.dup)):
        for k, most in limits.items():
            bad |= out[f"{name}_{k}"] > most
    return out | {"base_failed": failed, "kept": ~bad}


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base counts, the coverage of each n-gram length and the verdict; one pass, no shuffle.

    A null or empty text has no words, so base_failed. Repeated rows and equal ids are measured row by row. Columns
    other than the two named are not read, so their names may clash with the results'. An empty table gives none.
    """
    schema = schema_of(rules)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for batch, raw, off in K.blocks(batches):
            got = measure(raw, off, rules) | {"doc_id": batch.column(0)}
            yield pa.RecordBatch.from_arrays([got[n] if n == "doc_id" else pa.array(got[n].astype(bool) if n in ("base_failed", "kept") else got[n]) for n in names], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
