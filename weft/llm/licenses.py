"""License scans by diagonal voting.

Spark joins every rolling word k-gram of every text to the positions of the same k-gram in the license templates, votes
are summed per offset diagonal, neighbouring diagonals merge into spans, and spans are verified by the words they hold.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K

# Phrases of the base, and the labels they give.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of widely used license notices, and their labels.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}

#: Bytes of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and all beyond ASCII.
WORD = K.table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
K_GRAM = 2
#: A word of no template.
_OTHER = 0
#: Stands for the document itself among its k-grams.
MARKER = -7046029254386353131


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = K.LOWER[raw]
    return low, *K.runs(WORD[low], off)


@functools.lru_cache(maxsize=4)
def vocabulary(texts: tuple[str, ...]) -> dict[str, int]:
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t.split()))}


def word_hash(words: list[str]) -> np.ndarray:
    raw = "".join(words).encode()
    n = np.array([len(w.encode()) for w in words], dtype=np.int64)
    ends = np.cumsum(n)
    return K.hash_slices(np.frombuffer(raw, dtype=np.uint8), ends - n, ends)


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """Rows (hash, a, b, template, label, base, pos, size): the k-grams of each template with their positions."""
    vocab = vocabulary((*phrases, *notices.values()))
    rows = []
    for t, (text, label, base) in enumerate([*((p, x, True) for p, x in phrases.items()), *((p, x, False) for x, p in notices.items())]):
        words = text.split()
        h, at = K.windows(word_hash(words), np.zeros(len(words), dtype=np.int64), K_GRAM)
        rows += [(int(x), vocab[words[i]], vocab[words[i + 1]], t, label, base, int(i), len(words)) for x, i in zip(h.view(np.int64), at, strict=True)]
    return spark.createDataFrame(rows, "hash long, a int, b int, template int, label string, base boolean, pos int, size int")


def grams(docs: DataFrame, texts: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: n_words, the hash of every rolling word k-gram, and every word's number in the templates' vocabulary (0: none).

    The k-grams end with one marker, which stands for the document itself.
    """
    names = ["row", "doc_id", "n_words", "hashes", "codes"]

    def run(batches):
        vocab = vocabulary(texts)
        own = word_hash(list(vocab))
        order = np.argsort(own)
        own, number = own[order], np.array(list(vocab.values()), dtype=np.int16)[order]
        for batch, raw, off in K.blocks(batches):
            low, starts, ends = word_spans(raw, off)
            first, doc = K.doc_of(starts, off)
            h = K.hash_slices(low, starts, ends)
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            codes = np.where(own[at] == h, number[at], np.int16(_OTHER))
            keys, where = K.windows(h, doc, K_GRAM)
            n_keys = np.maximum(np.diff(first) - K_GRAM + 1, 0)
            per = np.concatenate([[0], np.cumsum(n_keys)])
            hashes = np.insert(keys.view(np.int64), per[1:], MARKER)
            per = per + np.arange(len(per))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(hashes)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(codes))],
                names=names,
            )

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "row long, doc_id long, n_words long, hashes array<long>, codes array<short>")


def diagonals(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Votes of each (row, template, diagonal), and one row of template -1 for each document.

    The templates are a fixed table of some hundred k-grams, so they are broadcast; a k-gram votes only if its two words
    are the template's by their vocabulary numbers.
    """
    seeds = templates(docs.sparkSession, phrases, notices).withColumn("kind", F.lit(1))
    marker = docs.sparkSession.createDataFrame([(MARKER, 0, 0, -1, "", False, 0, 1, 0)], seeds.schema)
    every = grams(docs, (*phrases, *notices.values()), id_col, text_col).select("row", "doc_id", "n_words", "codes", F.posexplode("hashes").alias("at", "hash"))
    hits = every.join(F.broadcast(seeds.unionByName(marker)), "hash").where("kind = 0 or (get(codes, at) = a and get(codes, at + 1) = b)")
    votes = hits.groupBy("row", "template", F.expr("if(kind = 0, 0, at - pos)").alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.max(F.expr("if(kind = 0, n_words, null)")).alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"), F.collect_set("pos").alias("places")
    )
    return votes


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, min_cover: float = 0.6, min_votes: int = 2, gap: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans (row, doc_id, label, base, start, stop, cover) in words from 0, and a row without label for each document.

    A phrase needs all its words on one diagonal. For a notice, diagonals with min_votes votes at least that lie gap or
    less apart merge (words put in or left out move the diagonal); the merged span counts if the template's words that
    it covers in place are min_cover of them and it is at most half as long again as the template.

    A null or empty text has no spans; each row of docs is a document of its own, whatever its id; other columns are not
    read; an empty table gives an empty result. Equal places found by several templates are kept for each.
    """
    votes = diagonals(docs, phrases, notices, id_col, text_col).withColumn("n_votes", F.size("places"))
    some = votes.where(f"template < 0 or if(base, n_votes = size - 1, n_votes >= {min_votes})")
    new = f"case when not base and template >= 0 and diagonal - lag(diagonal) over (partition by row, template order by diagonal) <= {gap} then 0 else 1 end"
    spans = Window.partitionBy("row", "template").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0)
    return (
        some.withColumn("new", F.expr(new))
        .withColumn("span", F.sum("new").over(spans))
        .groupBy("row", "template", "span")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.first(F.expr("if(template < 0, null, label)")).alias("label"),
            F.first("base").alias("base"),
            F.first("size").alias("size"),
            F.min(F.expr("if(template < 0, null, diagonal + array_min(places))")).alias("start"),
            F.max(F.expr("if(template < 0, null, diagonal + array_max(places) + 2)")).alias("stop"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        )
        .withColumn("cover", F.expr("if(template < 0, 0.0d, size(array_distinct(flatten(transform(places, p -> array(p, p + 1))))) / size)"))
        .where(f"template < 0 or (cover >= {min_cover} and stop - start <= 1.5 * size)")
        .select("row", "doc_id", "n_words", "label", "base", "start", "stop", "cover")
    )


def license_report(docs: DataFrame, **kw) -> DataFrame:
    """Per row of docs: doc_id, n_words, the base phrases' places, labels of the base and of all spans, and the best cover."""
    labels = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.expr(cond), F.col("label")))))
    return (
        license_spans(docs, **kw)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.count(F.when(F.expr("base and label is not null"), 1)).alias("n_base"),
            F.min(F.expr("if(base, start, null)")).cast("long").alias("first_word"),
            F.max(F.expr("if(base, start, null)")).cast("long").alias("last_word"),
            labels("base").alias("base_labels"),
            labels("label is not null").alias("labels"),
            F.max("cover").cast("double").alias("score"),
        )
        .drop("row")
    )
