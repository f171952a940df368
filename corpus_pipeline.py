"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays, documents
with benchmark passages go, and what is left is packed into sequences.

Every stage is written as Parquet in the shared folder and read again by the next, so a lost executor costs one stage at
most. By the time a stage is called its predecessor's result has been written, so what that one kept in the shared folder
goes. Null and empty texts pass all filters; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontaminate, jaccard, linededup, packing, toxicity
from weft.llm.store import collected, small_batches, sweep, written

_left: list = []


def _stage(batch: int):
    """A stage whose workers get batches of so many bytes, with the tables swept that the stage before it left behind."""

    def of(f):
        @functools.wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            sweep(_left)
            _left.clear()
            small_batches(spark, batch)
            with collected() as made:
                out = f(spark, docs, sf_dir)
            _left.extend(made)
            return out

        return run

    return of


@_stage(1 << 19)
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels outside the held-out quarter."""
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels), threshold=0.3)


@_stage(2 << 20)
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, to one word or one in 20, go; so do documents with nothing else."""
    return linededup.deduped(docs, words_an_edit=20)


@_stage(1 << 20)
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.75 or more."""
    return jaccard.one_of_each(docs, k=5, percent=75)


@_stage(1 << 20)
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in whatever order, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage(1 << 19)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]

#: SQL cannot express the learned and the tokenizing stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _left.clear()  # a result of an earlier run may still need its tables
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
