"""The pipeline stage by stage on the smallest documents, each against what its operator says of the stage's own input."""

import corpus_pipeline
import pyarrow as pa
from weft.llm import decontaminate, jaccard, store

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == columns and after.count() <= docs.count() and after.count() > docs.count() / 2
        if name == "n-gram Jaccard join":
            assert jaccard.jaccard_components(after).where("doc_id <> component_id").count() == 0
        if name == "benchmark decontamination":
            assert decontaminate.contamination(after, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
            texts = [r.text for r in after.collect()]
            assert not any(r.text in t for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for t in texts)
        if i == 4:
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_packed_where_a_block_has_no_new_words(spark):
    """Texts of more than a block each, in one task: all but the first hold words that the task has met."""
    docs = spark.createDataFrame([(i, "the same words " * 80_000) for i in range(3)], "doc_id long, text string").coalesce(1)
    got = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs, SF).collect()
    per = {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i) for i in range(3)}
    assert per[0] == per[1] == per[2] and sum(n for _, _, n, _ in per[0]) > 240_000


def test_stages_bound_the_batches_of_their_workers(spark):
    """Packing's workers get at most 512 KB and a text at once, whatever the stage before had; a session's own bound stays."""
    docs = spark.createDataFrame([(i, "some more words " * 500) for i in range(400)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows * 8000])], names=["size"])

    largest = lambda: max(r.size for r in docs.mapInArrow(sizes, "size long").collect())
    before = spark.conf.get(store.BATCH)
    try:
        spark.conf.unset(store.BATCH)
        for name, most in (("line dedup", 2 << 20), ("best-fit packing", 1 << 19)):
            dict(corpus_pipeline.STAGES)[name](spark, docs.limit(1), SF)
            assert most / 2 < largest() < most + 20_000
        spark.conf.set(store.BATCH, "3000001")
        dict(corpus_pipeline.STAGES)["best-fit packing"](spark, docs.limit(1), SF)
        assert spark.conf.get(store.BATCH) == "3000001"
    finally:
        spark.conf.set(store.BATCH, before)
