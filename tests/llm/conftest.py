import pytest

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and odd texts, ties, repeated rows, one very long text and a clashing column."""
    long = " ".join(f"w{i % 97} x{i}" for i in range(30_000))
    rows = [
        (1, None, "a"), (2, "", None), (None, "no id here at all", "b"), (3, " \n\t ", "c"), (4, "same text as the next one has it here", "d"), (5, "same text as the next one has it here", "e"),
        (5, "same text as the next one has it here", "e"), (6, long, "f"), (7, "short", "g"), (8, "Licensed under the Apache License, Version 2.0.", "h"), (9, "ünï cödé 　 wörds 🎉 <|endoftext|> tail  ", "i"),
    ]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, row string, n_words int, h string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
