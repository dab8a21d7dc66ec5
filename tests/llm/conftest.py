from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
    T.StructField("h1", T.StringType()), T.StructField("bucket", T.StringType()),
])


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, with extra columns whose names the operators use themselves."""

    def table(rows):
        full = [(i, t, lang, "src", len(t) if t else None, "r", "h", "b") for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA)

    return table


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, ties, a repeated row, one row without id, one very long text."""
    words = " ".join(f"wort{i % 997}a" for i in range(120_000))
    return make([
        (1, None, None), (2, "", "en"), (3, " \n\t\n", "en"), (4, "same text here\nand another line of it", "en"), (4, "same text here\nand another line of it", "en"),
        (5, "same text here\nand another line of it", "en"), (None, "no id at all but words", "de"), (6, words, "de"), (7, "1234 5678 !!", "fr"),
        (8, "Ünïcödé 中文 😀 tëxt", None), (None, None, None),
    ])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
