"""Cleaning pipeline over documents: quality rules, line dedup, near-dedup, surrogates, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import line_dedup, packing, pii_surrogates, quality_rules, weighted_minhash
from mnemospark.llm.common import shared_folder, table


def _row(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``row``, with ``n_chars`` following the new text where there is one."""
    row: Column = F.col("row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("row")).select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; a document may be left with an empty text."""
    return _row(line_dedup.dedup_lines(docs), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near copies."""
    return weighted_minhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return _row(pii_surrogates.replace(docs), docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a token-budget batch for every document."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_dedup", near), ("pii", private), ("packing", batches)]

#: Near-duplicate classes are connected components of sampled candidates, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage keeps is written as Parquet in the shared folder and
    reread by the next, so that lost executors repeat one stage at most and each stage's rows can be looked at."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
