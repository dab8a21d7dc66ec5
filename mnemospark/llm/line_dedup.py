"""Removal of lines that several documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest

#: A-Z only: other letters keep their case in a key.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_ENDS)), _UPPER, _LOWER)


def shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, text identity, pos) of every line to drop.

    Lines of keys with at least ``min_chars`` code points found in at least ``min_docs`` documents go
    everywhere but in the smallest doc_id that holds the key. Only 128-bit hashes, ids and positions are
    shuffled. Counting goes by (key, document) first, so a key in a third of all documents is spread
    over all tasks before its partial counts meet; the join back leaves a hot key to skew splitting.
    Rows without doc_id don't count as documents and keep their lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = digest(F.col("key"))
    lines = (
        docs.filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("doc_id", "t", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "t", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    shared = (
        held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("n_docs") >= min_docs)
    )
    return lines.join(shared, ["h1", "h2"]).filter(F.col("doc_id") != F.col("first_doc")).select("doc_id", "t", "pos")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` with the kept lines as ``text``, in a struct ``row`` beside ``n_lines`` and ``n_dropped``.

    Null and empty texts are one empty line and become "". Repeated rows of one id are one document and
    both lose the same lines. Extra columns ride along inside ``row`` and can't clash.
    """
    dropped = (
        shared_lines(docs, min_chars, min_docs).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("dropped"))
        .select(F.col("doc_id").alias("drop_id"), F.col("t").alias("drop_t"), "dropped")
    )
    rows = docs.select(F.struct("*").alias("row")).withColumn("t", F.xxhash64("row.text"))
    joined = rows.join(dropped, (F.col("row.doc_id") == F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left")
    # Behind a generator the lines are split once, not once for each kept position.
    lines = joined.select("row", "dropped", F.explode(F.array(F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1))).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    )
    return lines.select(
        F.col("row").withField("text", text).alias("row"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
