"""Packing into length buckets of least padding and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ranked

def token_count(text: Column) -> Column:
    """Runs of letters and digits and single other characters, and one end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + 1).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper ends of at most ``buckets`` ranges of the sorted ``lengths`` that minimise the total padding.

    The cost of a range is its largest length times its rows. With ``rows[i]`` rows before length i, a range that
    starts at i adds the line ``best[i] - rows[i] * x`` at the end of length x; slopes fall with i and x grows, so
    the lower envelope is a queue and each bucket takes one pass over the lengths. Whole numbers, so exact.
    """
    size = [int(x) for x in lengths]
    rows = [0, *np.cumsum(counts, dtype=object)]
    n, k = len(size), min(buckets, len(size))
    best = [x * r for x, r in zip(size, rows[1:])]
    before = []
    for b in range(1, k):
        after, start, queue = list(best), [0] * n, []
        head = 0
        for j in range(b, n):
            slope, level = -rows[j], best[j - 1]
            while len(queue) - head > 1:
                (m1, c1, _), (m2, c2, _) = queue[-2:]
                if (level - c1) * (m1 - m2) > (c2 - c1) * (m1 - slope):
                    break
                queue.pop()
            queue.append((slope, level, j))
            x = size[j]
            while len(queue) - head > 1 and queue[head + 1][0] * x + queue[head + 1][1] < queue[head][0] * x + queue[head][1]:
                head += 1
            after[j], start[j] = queue[head][0] * x + queue[head][1] + x * rows[j + 1], queue[head][2]
        best = after
        before.append(start)
    ends = [n - 1]
    for start in reversed(before):
        ends.append(start[ends[-1]] - 1)
    return lengths[ends[::-1]]


def pack(docs: DataFrame, budget: int = 16384, buckets: int = 16, seed: int = 11) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot) of every row of ``docs``.

    The global histogram of exact lengths decides the boundaries by dynamic programming; the driver holds a row for
    each distinct length, at most as many as the longest text has tokens. A bucket's batches hold floor(budget / boundary) rows, at least one, so a batch
    padded to its boundary stays within the budget; a text longer than the budget is a batch by itself.
    Rows take their places in hash order, ranked without holding a bucket in one task. Null and empty
    texts have the end token only; repeated rows take a place each; extra columns are not read. Rows with equal ids and
    texts stand side by side; an empty table gives an empty result.
    """
    sized = durable(docs.select("doc_id", token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("t")))
    histogram = sized.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n")).toPandas().sort_values("length")
    if histogram.empty:
        return sized.select("doc_id", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_tokens", "long"), ("batch", "long"), ("slot", "int"))])
    ends = [int(x) for x in optimal_boundaries(histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)]
    bounds = F.array(*[F.lit(x).cast("long") for x in ends])
    bucket = F.size(F.filter(bounds, lambda x: x < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumn("bucket_tokens", F.get(bounds, F.col("bucket")))
    spread = max(1, int(histogram["n"].sum()) // 20_000)
    order = [F.xxhash64(F.lit(seed), "doc_id", "t"), F.col("doc_id"), F.col("t")]
    numbered = ranked(placed, "bucket", order, "at", spread)
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("at") / capacity).cast("long").alias("batch"),
        (F.col("at") % capacity).cast("int").alias("slot"),
    )
