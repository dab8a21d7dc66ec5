"""Balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, durable, ranked

#: Groups that one task differences, and partial partitions that meet in a step further up.
CHUNK, FAN_IN = 50_000, 512


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions (one row of k part sums each).

    The two with the largest spread are combined, the largest part of one with the smallest of the other,
    until one is left. Returns, for each row, where its parts went, and the final sums.
    """
    k = sums.shape[1]
    heap, merged = [], []
    for i, row in enumerate(sums.tolist()):
        order = sorted(range(k), key=row.__getitem__, reverse=True)
        parts = [row[p] for p in order]
        heap.append((parts[-1] - parts[0], i, parts, order))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, i, a, at_a = heapq.heappop(heap)
        _, j, b, at_b = heapq.heappop(heap)
        parts = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(k), key=parts.__getitem__, reverse=True)
        merged.append((i, at_a, j, at_b[::-1]))
        parts = [parts[p] for p in order]
        heapq.heappush(heap, (parts[-1] - parts[0], serial, parts, order))
        serial += 1
    where = {heap[0][1]: None}
    final = [0] * k
    for rank, p in enumerate(heap[0][3]):
        final[p] = heap[0][2][rank]
    goes = np.empty((len(sums), k), np.int64)
    where[heap[0][1]] = list(range(k))
    for step in range(len(merged) - 1, -1, -1):
        to = where.pop(len(sums) + step)
        i, at_a, j, at_b = merged[step]
        for child, at in ((i, at_a), (j, at_b)):
            own = [0] * k
            for position, part in enumerate(at):
                own[part] = to[position]
            where[child] = own
    for i, own in where.items():
        goes[i] = own
    return goes, np.array(final)


def _levels(partials: DataFrame, chunks: int, shards: int) -> DataFrame:
    """(chunk, part, shard): where the parts of every chunk end, by differencing level over level."""
    schema = "chunk long, parent long, sums array<long>, goes array<long>"

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        goes, final = difference(np.array(frame["sums"].tolist(), np.int64))
        out = pd.DataFrame({"chunk": frame["chunk"].to_numpy(), "parent": frame["parent"].to_numpy(), "sums": [final.tolist()] * len(frame), "goes": goes.tolist()})
        return out

    step = durable(partials.withColumn("parent", F.floor(F.col("chunk") / FAN_IN).cast("long")).groupBy("parent").applyInPandas(combine, schema))
    own = step.select("chunk", F.posexplode("goes").alias("part", "shard"), "parent")
    parents = -(-chunks // FAN_IN)
    if parents > 1:
        above = _levels(step.groupBy("parent").agg(F.first("sums").alias("sums")).withColumnRenamed("parent", "chunk"), parents, shards)
        above = above.select(F.col("chunk").alias("parent"), F.col("part").alias("shard"), F.col("shard").alias("final"))
        own = own.join(above, ["parent", "shard"]).select("chunk", "part", F.col("final").alias("shard"))
    return own.select("chunk", "part", "shard")


def shard(docs: DataFrame, shards: int = 8, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, near equal in bytes with equal texts together.

    Groups of equal texts are summed before anything meets. Each task differences the groups of one hash
    chunk to ``shards`` parts; the chunks' parts are then differenced in the same way, ``FAN_IN`` at a time.
    A group larger than a fair share stays whole in its shard. Slots follow hash order without holding a
    shard in one task. Null texts count as empty: size 1, crc 0, one group with
    the empty ones; repeated rows are members of their
    group; extra columns are not read; an empty table gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    h1, h2 = digest(text)
    rows = durable(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h1.alias("h1"), h2.alias("h2"),
    ))
    n = rows.count()
    chunks = max(1, -(-n // chunk))
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")).withColumn("chunk", F.pmod(F.xxhash64("h1", "h2"), F.lit(chunks)))

    def divide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "h1", "h2"], ascending=[False, True, True])
        sums = np.zeros((len(frame), shards), np.int64)
        sums[:, 0] = frame["bytes"]
        goes, _ = difference(sums)
        return pd.DataFrame({"h1": frame["h1"].to_numpy(), "h2": frame["h2"].to_numpy(), "bytes": frame["bytes"].to_numpy(), "chunk": frame["chunk"].to_numpy(), "part": goes[:, 0]})

    divided = durable(groups.groupBy("chunk").applyInPandas(divide, "h1 long, h2 long, bytes long, chunk long, part long"))
    sums = divided.groupBy("chunk", "part").agg(F.sum("bytes").alias("bytes")).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("part", "bytes"))).alias("by_part"))
    partials = sums.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda p: F.coalesce(F.try_element_at("by_part", p.cast("long")), F.lit(0).cast("long"))).alias("sums"))
    final = _levels(partials, chunks, shards)
    placed = divided.join(final, ["chunk", "part"]).select("h1", "h2", F.col("shard").cast("int").alias("shard"))
    joined = rows.join(placed, ["h1", "h2"])
    spread = max(1, n // shards // 20_000)
    order = [F.xxhash64("doc_id", "h1"), F.col("doc_id"), F.col("h1"), F.col("h2")]
    return ranked(joined, "shard", order, "slot", spread).select("doc_id", "size", "text_crc32", "shard", "slot")
