"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only where it names none (tests), one in its warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage by a reliable checkpoint in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Compute once as a compressed table in the shared folder; unlike a checkpoint it has the size that its files have."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, and only if the whole is."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def digest(value: Column) -> list[Column]:
    """Two independent 64-bit hashes: a 128-bit identity of a value (null has one of its own)."""
    there = value.isNull()
    return [F.xxhash64(F.lit(1), there, value), F.xxhash64(F.lit(2), value, there)]


def learn_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def ranked(df: DataFrame, key: str, order: list[Column], out: str, spread: int) -> DataFrame:
    """Gapless rank from 0 within ``key`` that no single task has to hold.

    Rows of a key are dealt into ``spread`` buckets by the hash of ``order``, ranked inside, and moved
    by the counts of the buckets before. The counts are at most keys x ``spread`` rows.
    """
    from pyspark.sql import Window as W

    cell, within, start, size = (fresh(df, c) for c in ("_cell", "_within", "_start", "_size"))
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(spread)))
    sizes = dealt.groupBy(key, cell).agg(F.count("*").alias(size))
    before = W.partitionBy(key).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_k"), F.col(cell).alias("_c"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    inside = dealt.withColumn(within, F.row_number().over(W.partitionBy(key, cell).orderBy(*order)) - 1)
    joined = inside.join(starts, (inside[key].eqNullSafe(starts["_k"])) & (inside[cell] == starts["_c"]))
    return joined.withColumn(out, (F.col(start) + F.col(within)).cast("long")).drop(cell, within, start, "_k", "_c")


class Texts:
    """UTF-8 bytes of a block of texts with vectorised word bounds and hashes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.ends = data, ends
        self.starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start, byte end and text number of every word."""
        inside = _NOT_SPACE[self.data]
        edge = np.zeros(len(inside) + 1, np.bool_)
        edge[self.starts[self.starts < len(inside)]] = True
        before = np.concatenate(([False], inside[:-1]))
        first = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate((inside[1:], [False]))
        edge[-1] = True
        last = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return first, last, np.searchsorted(self.ends, first, "right")

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: differences of a running polynomial, then mixed."""
        n = len(self.data)
        up, down = _powers(n + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n])))
        return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


_NOT_SPACE = np.ones(256, np.bool_)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for offsets below ``n``."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 21), base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return [p[:n] for p in _POWERS]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive rows of an Arrow batch whose texts have about ``limit`` bytes: (row from, row to, texts).

    The bytes are Arrow's own; nulls count as empty. A longer text is a block by itself, so memory
    follows the longest text and not the batch.
    """
    values = batch.column(column)
    values = values.cast(pa.large_string()) if values.type != pa.large_string() else values
    values = values.fill_null("")
    if not len(values):
        return
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, at + 4096, len(values))
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at])
        at = to
