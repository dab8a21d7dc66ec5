"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

#: Vectors that the two codebooks are fitted on at most; rows that a block of the index holds; cells that are kept together.
SAMPLE, BLOCK, SHELVES = 20_000, 4096, 64
#: Centroids of a codebook at most, so that the driver's counts of cells stay at 8 MB; rows whose exact neighbours set the length
#: of the walk; queries that meet a block of the index at once.
CENTROIDS, PROBES, ASKED = 1024, 128, 2048


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, v): vectors of ``length`` (None: the table's usual one) without null or non-finite parts, not all zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False))).select("vec_id", "v")
    if length is not None:
        return rows.filter(F.size("v") == length)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of ``points``; an empty cluster moves to the point that is farthest off."""
    rng = np.random.default_rng(seed)
    centers = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        d = _squares(points, centers)
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, points)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centers[empty] = points[np.argsort(-d.min(1))[: len(empty)]]
    return centers


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of all centroids by rising ``first[i] + second[j]``, read off a heap."""
    by_i, by_j = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[by_i[0]] + second[by_j[0]], 0, 0)], {(0, 0)}
    while heap:
        _, a, b = heapq.heappop(heap)
        yield int(by_i[a]), int(by_j[b])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(first) and y < len(second) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[by_i[x]] + second[by_j[y]], x, y))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 2))


def walk_length(index: DataFrame, probes: np.ndarray, ids: np.ndarray, books: list[np.ndarray], counts: np.ndarray, k: int, recall: float) -> int:
    """Rows that a walk has to hold so that ``recall`` of the exact ``k`` nearest rows of the ``probes`` are among them.

    Every partition sends its nearest ``k`` of each probe, so at most probes x k rows reach the driver.
    """
    half = books[0].shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, at = np.full((len(probes), k), np.inf), np.zeros((len(probes), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _squares(probes, _matrix(batch["v"]))
            d[ids[:, None] == batch["vec_id"].to_numpy()[None, :]] = np.inf
            d, cells = np.hstack((best, d)), np.hstack((at, np.broadcast_to(batch["cell"].to_numpy(), d.shape)))
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            best, at = np.take_along_axis(d, top, 1), np.take_along_axis(cells, top, 1)
        p, r = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(at[p, r]), pa.array(best[p, r])], ["probe", "cell", "d"])

    found = index.select("vec_id", "v", "cell").mapInArrow(nearest, "probe long, cell long, d double")
    first = W.partitionBy("probe").orderBy("d", "cell")
    found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).toPandas()
    held = []
    for probe, cells in found.groupby("probe")["cell"]:
        x = probes[probe : probe + 1]
        way = (_squares(x[:, :half], books[0])[0][:, None] + _squares(x[:, half:], books[1])[0][None, :]).ravel()
        order = np.argsort(way, kind="stable")
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(counts[order])
        held += list(upto[cells.to_numpy()])
    return int(np.quantile(held, recall, method="higher")) if held else int(counts.sum())


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, centroids: int | None = None, recall: float = 0.95, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` nearest found by Euclidean distance.

    The halves of the vectors have codebooks of ``centroids`` each (None: half the square root of the rows, 4 to
    ``CENTROIDS``), fitted on a hash sample of at most ``SAMPLE`` rows; every row is indexed in the cell of its two nearest
    centroids. A query walks the centroid pairs by summed squared distance until the cells hold as many rows as the
    exact neighbours of ``PROBES`` sampled rows took for ``recall`` (:func:`walk_length`), at every size alike; counts of
    centroids**2 cells are all that the driver sees. The entries are reranked by
    exact distance. Cells are kept on ``SHELVES`` shelves, cut by hash into blocks of about ``BLOCK`` rows, so
    a very common vector is split; queries go by ``ASKED`` to a block with the list of their cells there, and every block
    sends on k rows for each query, ties to the smaller vec_id.

    Null, zero, non-finite vectors and those of another than the table's usual length take no part; of repeated rows each
    is a candidate, but a query's own id is none; without candidates the result is empty; extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = durable(usable(vectors))
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if total < 2:
        return empty
    keep = SAMPLE if total <= SAMPLE else int(SAMPLE * 0.95)
    hashed = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, keep / total))
    near = rows.filter(hashed).limit(SAMPLE).toPandas()
    near = (near if len(near) else rows.limit(64).toPandas()).sort_values("vec_id", ignore_index=True)
    points = np.array(near["v"].tolist(), np.float64)
    half = max(1, points.shape[1] // 2)
    centroids = centroids or min(CENTROIDS, max(4, -(-int(np.sqrt(total)) // 2)))
    books = [kmeans(p, min(centroids, len(p)), seed + i) if p.shape[1] else np.zeros((1, 0)) for i, p in enumerate((points[:, :half], points[:, half:]))]
    wide = len(books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"])
            cell = _squares(x[:, :half], books[0]).argmin(1) * wide + _squares(x[:, half:], books[1]).argmin(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    index = durable(rows.mapInArrow(place, "vec_id long, v array<double>, cell int"))
    counts = np.zeros(len(books[0]) * wide, np.int64)
    for row in index.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    probed = np.random.default_rng(seed).permutation(len(near))[:PROBES]
    wanted = walk_length(index, points[probed], near["vec_id"].to_numpy()[probed], books, counts, k, recall)
    shelved = np.array([counts[s::SHELVES].sum() for s in range(SHELVES)])
    pieces = F.element_at(F.array(*[F.lit(int(max(1, -(-n // BLOCK)))) for n in shelved]), F.col("shelf") + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"])
            at, shelves, lists = [], [], []
            first, second = (_squares(x[:, :half], books[0]), _squares(x[:, half:], books[1])) if len(x) else ((), ())
            for q in range(len(x)):
                held, cells = 0, []
                for i, j in multi_sequence(first[q], second[q]):
                    cell = i * wide + j
                    if counts[cell]:
                        cells.append(cell)
                        held += counts[cell]
                        if held >= wanted:
                            break
                cells = np.array(cells, np.int32)
                for shelf in np.unique(cells % SHELVES):
                    at.append(q)
                    shelves.append(int(shelf))
                    lists.append(cells[cells % SHELVES == shelf])
            picked = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked["vec_id"], picked["v"], pa.array(lists, pa.list_(pa.int32())), pa.array(shelves, pa.int32())], ["query_id", "q", "cells", "shelf"])

    asked = usable(queries, points.shape[1])
    turns = max(1, -(-asked.count() // ASKED))
    entries = index.withColumn("shelf", F.col("cell") % SHELVES).withColumn("piece", F.pmod(F.xxhash64("vec_id"), pieces).cast("int"))
    entries = entries.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    asked = asked.mapInArrow(walk, "query_id long, q array<double>, cells array<int>, shelf int")
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            ids, cell, x = right["vec_id"].to_numpy(), right["cell"].to_numpy(), np.array(right["v"].tolist(), np.float64)
            walked = np.zeros(len(counts), np.bool_)
            for own, q, cells in zip(left["query_id"], left["q"], left["cells"]):
                walked[cells] = True
                at = np.flatnonzero(walked[cell] & (ids != own))
                walked[cells] = False
                d = np.sqrt(np.square(x[at] - np.asarray(q, np.float64)).sum(1))
                top = np.argsort(d, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at[top]], "score": d[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = asked.groupBy("shelf", "piece", "turn").cogroup(entries.groupBy("shelf", "piece", "turn")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

