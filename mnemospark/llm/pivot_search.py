"""Exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

SCALE = 1024
#: Rows that pivots are chosen from; pivots at most; annuli of a pivot at most; rows of an annulus aimed at; rows of a block of
#: one; queries of a block.
SAMPLE, PIVOTS, RINGS, RING, BLOCK, ASKED = 4096, 64, 64, 1024, 4096, 1024
#: A wave looks at so many times the rows of the one before.
GROWTH = 8
#: Inner products below this are exact in double precision; relative room that bounds leave for rounding.
_EXACT, _ROOM = 1 << 53, 1e-6


class Annuli(NamedTuple):
    """Pivots as rows, and for each annulus its pivot, least and largest distance, rows and blocks; ``radius`` is the norm that
    all lifted vectors share."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    radius: float


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, x): whole-number vectors of ``length`` (None: the table's usual one) without null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine & (F.size("embedding") > 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    if length is None:
        usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = usual["d"] if usual else 0
    return rows.filter(F.size("x") == length)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.array(column.tolist(), np.int64)


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    """Vectors with one more component that gives all of them the norm ``radius``: nearness then orders as the inner product."""
    x = x.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(radius * radius - (x * x).sum(1), 0.0))[:, None]))


def turned(q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries stretched to the norm ``radius`` (zero stays zero) with nothing in the further component, and the stretch."""
    q = q.astype(np.float64)
    norm = np.sqrt((q * q).sum(1))
    stretch = np.where(norm > 0, radius / np.where(norm > 0, norm, 1.0), 0.0)
    return np.hstack((q * stretch[:, None], np.zeros((len(q), 1)))), stretch


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0.0))


def spread_points(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of ``points``, each farthest from those before; fewer if the rest repeats them."""
    chosen, away = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact whole inner products."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def lower_bounds(q: np.ndarray, annuli: Annuli) -> np.ndarray:
    """For every lifted query the least distance that a vector of each annulus can have, by the triangle inequality."""
    d = distances(q, annuli.pivots)[:, annuli.pivot]
    return np.maximum(np.maximum(annuli.low - d, d - annuli.high), 0.0)


def _index(entries: DataFrame) -> tuple[DataFrame, Annuli]:
    """Blocks of the index (annulus, piece, ids, x) and what bounds need to know of the annuli.

    Pivots are spread points of a bounded hash sample; every vector is keyed by its nearest pivot and the distance to it, and a
    pivot's vectors are cut into annuli between quantiles of that distance, at most ``PIVOTS * RINGS`` in all.
    """
    size = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    known = entries.agg(F.count("*").alias("n"), F.max(size).alias("m")).first()
    radius = float(np.sqrt(known["m"]))
    sample = entries.filter(F.pmod(F.xxhash64(F.lit(7), "x"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, SAMPLE / known["n"]))).limit(SAMPLE)
    points = _matrix(sample.toPandas().sort_values("first")["x"])
    if not len(points):
        points = _matrix(entries.limit(1).toPandas()["x"])
    pivots = spread_points(lifted(points, radius), int(min(PIVOTS, max(1, np.sqrt(known["n"] / RING)))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(lifted(_matrix(batch["x"]), radius), pivots) if batch.num_rows else np.zeros((0, 1))
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch["ids"], batch["x"], pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own])], ["ids", "x", "pivot", "d"])

    near = durable(entries.select("ids", "x").mapInArrow(keyed, "ids array<long>, x array<long>, pivot int, d double"))
    rings = int(min(RINGS, max(1, known["n"] / RING / len(pivots))))
    cuts = F.percentile_approx("d", [i / rings for i in range(1, rings)], 100 * rings) if rings > 1 else F.array().cast("array<double>")
    edges = {r["pivot"]: sorted(set(r["cuts"])) for r in near.groupBy("pivot").agg(cuts.alias("cuts")).collect()}
    table = F.array(*[F.array(*[F.lit(float(c)) for c in edges.get(p, [])]).cast("array<double>") for p in range(len(pivots))])
    ring = F.size(F.filter(F.get(table, F.col("pivot")), lambda c: c < F.col("d")))
    near = near.withColumn("annulus", F.col("pivot") * RINGS + ring)
    found = near.groupBy("annulus").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).orderBy("annulus").collect()
    names = np.array([r["annulus"] for r in found])
    annuli = Annuli(pivots, names // RINGS, *(np.array([r[c] for r in found], t) for c, t in (("low", float), ("high", float), ("n", np.int64))), radius)
    pieces = -(-annuli.rows // BLOCK)
    at = F.create_map(*[F.lit(v) for i, name in enumerate(names) for v in (int(name), i)])
    near = near.withColumn("annulus", F.element_at(at, F.col("annulus")))
    counts = F.array(*[F.lit(int(p)) for p in pieces])
    placed = near.withColumn("piece", F.pmod(F.xxhash64("x"), F.get(counts, F.col("annulus"))).cast("int"))

    def packed(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(block["x"]), block["ids"]
        return pd.DataFrame({"annulus": [key[0]], "piece": [key[1]], "ids": [np.concatenate(ids.tolist()).astype(np.int64).tobytes()],
                             "n_ids": [ids.str.len().to_numpy(np.int32).tobytes()], "x": [x.tobytes()]})

    blocks = placed.select("annulus", "piece", "ids", "x").groupBy("annulus", "piece").applyInPandas(packed, "annulus int, piece int, ids binary, n_ids binary, x binary")
    return durable(blocks), annuli


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, first: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` highest inner products of whole-number vectors, exactly.

    Every component becomes ``floor(1024 * c)``. One more component lifts all vectors to one norm, so that the highest inner
    product is the least distance. Vectors are keyed by their nearest pivot and the distance to it; a query expands annuli
    in the order of their lower bounds, ``first`` rows in the first wave and ``GROWTH`` times as many in each next, and is
    done when the triangle inequality keeps every annulus left below its k-th score. Where nothing can be
    excluded, the last wave reaches all rows, so the result is exact in any case. A wave sends blocks of queries to the
    blocks of the index they need; only what beats a query's k-th score so far comes back, at most k rows from a block.

    Of equal vectors the ``k + 1`` smallest ids are kept, which is all that can be in a result, so a very common vector is one
    entry; an annulus is cut into blocks of about ``BLOCK``. Ties go to the smaller vec_id. Vectors that are null, hold null or
    non-finite components, have no vec_id or another than the table's usual length take no part; rows of the query's own id
    are no candidates; rows with equal id and vector count once, as candidate and as query. Zero vectors score 0.
    Empty tables give an empty result, extra columns are not read. Scores must fit a long.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = durable(usable(vectors))
    some = rows.first()
    if some is None:
        return empty
    length = len(some["x"])
    same = W.partitionBy("x").orderBy("vec_id")
    ranked = rows.distinct().withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    entries = durable(ranked.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.get("ids", F.lit(0))))
    blocks, annuli = _index(entries)
    total = int(annuli.rows.sum())

    # A query is its id and vector; its number keeps rows of one id with different vectors apart.
    asked = usable(queries, length).distinct().select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.xxhash64("x").alias("h"))
    turns = max(1, -(-asked.count() // ASKED))
    asked = durable(asked.withColumn("turn", F.pmod(F.xxhash64("query_id", "h"), F.lit(turns)).cast("int")))
    best, reach, seen = None, max(first, k + 1), 0
    while seen < total:
        wave = asked
        if best is not None:
            last = best.groupBy("query_id", "h").agg(F.max_by(F.struct("score", "vec_id"), "rank").alias("kth"), F.count("*").alias("held"))
            last = last.filter(F.col("held") >= k).select(F.col("query_id").alias("b_id"), F.col("h").alias("b_h"), "kth")
            wave = wave.join(last, (F.col("query_id") == F.col("b_id")) & (F.col("h") == F.col("b_h")), "left")
            wave = wave.select("query_id", "q", "h", "turn", F.col("kth.score").alias("least"), F.col("kth.vec_id").alias("tie"))
        else:
            wave = wave.select("*", F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("tie"))
        upto = min(total, reach)
        packs = durable(wave.groupBy("turn").applyInPandas(_packed, "turn int, who binary, h binary, q binary, least binary, tie binary, open binary"))
        sent = durable(packs.mapInPandas(_expand(annuli, length, seen, upto), "turn int, annulus int, mine binary"))
        if not sent.isEmpty():
            pairs = sent.join(packs, "turn").join(blocks, "annulus")
            found = pairs.mapInPandas(_meet(k, length), "query_id long, h long, vec_id long, score long")
            found = found if best is None else found.unionByName(best.drop("rank"))
            order = W.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
            best = durable(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        seen, reach = upto, reach * GROWTH
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score") if best is not None else empty


def _packed(block: pd.DataFrame) -> pd.DataFrame:
    """A block of queries as one row, with what each has to beat."""
    block = block.sort_values(["query_id", "h"], ignore_index=True)
    number = lambda c: block[c].astype("Int64").fillna(0).to_numpy(np.int64).tobytes()
    return pd.DataFrame({"turn": block["turn"].iloc[:1], "who": [number("query_id")], "h": [number("h")], "q": [_matrix(block["q"]).tobytes()],
                         "least": [number("least")], "tie": [number("tie")], "open": [block["least"].isna().to_numpy().tobytes()]})


def _expand(annuli: Annuli, length: int, seen: int, upto: int):
    """Which annuli the queries of a block need between ``seen`` and ``upto`` rows of their own order of bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                at, stretch = turned(np.frombuffer(row.q, np.int64).reshape(-1, length), annuli.radius)
                low = lower_bounds(at, annuli)
                order = np.argsort(low, axis=1, kind="stable")
                # An annulus belongs to the wave in which the rows before it end.
                start = np.cumsum(annuli.rows[order], axis=1) - annuli.rows[order]
                mine = np.zeros(low.shape, np.bool_)
                np.put_along_axis(mine, order, (start >= seen) & (start < upto), 1)
                # |q' - v'|^2 = |q'|^2 + radius^2 - 2 * stretch * score
                square = (at * at).sum(1) + annuli.radius**2 - 2 * stretch * np.frombuffer(row.least, np.int64)
                near = low * low <= (square + _ROOM * (annuli.radius**2 + 1.0))[:, None]
                mine &= near | np.frombuffer(row.open, np.bool_)[:, None]
                needed = np.flatnonzero(mine.any(0))
                yield pd.DataFrame({"turn": row.turn, "annulus": needed, "mine": [np.flatnonzero(mine[:, a]).astype(np.int32).tobytes() for a in needed]})

    return run


def _meet(k: int, length: int, step: int = 256):
    """Candidates of each pair of a block of queries and a block of the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.frombuffer(row.x, np.int64).reshape(-1, length)
                own, ids = np.repeat(np.arange(len(x)), np.frombuffer(row.n_ids, np.int32)), np.frombuffer(row.ids, np.int64)
                order = np.argsort(ids, kind="stable")
                own, ids = own[order], ids[order]
                mine, free = np.frombuffer(row.mine, np.int32), np.frombuffer(row.open, np.bool_)
                q = np.frombuffer(row.q, np.int64).reshape(-1, length)
                who, hashes, least, tie = (np.frombuffer(b, np.int64) for b in (row.who, row.h, row.least, row.tie))
                for at in range(0, len(mine), step):
                    part = mine[at : at + step]
                    scores = inner(q[part], x)[:, own]
                    good = free[part, None] | (scores > least[part, None]) | ((scores == least[part, None]) & (ids < tie[part, None]))
                    i, j = np.nonzero(good & (ids[None, :] != who[part, None]))
                    s = scores[i, j]
                    rank = np.lexsort((ids[j], -s, i))
                    i, j, s = i[rank], j[rank], s[rank]
                    top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
                    i, j, s = part[i[top]], j[top], s[top]
                    yield pd.DataFrame({"query_id": who[i], "h": hashes[i], "vec_id": ids[j], "score": s})

    return run
