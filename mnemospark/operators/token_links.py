"""Links between texts of common tokens, or of near vectors, block against block.

Rows travel in packs: the distinct tokens of some hundred rows, compressed, and for each row places among them. That is about a fifth of a hash for each token, so
blocks may be large and few copies of a row are sent out.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mnemospark.functions import text as T
from mnemospark.operators.ranking import blocks_of, large_keys, spread_ids

#: Rows of either side whose pairs a task holds at once.
TILE = 2048
#: A token in so large a share of the pairs of a tile is counted by a matrix product, a rarer one pair by pair.
DENSE = 0.004


def _slim(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers that aren't negative, the bytes of equal weight side by side, compressed."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    planes = values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T
    return kind.str, zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _whole(kind: str, data: bytes) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack(ids: np.ndarray, tokens: Sequence[list[bytes]], vectors: Sequence[np.ndarray | None]) -> bytes:
    """Rows as one value; read by :func:`unpack`."""
    size, seen = np.array([len(t) for t in tokens], np.int64), {}
    given = np.array([seen.setdefault(t, len(seen)) for row in tokens for t in row], np.int64)
    cells = max(len(seen), 1)
    cell, times = np.unique(np.repeat(np.arange(len(size)), size) * cells + given, return_counts=True)
    row, word = np.divmod(cell, cells)
    # Frequent words first and like words side by side make small steps between the cells of a row and a short list of words.
    words = sorted(seen)
    like = np.array([seen[w] for w in words], np.int64)
    order = np.argsort(-np.frexp(np.bincount(word, minlength=len(words))[like])[1], kind="stable")
    place = np.empty(len(words), np.int64)
    place[like[order]] = np.arange(len(words))
    cell = row * cells + place[word]
    by = np.argsort(cell)
    parts = [_slim(p) for p in (np.diff(cell[by], prepend=0), times[by] - 1, size)]
    return pickle.dumps((np.asarray(ids), zlib.compress(b" ".join([words[i] for i in order]), 3), parts, [None if v is None else np.asarray(v) for v in vectors]))


def hashes(data: bytes) -> np.ndarray:
    """The words of a pack as numbers of 64 bits."""
    words = zlib.decompress(pickle.loads(data)[1]).decode().split()
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def unpack(data: bytes):
    """ids, row and place among the words of each distinct token of a row, how often it occurs there, tokens of each row, vectors."""
    ids, words, parts, vectors = pickle.loads(data)
    steps, times, size = (_whole(*p) for p in parts)
    cells = max(len(zlib.decompress(words).split()), 1)
    row, code = np.divmod(np.cumsum(steps, dtype=np.int64), cells)
    return ids, row.astype(np.int32), code.astype(np.int32), times.astype(np.float32) + 1, size.astype(np.int64), vectors


def _packer(keys: list[str], rows: int = 4096, chars: int = 16_000_000):
    """Packs of the rows of a partition that have the same keys; a task holds about so many characters at a time."""
    split = T.token_kernel()

    def packed(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, part in pd.concat(held, ignore_index=True).groupby(keys, sort=False):
            for x in range(0, len(part), rows):
                some = part.iloc[x:x + rows]
                data = pack(some["id"].to_numpy(), [split(t) for t in some["text"]], some["vector"].to_list())
                yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "data": [data]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for x in range(0, len(batch), 512):
                held.append(batch.iloc[x:x + 512])
                n += int(held[-1]["text"].str.len().sum())
                if n >= chars:
                    yield from packed(held)
                    held, n = [], 0
        if held:
            yield from packed(held)

    return work


class _Side:
    """The rows of one side of a block, by the count of their tokens."""

    def __init__(self, packs: list[bytes], said: list[np.ndarray], common: np.ndarray):
        ids, row, code, times, size, self.vectors, n = [], [], [], [], [], [], 0
        for data, known in zip(packs, said):
            one, r, c, t, s, v = unpack(data)
            at = np.minimum(np.searchsorted(common, known), max(len(common) - 1, 0))
            there = common[at] == known if len(common) else np.zeros(len(known), bool)
            hit = there[c]
            ids.append(one)
            row.append(r[hit] + np.int32(n))
            code.append(at[c[hit]].astype(np.int32))
            times.append(t[hit])
            size.append(s)
            self.vectors += v
            n += len(s)
        self.ids, self.size = np.concatenate(ids), np.concatenate(size)
        self.code, self.times = np.concatenate(code), np.concatenate(times)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(row), minlength=n))])
        self.order = np.argsort(self.size, kind="stable")
        self.order = self.order[self.size[self.order] > 0]
        # The length of a vector that has a direction, else 0.
        self.dim = np.array([len(v) if v is not None and np.any(v) else 0 for v in self.vectors])

    def tile(self, x: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, and row within the tile, token and count of each of their tokens."""
        rows = self.order[x:x + tile]
        lens = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        return rows, np.repeat(np.arange(len(rows), dtype=np.int32), lens), self.code[at], self.times[at]

    def units(self, rows: np.ndarray) -> np.ndarray:
        full = np.stack([self.vectors[r] for r in rows]).astype(np.float64)
        return full / np.linalg.norm(full, axis=1, keepdims=True)


class _Tiles:
    """Memory for one pair of tiles, used again for the next: fresh pages would cost more than the work done in them."""

    WIDTH, MOST = 1024, 1 << 17

    def __init__(self, tokens: int, tile: int):
        self.place = np.full(tokens, -1, np.int32)
        self.cells = [np.empty(tile * tile, np.float32) for _ in range(2)]
        self.sides = [np.empty(tile * self.WIDTH, np.float32) for _ in range(2)]
        self.hit = np.empty(tile * tile, bool)

    def prepare(self, tile):
        """A right tile with the rows of each token beside each other."""
        rows, row, code, _ = tile
        n = np.bincount(code, minlength=len(self.place)).astype(np.int32)
        return rows, row[np.argsort(code, kind="stable")], (np.cumsum(n) - n).astype(np.int32), n

    def shared(self, left, right) -> np.ndarray:
        """How many tokens of each left row, repeats counted, occur in each right row of two tiles; valid until the next call."""
        (rows, row, code, times), (others, places, starts, n_right) = left, right
        nl, nr = len(rows), len(others)
        out, more = (c[:nl * nr].reshape(nl, nr) for c in self.cells)
        dense = np.flatnonzero(np.bincount(code, minlength=len(n_right)) * n_right >= DENSE * nl * nr)
        self.place[dense] = np.arange(len(dense))
        at = self.place[code]
        self.place[dense] = -1
        hot = np.flatnonzero(at >= 0)
        if not len(dense):
            out[:] = 0
        for low in range(0, len(dense), self.WIDTH):
            some = dense[low:low + self.WIDTH]
            a, b = (c[:n * len(some)].reshape(n, len(some)) for c, n in zip(self.sides, (nl, nr)))
            a[:], b[:] = 0, 0
            here = hot if len(dense) <= self.WIDTH else hot[(at[hot] >= low) & (at[hot] < low + len(some))]
            a[row[here], at[here] - low] = times[here]
            n = n_right[some]
            b[places[self.spread(starts[some], n)], np.repeat(np.arange(len(some)), n)] = 1
            np.matmul(a, b.T, out=more if low else out)
            if low:
                out += more
        met = n_right[code]
        rest = np.flatnonzero((at < 0) & (met > 0))
        met, flat = met[rest], out.ravel()
        upto, first, base, times = np.cumsum(met, dtype=np.int64), starts[code[rest]], row[rest] * nr, times[rest]
        done = 0
        while done < len(rest):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + self.MOST, side="right")))
            n = met[done:end]
            np.add.at(flat, np.repeat(base[done:end], n) + places[self.spread(first[done:end], n)], np.repeat(times[done:end], n))
            done = end
        return out

    def reached(self, shared: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where shared is at least the sum of both sides."""
        least, hit = (c[:shared.size].reshape(shared.shape) for c in (self.cells[1], self.hit))
        np.add.outer(la, lb, out=least)
        np.greater_equal(shared, least, out=hit)
        return np.divmod(np.flatnonzero(hit.ravel()), shared.shape[1])

    @staticmethod
    def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """starts[0] to starts[0] + n[0] - 1, then those of the next."""
        at = np.repeat(starts - np.cumsum(n, dtype=np.int32) + n, n)
        at += np.arange(len(at), dtype=np.int32)
        return at


def link_block(cosine_floor: float, token_floor: float, tile: int = TILE) -> Callable[[list[bytes], list[bytes]], Iterator[pd.DataFrame]]:
    """from_id, to_id, strength of the links between the packs of both sides of a block: cosine where both rows have a vector of one size,
    else the tokens they share over all they have."""

    def links(left: _Side, right: _Side, i: np.ndarray, j: np.ndarray, strength: np.ndarray) -> pd.DataFrame:
        f, t = left.ids[i], right.ids[j]
        other = np.asarray(f != t, bool) if len(f) else np.zeros(0, bool)
        return pd.DataFrame({"from_id": f[other], "to_id": t[other], "strength": strength[other]})

    def near(left: _Side, right: _Side) -> Iterator[pd.DataFrame]:
        for size in np.intersect1d(left.dim[left.dim > 0], right.dim[right.dim > 0]):
            rows, cols = (np.flatnonzero(s.dim == size) for s in (left, right))
            for x in range(0, len(rows), tile):
                a = left.units(rows[x:x + tile])
                for y in range(0, len(cols), tile):
                    strength = np.round(a @ right.units(cols[y:y + tile]).T, 9)
                    i, j = np.nonzero(strength >= cosine_floor)
                    yield links(left, right, rows[x + i], cols[y + j], strength[i, j])

    def match(lefts: list[bytes], rights: list[bytes]) -> Iterator[pd.DataFrame]:
        said = [[hashes(p) for p in packs] for packs in (lefts, rights)]
        common = np.intersect1d(*[np.unique(np.concatenate(h)) for h in said], assume_unique=True)
        left, right = (_Side(packs, h, common) for packs, h in zip((lefts, rights), said))
        del said
        yield from near(left, right)
        if not len(common):
            return
        tiles, share = _Tiles(len(common), tile), token_floor / (1 + token_floor) * (1 - 1e-5)
        for y in range(0, len(right.order), tile):
            others = tiles.prepare(right.tile(y, tile))
            lb = right.size[others[0]]
            for x in range(0, len(left.order), tile):
                # A left row of n tokens shares n at most, so it links to none that has more than n / floor.
                if left.size[left.order[min(x + tile, len(left.order)) - 1]] < token_floor * lb[0] * (1 - 1e-9):
                    continue
                own = left.tile(x, tile)
                la = left.size[own[0]]
                shared = tiles.shared(own, others)
                i, j = tiles.reached(shared, (la * share).astype(np.float32), (lb * share).astype(np.float32))
                both = shared[i, j].astype(np.float64)
                strength = both / np.maximum(la[i] + lb[j] - both, 1e-12)
                rows, cols = own[0][i], others[0][j]
                keep = (strength >= token_floor) & ((left.dim[rows] == 0) | (left.dim[rows] != right.dim[cols]))
                yield links(left, right, rows[keep], cols[keep], strength[keep])

    return match


def _work(match: Callable[[list[bytes], list[bytes]], Iterator[pd.DataFrame]]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packs: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            for first, data in zip(batch["_left"], batch["data"]):
                packs[not first].append(data)
        if all(packs):
            yield from (found for found in match(*packs) if len(found))

    return work


def linked(left: DataFrame, right: DataFrame, on: Sequence[str], cosine_floor: float, token_floor: float, block_rows: int) -> DataFrame:
    """from_id, to_id, strength of the links between rows whose keys ``on`` agree. Both sides have id, ``on``, vector and text.

    A key of more than ``block_rows`` rows is dealt over blocks by id (:func:`ranking.large_keys`).
    """
    keys, kinds = list(on), [dict(d.dtypes)["id"] for d in (left, right)]

    blocks = large_keys(left, right, keys, block_rows)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        sized = df.dropna(subset=keys).crossJoin(F.broadcast(blocks)).select(
            *keys, F.pmod(F.xxhash64("id"), blocks_of(own, keys)).cast("int").alias("_own"), blocks_of(other, keys).alias("_others"), "id", "vector", "text")
        fields = [*keys, "_own", "_others"]
        schema = ", ".join(f"{k} {kind}" for k, kind in sized.select(*fields).dtypes) + ", data binary"
        packs = sized.mapInPandas(_packer(fields), schema)
        return packs.select(*keys, F.col("_own").alias(f"_b{own}"), F.explode(F.sequence(F.lit(0), F.col("_others") - 1)).alias(f"_b{other}"),
                            F.lit(own == "l").alias("_left"), "data").select(*keys, "_bl", "_br", "_left", "data")

    # The fixed count of partitions is not coalesced: blocks are small in bytes and long in work.
    rows = spread_ids(dealt(left, "l", "r").unionByName(dealt(right, "r", "l")), *keys, "_bl", "_br")
    return rows.groupBy(*keys, "_bl", "_br").applyInPandas(
        _work(link_block(cosine_floor, token_floor)), f"from_id {kinds[0]}, to_id {kinds[1]}, strength double")
