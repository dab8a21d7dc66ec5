"""Language of a text by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts, blocks, learn_fold, mix

#: Dimensions of a vector and letters of an n-gram.
DIM, GRAM = 1024, 3
_CODES = 0x110000


class Letters:
    """Code points of texts as letters; everything else is one blank, and blanks in a row are one."""

    def __init__(self) -> None:
        self._kind = np.zeros(_CODES, np.int8)  # 0 not seen yet, 1 letter, 2 other

    def ngrams(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, packed n-gram, count) over the letters of each text with a blank at both ends."""
        points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
        ends = heads[texts.ends]
        for code in np.unique(points[self._kind[points] == 0]):
            self._kind[code] = 1 if chr(code).isalpha() else 2
        # A blank closes every text, so that no n-gram reaches into the next.
        sizes = np.diff(np.concatenate(([0], ends)))
        padded = np.zeros(len(points) + len(sizes) + 1, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        inner = np.ones(len(owner), np.bool_)
        inner[np.cumsum(sizes + 1) - 1] = False
        body = padded[1:]
        body[inner] = np.where(self._kind[points] == 1, points, 0)
        keep = (body != 0) | (padded[:-1] != 0)
        body, owner = body[keep], owner[keep]
        if not (body != 0).any():
            return (np.zeros(0, np.int64),) * 3
        line = np.concatenate(([0], body))
        # line[i] is the letter before owner[i]'s own; an n-gram must lie in one text, with the blank before it.
        grams = line[:-2] << 42 | line[1:-1] << 21 | line[2:]
        who = owner[1:]
        same = (owner[:-1] == who) & (line[1:-1] + line[2:] != 0)
        grams, who = grams[same], who[same]
        used, at = np.unique(grams, return_inverse=True)
        pair = who * len(used) + at
        pair.sort()
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((first, [len(pair)])))
        return pair[first] // max(len(used), 1), used[pair[first] % max(len(used), 1)], n


class Space:
    """Random letter vectors of +1 and -1, bound into n-gram vectors by permutation and product."""

    def __init__(self, seed: int = 5):
        self._seed, self._letters, self._grams = seed, {}, {}

    def letter(self, code: int) -> np.ndarray:
        found = self._letters.get(code)
        if found is None:
            words = mix(np.arange(DIM // 64, dtype=np.uint64) + np.uint64(code) * np.uint64(DIM) + np.uint64(self._seed << 40))
            found = self._letters[code] = (np.unpackbits(mix(words).view(np.uint8)).astype(np.float32) * 2 - 1)
        return found

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vector of each packed n-gram: its letters, each rotated by its place, multiplied."""
        out = np.empty((len(grams), DIM), np.float32)
        for row, gram in enumerate(grams.tolist()):
            found = self._grams.get(gram)
            if found is None:
                parts = [self.letter(gram >> 21 * (GRAM - 1 - p) & 0x1FFFFF) for p in range(GRAM)]
                found = np.roll(parts[0], 2) * np.roll(parts[1], 1) * parts[2]
                if len(self._grams) >= 30_000:
                    self._grams.clear()
                self._grams[gram] = found.astype(np.int8)
            out[row] = found
        return out

    def bundle(self, owner: np.ndarray, gram: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        """Sum of the n-gram vectors of each text."""
        out = np.zeros((texts, DIM), np.float32)
        used, at = np.unique(gram, return_inverse=True)
        for start in range(0, len(used), 4096):
            part = (at >= start) & (at < start + 4096)
            counts = np.zeros((texts, min(4096, len(used) - start)), np.float32)
            counts[owner[part], at[part] - start] = n[part]
            out += counts @ self.vectors(used[start : start + 4096])
        return out


def _profiles(batch: pa.RecordBatch, letters: Letters, space: Space) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for start, stop, texts in blocks(batch, "text", 1 << 19):
        for at in range(0, stop - start, 256):
            to = min(at + 256, stop - start)
            own = Texts(texts.data[texts.starts[at] : texts.ends[to - 1]], texts.ends[at:to] - texts.starts[at])
            owner, gram, n = letters.ngrams(own)
            yield start + at, start + to, space.bundle(owner, gram, n, to - at), np.bincount(owner, minlength=to - at) > 0


def prototypes(docs: DataFrame, learn: Column) -> dict[str, np.ndarray]:
    """One bundled vector per language: sums, over the rows that ``learn`` admits, of text vectors of length 1.

    Tasks send a row per language and dimension, whatever they read; the driver sees languages x ``DIM`` sums.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, space, sums = Letters(), Space(), {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for start, stop, vectors, there in _profiles(batch, letters, space):
                norm = np.linalg.norm(vectors, axis=1)
                fine = there & (norm > 0)
                for lang in set(langs[start:stop][fine]):
                    own = fine & (langs[start:stop] == lang)
                    sums[lang] = sums.get(lang, 0) + (vectors[own] / norm[own, None]).astype(np.float64).sum(0)
        # Sums of integers don't depend on the order of the tasks.
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.rint(v * 1e6).astype(np.int64))], ["lang", "at", "v"])

    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.lower("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = rows.mapInArrow(add, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v")).toPandas()
    return {lang: part.sort_values("at")["v"].to_numpy(np.float64) for lang, part in sums.groupby("lang")}


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the prototype of largest cosine, and (1 + cosine) / 2.

    Null texts, texts without a letter, and all texts where nothing was learned are ``und`` with score 0. Ties
    go to the first language by name. Repeated rows keep their rows; extra columns are not read.
    """
    names = sorted(learned)
    matrix = np.array([learned[n] / max(np.linalg.norm(learned[n]), 1e-12) for n in names], np.float32).reshape(len(names), DIM)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, space = Letters(), Space()
        for batch in batches:
            for start, stop, vectors, there in _profiles(batch, letters, space):
                there = there & bool(names)
                cosine = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None] if names else np.zeros((stop - start, 1))
                best = cosine.argmax(1)
                pred = [names[b] if ok else "und" for b, ok in zip(best, there)]
                score = np.where(there, (1 + np.clip(cosine.max(1), -1, 1)) / 2, 0.0)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(pred), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (learn_fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.lower("text").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def classify(docs: DataFrame) -> DataFrame:
    """Prototypes from documents outside the held-out fold, and a prediction for every row."""
    return identify(docs, prototypes(docs, learn_fold(F.col("doc_id"), 4) != 2))
