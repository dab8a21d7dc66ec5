"""Vector columns. Vectors are array<float>; arithmetic is in double."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from mnemospark import fixed_values as V


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))  # no-op casts vanish
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector in double at length 1 (a zero vector stays zero), so that cosine is
    one dot product per pair."""
    def scale(norm: Column) -> Column:
        return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))

    return F.element_at(F.transform(F.array(l2_norm(a)), scale), 1)


def has_magnitude(a: Column) -> Column:
    return a.isNotNull() & F.exists(a, lambda x: x != 0)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for a missing, empty, mismatched or zero vector."""
    na = l2_norm(a) if norm_a is None else norm_a
    nb = l2_norm(b) if norm_b is None else norm_b
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def choose_vector(semantic: Column, keyword: Column) -> Column:
    """Semantic vector when it carries a signal, else the keyword vector."""
    return F.when(has_magnitude(semantic), semantic).otherwise(keyword)


_FNV_OFFSET = 14695981039346656037
_FNV_PRIME = 1099511628211
_MASK = (1 << 64) - 1


def _fnv1a(data: bytes) -> int:
    h = _FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * _FNV_PRIME) & _MASK
    return h


def keyword_vector(text: Column, dim: int = V.EMBEDDING_DIM) -> Column:
    """Hashed character-bigram embedding, unit length, case kept.

    A batch is one array of code-point pairs; only pairs that the worker hasn't met are
    hashed, and all texts of a chunk are counted in one pass.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots: dict[int, tuple[int, int]] = {}

        def slot(pair: int) -> tuple[int, int]:
            found = slots.get(pair)
            if found is None:
                first, second = divmod(pair, 1 << 21)
                gram = (chr(first - 1) if first else "") + chr(second)
                sign = -1 if _fnv1a(("s" + gram).encode()) & 1 else 1
                if len(slots) > 2_000_000:
                    slots.clear()
                found = slots[pair] = (_fnv1a(gram.encode()) % dim, sign)
            return found

        def pairs(value: str | None) -> np.ndarray:
            code = np.frombuffer((value or "").encode("utf-32-le"), np.uint32).astype(np.int64)
            return code if len(code) < 2 else ((code[:-1] + 1) << 21) | code[1:]

        def chunk(values: pd.Series) -> list[np.ndarray]:
            each = [pairs(v) for v in values]
            owner = np.repeat(np.arange(len(each)), [len(p) for p in each])
            known, at = np.unique(np.concatenate(each), return_inverse=True)
            where, sign = np.array([slot(p) for p in known.tolist()], np.int64).reshape(-1, 2).T
            flat = np.bincount(owner * dim + where[at], weights=sign[at], minlength=len(each) * dim)
            vec = flat.reshape(len(each), dim).astype(np.float32)
            norm = np.sqrt(np.sum(vec.astype(np.float64) ** 2, axis=1, keepdims=True)).astype(np.float32)
            return list(np.divide(vec, norm, out=vec, where=norm > 0))

        for batch in batches:
            yield pd.Series([v for start in range(0, len(batch), 128) for v in chunk(batch.iloc[start:start + 128])], dtype=object)

    return embed(text)
