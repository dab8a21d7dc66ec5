"""Quality classifier: random Fourier features, ridge scores from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, blocks, durable, learn_fold, mix

STATISTICS = (
    "log_words", "log_chars", "word_length", "upper", "digit", "symbol", "mark", "other_ascii", "non_ascii", "log_lines", "words_a_line",
    "distinct_words", "repeat_next", "repeat_windows", "duplicate_lines", "edge_symbols", "capital_words", "long_words", "top_word",
)
#: Random features, and equal steps of the raw score whose label counts are all that calibration sees.
FEATURES, STEPS = 256, 2000


def _kinds() -> np.ndarray:
    kind = np.full(256, 7, np.uint8)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?.,;:", b"abcdefghijklmnopqrstuvwxyz")):
        kind[list(chars)] = i
    kind[[9, 10, 11, 12, 13, 32]] = 5
    kind[128:] = 6
    return kind


_KIND = _kinds()


def _per(owner: np.ndarray, size: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weight, minlength=size).astype(np.float64)


def _repeated(owner: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many of its codes are not the first of their kind, and the most frequent code's count."""
    pair = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (code >> np.uint64(12)))
    new = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.bool_)
    at = np.flatnonzero(new)
    who = (pair[at] >> np.uint64(52)).astype(np.int64)
    n = np.diff(np.concatenate((at, [len(pair)])))
    most = np.zeros(size)
    np.maximum.at(most, who, n)
    return _per(who, size, n - 1), most


def statistics(texts: Texts) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a block; an empty text has zeros."""
    size = len(texts.ends)
    sizes = np.diff(np.concatenate(([0], texts.ends)))
    owner = np.repeat(np.arange(size), sizes)
    kind = _KIND[texts.data]
    each = np.bincount(owner * 8 + kind, minlength=size * 8).reshape(size, 8).astype(np.float64)
    chars = np.maximum(each.sum(1) - each[:, 5], 1)
    first, last, who = texts.words()
    n = _per(who, size)
    words = np.maximum(n, 1)
    code = texts.hashes(first, last)
    length = (last - first).astype(np.float64)
    begins = _KIND[texts.data[first]]
    finish = _KIND[texts.data[last - 1]]
    again, top = _repeated(who, code, size)
    same = (who[1:] == who[:-1]) & (code[1:] == code[:-1])
    inside = who[2:] == who[:-2]
    windows = mix(code[:-2] * np.uint64(0xD6E8FEB86659FD93) + mix(code[1:-1] + np.uint64(1)) * np.uint64(3) + code[2:])[inside]
    window_again, _ = _repeated(who[2:][inside], windows, size)
    breaks = np.flatnonzero(texts.data == 10)
    line_first = np.sort(np.concatenate((texts.starts[sizes > 0], breaks + 1)))
    line_first = np.unique(line_first[line_first < len(texts.data)])
    line_owner = np.searchsorted(texts.ends, line_first, "right")
    line_last = np.minimum(np.append(line_first[1:], len(texts.data)), texts.ends[line_owner])
    line_last = np.maximum(line_last - (texts.data[line_last - 1] == 10), line_first)
    lines = np.maximum(_per(line_owner, size), 1)
    line_again, _ = _repeated(line_owner, texts.hashes(line_first, line_last), size)
    columns = (
        np.log1p(n), np.log1p(chars - (n == 0)), _per(who, size, length) / words, each[:, 0] / chars, each[:, 1] / chars, each[:, 2] / chars,
        each[:, 3] / chars, each[:, 7] / chars, each[:, 6] / chars, np.log1p(lines - (sizes == 0)), np.log1p(n / lines), 1 - again / words,
        _per(who[1:][same], size) / words, window_again / words, line_again / lines, _per(who[finish == 2], size) / words,
        _per(who[begins == 0], size) / words, _per(who[length > 20], size) / words, top / words,
    )
    return np.stack(columns, 1) * (n > 0)[:, None]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in blocks(batch, "text", 1 << 19):
                x = statistics(texts)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(start, stop - start), rows], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Standardised statistics, random Fourier features, ridge weights and calibration knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 1, width: float = 4.0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.omega = rng.normal(0, 1 / width, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + len(mean) + 1)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(omega z + phase), whose products approximate a Gaussian kernel, beside z itself and 1."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(z @ self.omega + self.phase), z / len(self.mean), np.ones((len(z), 1))), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over ``rows`` (x, y): each task adds up its own, and rows of the matrix are summed by number."""
    size = len(model.weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            f = model.features(_matrix(batch["x"]))
            total += f.T @ np.concatenate((f, batch["y"].to_numpy()[:, None].astype(np.float64)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size), size + 1)), pa.array(np.tile(np.arange(size + 1), size)), pa.array(total.ravel())], ["i", "j", "v"])

    sums = rows.select("x", "y").mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((size, size + 1))
    total[sums["i"], sums["j"]] = sums["v"]
    return total[:, :-1], total[:, -1]


def isotonic(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Non-decreasing rates that fit positives / totals best (pool adjacent violators)."""
    pools: list[list[float]] = []
    for p, n in zip(positives, totals):
        pools.append([p, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p2, n2, w2 = pools.pop()
            pools[-1] = [pools[-1][0] + p2, pools[-1][1] + n2, pools[-1][2] + w2]
    return np.concatenate([np.full(int(w), p / n) for p, n, w in pools])


def fit(rows: DataFrame, ridge: float = 1e-3) -> Model:
    """A model from all labelled ``rows`` (fold, x, y).

    Mean and scale, normal equations and calibration counts are sums of fixed size, so every labelled row
    counts and the driver sees no row. Calibration uses scores of a model that never saw the row (two folds),
    counted in ``STEPS`` equal steps; between the pools' centres the score is linear, so it keeps its order.
    Without labels of both kinds every score is the rate there is, or 0.5.
    """
    n_x = len(STATISTICS)
    sums = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n_x)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n_x)], F.count("*").alias("n"), F.sum("y").alias("p")).first()
    model = Model(np.array([sums[f"m{i}"] or 0.0 for i in range(n_x)]), np.array([max(sums[f"s{i}"] or 0.0, 1e-3) for i in range(n_x)]))
    n, p = sums["n"], sums["p"] or 0
    if p in (0, n):
        model.values = np.full(2, p / n if n else 0.5)
        return model
    parts = [_normal_equations(rows.filter(F.col("fold") == f), model) for f in (0, 1)]

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a + ridge * max(a[-1, -1], 1.0) * np.eye(len(a)) * (np.arange(len(a)) < len(a) - 1)[:, None] + 1e-9 * np.eye(len(a)), b)

    halves = [solve(*part) for part in parts]

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = model.features(_matrix(batch["x"]))
            other = np.stack([f @ halves[1], f @ halves[0]], 1)
            score = np.clip(other[np.arange(len(f)), batch["fold"].to_numpy()], -0.5, 1.5)
            step = np.minimum((score + 0.5) / 2 * STEPS, STEPS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(batch["y"].to_numpy().astype(np.int64))], ["step", "y"])

    counts = rows.select("x", "y", "fold").mapInArrow(raw, "step int, y long").groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("p")).toPandas().sort_values("step")
    model.weights = solve(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1])
    centers = (counts["step"].to_numpy() + 0.5) / STEPS * 2 - 0.5
    rate = isotonic(counts["p"].to_numpy(float), counts["n"].to_numpy(float))
    weight = counts["n"].to_numpy(float)
    edges = np.flatnonzero(np.concatenate(([True], rate[1:] != rate[:-1])))
    at = np.add.reduceat(centers * weight, edges) / np.add.reduceat(weight, edges)
    model.knots = np.concatenate(([-0.5], at, [1.5]))
    model.values = np.concatenate(([0.0], np.clip(rate[edges], 0.002, 0.998), [1.0]))
    return model


def classify(docs: DataFrame, labels: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Learned from the labels of documents outside the held-out fold. A score depends on the text alone; null
    and empty texts have zero statistics and a score like any other. Labels that are null are left out; if an id
    is labelled twice the larger label counts. Repeated rows keep their rows; extra columns are not read.
    """
    rows = durable(measured(docs))
    fold = learn_fold(F.col("doc_id"), 3)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    learn = durable(rows.filter(fold != 1).join(known, "doc_id").select("x", "y", F.when(fold == 0, 0).otherwise(1).alias("fold")))
    model = fit(learn, ridge)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch["x"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", (fold == 1).alias("held_out"), "x").mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")
