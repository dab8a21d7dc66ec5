"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, blocks, digest, durable, mix

SHINGLE = 5
#: Word document frequencies are counted in this many buckets: a fixed bound of what the driver sees.
DF_BITS = 18
#: A shingle key in 64 bits: text number in its block, shingle hash, quantised idf.
_HASH_BITS, _IDF_BITS, _IDF_STEP = 44, 8, 50.0
_BANDS, _ROWS = 16, 4
#: Buckets of more nodes than this are compared block against block, of at most about so many nodes and so much weight.
_PAIRWISE, _BLOCK_DOCS, _BLOCK_MASS = 16, 384, 4e6


def _key_parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner = (key >> np.uint64(_HASH_BITS + _IDF_BITS)).astype(np.int64)
    shingle = (key >> np.uint64(_IDF_BITS)) & np.uint64((1 << _HASH_BITS) - 1)
    return owner, shingle, (key & np.uint64((1 << _IDF_BITS) - 1)).astype(np.int64)


def shingle_keys(texts: Texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle keys of a block of texts and how often each occurs.

    A text of fewer than five words is one shingle; a text without words has none.
    """
    first, last, owner = texts.words()
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = texts.hashes(first, last)
    weight = idf[(words >> np.uint64(64 - DF_BITS)).astype(np.int64)]
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    sizes = np.diff(np.concatenate((begins, [len(owner)])))
    full = np.flatnonzero(owner[: max(len(owner) - SHINGLE + 1, 0)] == owner[SHINGLE - 1 :])
    at = np.concatenate((full, begins[sizes < SHINGLE]))
    length = np.concatenate((np.full(len(full), SHINGLE), sizes[sizes < SHINGLE]))
    code, total = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float32)
    for i in range(SHINGLE):
        there = i < length
        here = np.minimum(at + i, len(words) - 1)
        code = code * np.uint64(_FACTOR) + np.where(there, words[here], np.uint64(0))
        total += np.where(there, weight[here], np.float32(0))
    level = np.clip(np.rint(total / length * _IDF_STEP), 1, (1 << _IDF_BITS) - 1).astype(np.uint64)
    key = (owner[at].astype(np.uint64) << np.uint64(_HASH_BITS + _IDF_BITS)) | ((mix(code) >> np.uint64(64 - _HASH_BITS)) << np.uint64(_IDF_BITS)) | level
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[new], np.diff(np.concatenate((new, [len(key)])))


_FACTOR = 0xD6E8FEB86659FD93


def _tf(count: np.ndarray) -> np.ndarray:
    """Sublinear term frequency."""
    return 1 + np.log(np.maximum(count, 1))


class Sampler:
    """Consistent weighted samples with gamma and uniform variates read from seeded tables by shingle hash."""

    def __init__(self, samples: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        size = 1 << 16
        gamma = rng.gamma(2.0, 1.0, size)
        self.r, self.inverse = gamma.astype(np.float32), (1 / gamma).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.flip = rng.integers(0, 2**63, samples, np.uint64)
        self.odd = rng.integers(0, 2**63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers that have shingles, and a row of samples for each of them."""
        owner, shingle, level = _key_parts(key)
        log_w = np.log(_tf(count).astype(np.float32)) + np.log(level.astype(np.float32) / np.float32(_IDF_STEP))
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        sizes = np.diff(np.concatenate((begins, [len(owner)])))
        shingle = mix(shingle)
        out = np.empty((len(begins), len(self.odd)), np.uint64)
        for k in range(len(self.odd)):
            draw = ((shingle ^ self.flip[k]) * self.odd[k]).view(np.uint16).reshape(-1, 4)
            r_at = draw[:, 1].astype(np.intp)
            r, beta = self.r[r_at], self.beta[draw[:, 3]]
            t = np.floor(log_w * self.inverse[r_at] + beta)
            log_a = self.log_c[draw[:, 2]] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(log_a, begins)
            hits = np.flatnonzero(log_a == np.repeat(least, sizes))
            at = hits[np.searchsorted(hits, begins)]
            out[:, k] = mix(shingle[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(_FACTOR))
        return owner[begins], out


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of every bucket of word hashes, from the words of all texts: ln(1 + N / (df + N / 100)).

    Smoothing in parts of N makes weights alike at every corpus size, and words of under a hundredth of the
    texts nearly alike, so that a changed word doesn't count several times what a kept one does.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for _, _, texts in blocks(batch, "text"):
                first, last, owner = texts.words()
                if len(first):
                    bucket = texts.hashes(first, last) >> np.uint64(64 - DF_BITS)
                    each = np.unique((owner.astype(np.uint64) << np.uint64(DF_BITS)) | bucket)
                    seen += np.bincount((each & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
                    n += len(np.unique(owner))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], n))], ["bucket", "n"])

    sums = docs.select(F.lower("text").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << DF_BITS)
    inside = sums["bucket"] >= 0
    df[sums["bucket"][inside]] = sums["n"][inside]
    n = max(sums["n"][~inside].sum(), 1)
    return np.log1p(n / (np.maximum(df, 1) + n / 100)).astype(np.float32)


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, h1, h2, mass, bands): text identity, total weight and band hashes; null bands without words."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(_BANDS * _ROWS)
        for batch in batches:
            for start, stop, texts in blocks(batch, "text", 1 << 19):
                key, count = shingle_keys(texts, shared.value)
                bands, mass = np.zeros((stop - start, _BANDS), np.uint64), np.zeros(stop - start)
                if len(key):
                    who, samples = sampler.sample(key, count)
                    code = np.zeros((len(who), _BANDS), np.uint64)
                    for i in range(_ROWS):
                        code = mix(code * np.uint64(_FACTOR) + samples[:, i::_ROWS])
                    bands[who] = code
                    owner, _, level = _key_parts(key)
                    mass = np.bincount(owner, _tf(count) * level / _IDF_STEP, minlength=stop - start)
                part = batch.slice(start, stop - start)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), _BANDS).cast(pa.list_(pa.int64()))
                rows = pa.compute.if_else(pa.array(mass > 0), rows, pa.scalar(None, rows.type))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["h1"], part["h2"], pa.array(mass), rows], ["doc_id", "h1", "h2", "mass", "bands"])

    h1, h2 = digest(F.col("text"))
    source = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), h1.alias("h1"), h2.alias("h2"))
    return source.mapInArrow(sketch, "doc_id long, h1 long, h2 long, mass double, bands array<long>")


def similarities(pairs: DataFrame, docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b, similarity): exact weighted Jaccard similarity of the texts of each pair of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, left in blocks(batch, "text_a", 1 << 19):
                part, done = batch.slice(start, stop - start), 0
                for _, upto, right in blocks(part, "text_b", 1 << 21):
                    own = Texts(left.data[left.starts[done] : left.ends[upto - 1]], left.ends[done:upto] - left.starts[done])
                    key_a, n_a = shingle_keys(own, shared.value)
                    key_b, n_b = shingle_keys(right, shared.value)
                    size = upto - done
                    total = sum(_mass(k, n, size) for k, n in ((key_a, n_a), (key_b, n_b)))
                    both, at_a, at_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
                    common = _mass(both, np.minimum(n_a[at_a], n_b[at_b]), size)
                    out = part.slice(done, size)
                    yield pa.RecordBatch.from_arrays([out["a"], out["b"], pa.array(common / np.maximum(total - common, 1e-12))], ["a", "b", "similarity"])
                    done = upto

    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    with_a = pairs.join(texts, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("text_a"))
    with_b = with_a.join(texts, F.col("b") == F.col("id")).select("a", "b", "text_a", F.col("text").alias("text_b"))
    return with_b.mapInArrow(compare, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _mass(key: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    owner, _, level = _key_parts(key)
    return np.bincount(owner, _tf(count) * level / _IDF_STEP, minlength=size)


def _block_links(rest: DataFrame, docs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b) links across components inside buckets, found block against block.

    Nodes outside their bucket's main component meet all nodes of the bucket. Both sides are dealt into blocks
    of a bounded number and mass, a block pair is one task's product of shingle matrices, and every node sends on
    one link for each component it meets there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def items(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = [t.encode() for t in frame["text"]]
        texts = Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
        key, count = shingle_keys(texts, shared.value)
        owner, shingle, level = _key_parts(np.repeat(key, count))
        nth = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        weight = level / _IDF_STEP * np.where(nth > 0, _tf(nth + np.uint64(1)) - _tf(nth), 1.0)
        return owner, mix(shingle + nth * np.uint64(_FACTOR)), weight, np.bincount(owner, weight, minlength=len(frame))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, left = {"a": [], "b": []}, left.rename(columns=lambda c: c.removeprefix("x_"))
        if len(left) and len(right):
            own_l, item_l, weight_l, mass_l = items(left)
            own_r, item_r, _, mass_r = items(right)
            common = np.intersect1d(item_l, item_r)
            inner = np.zeros((len(left), len(right)), np.float32)
            at_l, at_r = (np.searchsorted(common, x) for x in (item_l, item_r))
            in_l = np.isin(item_l, common, assume_unique=False)
            in_r = np.isin(item_r, common, assume_unique=False)
            for start in range(0, len(common), 4096):
                a, b = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
                here = in_l & (at_l >= start) & (at_l < start + 4096)
                a[own_l[here], at_l[here] - start] = weight_l[here]
                here = in_r & (at_r >= start) & (at_r < start + 4096)
                b[own_r[here], at_r[here] - start] = 1
                inner += a @ b.T
            alike = inner / np.maximum(mass_l[:, None] + mass_r[None, :] - inner, 1e-12) >= threshold
            comp_l, comp_r = left["component"].to_numpy(), right["component"].to_numpy()
            alike &= comp_l[:, None] != comp_r[None, :]
            i, j = np.nonzero(alike)
            _, once = np.unique(np.stack((i, comp_r[j])), axis=1, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
            x, y = left["node"].to_numpy()[i[once]], right["node"].to_numpy()[j[once]]
            found = {"a": np.maximum(x, y), "b": np.minimum(x, y)}
        return pd.DataFrame(found).astype("int64")

    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    rows = rest.join(texts, F.col("node") == F.col("id")).filter(F.col("text").isNotNull())
    own, every = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    x = rows.filter("component != main").select("band", "value", "node", "component", "text", own.alias("left"), "cuts").withColumn("right", every).drop("cuts")
    y = rows.select("band", "value", "node", "component", "text", own.alias("right"), "cuts").withColumn("left", every).drop("cuts")
    x = x.select(*[F.col(c).alias(f"x_{c}") for c in x.columns])
    by = ["band", "value", "left", "right"]
    return x.groupBy(*[f"x_{c}" for c in by]).cogroup(y.groupBy(*by)).applyInPandas(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its least node.

    Alternating large and small stars over distributed edges; every round is checkpointed and the driver
    sees one row of it.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(moved.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of every row: documents linked by weighted Jaccard similarity >= ``threshold``.

    The class id is the least doc_id of the class. Weights are 1 + ln(tf) times the mean idf of a shingle's
    five words. (The document frequency of a shingle itself counts its copies and would push the larger groups
    of near copies under the threshold.)

    Equal texts are one node. In a band's bucket every node is compared with the bucket's least node
    only; what remains are pairs of different components so far, of which one lies outside the bucket's
    largest component. In buckets of up to ``_PAIRWISE`` nodes they are compared one by one, but for those
    whose similarities to the least node differ by more than 1 - ``threshold`` (the distance is a metric);
    in larger ones block against block. So no link among the candidates of the bands is lost, while a bucket
    of near copies costs a row each.

    Texts null or without words are classes by themselves, as are rows without doc_id (null class). Rows
    of one doc_id are one document; if their texts differ, any of them may link it. Extra columns are not
    read. An empty table gives an empty result.
    """
    idf = document_frequencies(docs)
    known = durable(sketches(docs, idf))
    nodes = durable(known.filter(F.col("bands").isNotNull()).groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("mass").alias("mass"), F.first("bands").alias("bands")))
    placed = nodes.select("node", "mass", F.posexplode("bands").alias("band", "value"))
    hubs = placed.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = durable(placed.join(hubs, ["band", "value"]).filter("node != hub"))

    to_hub = durable(similarities(members.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), docs, idf))
    links = to_hub.filter(F.col("similarity") >= threshold).select("a", "b")
    comps = components(links)

    slack = 1 - threshold + 1e-6
    judged = (
        members.join(to_hub, (members["node"] == to_hub["a"]) & (members["hub"] == to_hub["b"])).drop("a", "b", "hub")
        .join(comps.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
        .select("band", "value", "node", "mass", "similarity", F.coalesce("component", "node").alias("component"))
    )
    shares = judged.groupBy("band", "value", "component").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    mixed = shares.groupBy("band", "value").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"),
        F.ceil(F.greatest(F.sum("n") / _BLOCK_DOCS, F.sum("mass") / _BLOCK_MASS)).cast("int").alias("cuts"),
    ).filter("parts > 1").drop("parts")
    rest = durable(judged.join(mixed, ["band", "value"]))
    few = rest.filter(F.col("n") <= _PAIRWISE)
    x = few.filter("component != main").select("band", "value", *[F.col(c).alias(f"x_{c}") for c in ("node", "mass", "similarity", "component")])
    y = few.select("band", "value", *[F.col(c).alias(f"y_{c}") for c in ("node", "mass", "similarity", "component")])
    close = (
        (F.col("x_component") != F.col("y_component")) & (F.abs(F.col("x_similarity") - F.col("y_similarity")) <= slack)
        & (F.least("x_mass", "y_mass") >= (threshold - 1e-6) * F.greatest("x_mass", "y_mass"))
    )
    across = (
        x.join(y, ["band", "value"]).filter(close)
        .select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b")).distinct()
        .join(to_hub, ["a", "b"], "left_anti")
    )
    paired = similarities(across, docs, idf).filter(F.col("similarity") >= threshold).select("a", "b")
    more = durable(paired.unionByName(_block_links(rest.filter(F.col("n") > _PAIRWISE), docs, idf, threshold)))
    if not more.isEmpty():
        comps = components(links.unionByName(more))

    classes = nodes.select("h1", "h2", "node").join(comps.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left")
    classes = classes.select("h1", "h2", F.coalesce("component", "node").alias("class_id"))
    placed_docs = known.join(classes, ["h1", "h2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return placed_docs.unionByName(docs.filter(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, without the members of a class other than its least doc_id."""
    gone = near_duplicates(docs, threshold).filter("doc_id != class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti").select("row.*")
