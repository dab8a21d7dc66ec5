"""Whitening, exact search and source divergence against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import embedding_whitening as whitening
from mnemospark.llm import pivot_search as pivots
from mnemospark.llm import queries, source_divergence

ODD = [(900, None), (901, []), (902, [1.0, float("nan"), 0.0]), (903, [1.0, None, 2.0]), (904, [1.0, 2.0]), (905, [float("inf"), 1.0, 1.0])]
CLASHING = ("x", "q", "h", "ids", "first", "annulus", "piece", "pivot", "d", "rank", "score", "turn", "n", "component", "r")


def vectors(spark, x, extra=(), ids=None, parts=3):
    data = [(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x)] + list(extra)
    return spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(parts)


# whitening


@pytest.mark.parametrize("d, rank", [(12, 12), (7, 3), (1, 1), (2, 2)])
def test_factors_give_the_eigenvectors(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * rng.uniform(0.5, 4, rank)
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    components, values = whitening.one_sided_jacobi(factor)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, atol=1e-12 * np.abs(v).max())
    want, basis = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:rank], rtol=1e-10) and np.allclose(np.abs((components * basis.T[::-1][:rank]).sum(1)), 1, atol=1e-9)
    assert np.allclose(components @ components.T, np.eye(rank), atol=1e-13)


def brute_whitened(x, k):
    x = np.floor(1024 * np.asarray(x)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    basis *= np.sign(basis[np.abs(basis).argmax(0), np.arange(k)])
    return [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x], (x - s / n) @ basis / np.sqrt(values), values / np.trace(np.cov(x.T, bias=True))


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 10)) * np.arange(1, 11) @ rng.normal(size=(10, 10))
    x[40:90] = x[3]
    odd = [(i, v) for i, v in ODD]
    df = vectors(spark, x, odd).withColumns({c: F.lit("x") for c in CLASHING})
    deviation, want, share = brute_whitened(x, 8)
    got = whitening.whiten(df).collect()
    assert len(got) == 2400 and {r["n"] for r in got} == {300} and len({r["identity_error"] for r in got}) == 1
    for r in got:
        c = r["component"] - 1
        assert int(r["deviation"]) == deviation[r["vec_id"]] and abs(r["whitened"] - want[r["vec_id"], c]) < 1e-9 and abs(r["explained"] / share[c] - 1) < 1e-9
    assert got[0]["identity_error"] < 1e-9


def test_whitening_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(4).normal(size=(200, 6))
    one, many = (sorted(whitening.whiten(vectors(spark, x, parts=p)).collect()) for p in (1, 7))
    assert [(r["vec_id"], r["component"], r["deviation"], r["explained"]) for r in one] == [(r["vec_id"], r["component"], r["deviation"], r["explained"]) for r in many]
    assert max(abs(a["whitened"] - b["whitened"]) for a, b in zip(one, many)) < 1e-12


def test_whitening_edge_cases(spark):
    none = vectors(spark, np.zeros((0, 3)))
    assert whitening.whiten(none).count() == 0 and whitening.whiten(vectors(spark, np.ones((5, 3)))).count() == 0
    flat = np.random.default_rng(1).normal(size=(50, 3))
    flat[:, 2] = flat[:, 0]
    # Two equal dimensions leave two components; repeated rows and null ids come back one by one.
    got = whitening.whiten(vectors(spark, flat, [(None, [0.5, 0.5, 0.5]), (0, [float(c) for c in flat[0]])])).collect()
    assert Counter(r["component"] for r in got) == {1: 52, 2: 52} and got[0]["identity_error"] < 1e-9
    far = np.random.default_rng(1).normal(size=(40, 3)) * 1e9
    deviation, want, _ = brute_whitened(far, 3)
    for r in whitening.whiten(vectors(spark, far)).collect():
        assert int(r["deviation"]) == deviation[r["vec_id"]] and abs(r["whitened"] - want[r["vec_id"], r["component"] - 1]) < 1e-6


def test_whitening_query_columns(spark):
    got = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


# exact search


def brute_search(x, ids, asked, k):
    x = np.floor(1024 * np.asarray(x)).astype(np.int64)
    out = []
    for at in asked:
        scores = x @ x[at]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[at])[:k]
        out += [(int(ids[at]), r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "grouped", "common", "norms"])
def test_search_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(pivots, "RING", 60)
    monkeypatch.setattr(pivots, "BLOCK", 50)
    monkeypatch.setattr(pivots, "ASKED", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6))
    if kind == "grouped":
        x = x * 0.02 + rng.normal(size=(12, 6))[rng.integers(0, 12, 1500)]
    if kind == "common":
        x[rng.random(1500) < 0.4] = x[0]
        x[7] = x[200] = 0.0
    if kind == "norms":
        x *= rng.lognormal(0, 2, 1500)[:, None]
    df = vectors(spark, x, ODD + [(None, [1.0] * 6)]).withColumns({c: F.lit("x") for c in CLASHING})
    got = pivots.search(df, df.filter("vec_id % 50 = 0"), 5, first=100).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_search(x, np.arange(1500), range(0, 1500, 50), 5)


def test_bounds_exclude_annuli_of_grouped_vectors():
    """The triangle inequality does exclude: a query inside a tight group needs none of the far annuli."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 4)) * 0.01 + np.repeat(rng.normal(size=(4, 4)) * 5, 100, 0)) * 1000
    x = x.astype(np.int64)
    radius = float(np.sqrt((x * x).sum(1).max()))
    lift = pivots.lifted(x, radius)
    assert np.allclose((lift * lift).sum(1), radius**2)
    points = pivots.spread_points(lift, 4)
    d = pivots.distances(lift, points)
    own = d.argmin(1)
    low, high = (np.array([f(d[own == p, p]) for p in range(4)]) for f in (np.min, np.max))
    annuli = pivots.Annuli(points, np.arange(4), low, high, np.bincount(own, minlength=4), radius)
    q, stretch = pivots.turned(x, radius)
    bounds = pivots.lower_bounds(q, annuli)
    true = pivots.distances(q, lift)
    assert all((true[:, own == p].min(1) >= bounds[:, p] - 1e-3 * radius).all() for p in range(4))
    tenth = np.sort(true, 1)[:, 9]
    assert (bounds > tenth[:, None] + 1e-3 * radius).any()


def test_search_edge_cases(spark):
    none = vectors(spark, np.zeros((0, 3)))
    some = vectors(spark, np.arange(12).reshape(4, 3))
    assert pivots.search(none, none).count() == 0 and pivots.search(some, none).count() == 0 and pivots.search(vectors(spark, [[1, 2, 3]]), some).count() == 3
    assert pivots.search(vectors(spark, [[1.0, 2.0]]), vectors(spark, [[1.0, 2.0]])).count() == 0
    got = pivots.search(some, some, 10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_search(np.arange(12).reshape(4, 3), np.arange(4), range(4), 10)
    # Equal id and vector count once; equal ids with two vectors are two entries, and no candidates of each other.
    twice = vectors(spark, [[1, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], ids=[1, 1, 1, 2])
    got = sorted((r["query_id"], r["vec_id"], r["score"]) for r in pivots.search(twice, twice, 10).collect())
    one = 1024 * 1024
    assert got == [(1, 2, one), (1, 2, one), (2, 1, one), (2, 1, one)]
    wide = np.array([[1e5, 3e4], [-2e5, 5e4], [7e4, 0.0], [1e5, 3e4 + 0.001]])
    got = pivots.search(vectors(spark, wide), vectors(spark, wide), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_search(wide, np.arange(4), range(4), 2)


# source divergence


def brute_audit(rows, min_docs, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [t.translate(lower) for t in term.findall(text)]
        docs[lang].update(set(found))
        count[lang, source].update(found)
        count[lang, source] += Counter()
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted({s for _, a, s in rows if a == lang})
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(far)]
            over = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(over)]
    return sorted(out)


def audited(spark, rows, min_docs, top, parts=5):
    df = spark.createDataFrame([(i, *r, "a", "b", "c") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, chunk string, block string, term string")
    got = source_divergence.audit(df.repartition(parts), min_docs, top).collect()
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got)


@pytest.mark.parametrize("flush, sent, together, narrow", [(200, 0, 1, 12), (1 << 24, 1_000_000, 64, 12), (1 << 24, 1_000_000, 64, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, flush, sent, together, narrow):
    for name, value in (("FLUSH", flush), ("SENT", sent), ("_TOGETHER", together), ("_NARROW", (narrow, 16, 4))):
        monkeypatch.setattr(source_divergence, name, value)
    rng = random.Random(9)
    pool = ["The", "the", "THE,", "the.", "cat-cat", "dog's", "x1y", "straße", "ÉTÉ", "été", "中文", "a b", "123", "!!", "go\x00go", "(one)", "two/Two/TWO", " wide"]
    rows = [(" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))).replace("one) ", "one)\n\t"), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None])) for _ in range(120)]
    rows += [(None, "en", "s1"), ("", "en", "empty"), ("only here", "xx", "lonely"), (None, None, None), ("word " * 30_000 + "t" * 100_000, "de", "s1"), rows[0], rows[0]]
    assert audited(spark, rows, 5, 4) == brute_audit(rows, 5, 4)


def test_postings_split_large_counts():
    rows = pa.RecordBatch.from_pydict({"text": ["a " * 40 + "b", "", "a a\tc"], "gid": [4, 4, 9]})
    got = {r["chunk"]: [(e >> 20, e >> 4 & 0xFFFF, e & 15) for e in r["entries"]] for b in source_divergence._postings([rows], 6, source_divergence.layout(9)) for r in b.to_pylist()}
    assert got == {"a": [(4, 0, 15), (4, 0, 15), (4, 0, 10), (9, 2, 2)], "b": [(4, 0, 1)], "c": [(9, 2, 1)]}


def test_audit_edge_cases(spark):
    assert audited(spark, [("a", "en", "s")], 1, 50) == []  # one term, one source: nothing lies over the lang
    assert audited(spark, [("a b", "en", "s1"), ("", "en", "s2")], 9, 50) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert source_divergence.audit(empty).count() == 0
