"""Links of texts and vectors, block against block of packed rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import token_links, write

SCHEMA = "id long, project_id string, summary string, context_vector array<float>"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    words = [f"word{i:03d}" for i in range(60)]

    def row(ident):
        n = rng.choice([0, 1, 5, 30, 90])
        text = " ".join(rng.choice(words[:rng.choice([4, 20, 60])]) for _ in range(n)) + rng.choice(["", " éWORD001ß ab1", " WORD002,word002"])
        vector = rng.choice([None, None, [0.0, 0.0], [1.0, rng.random()], [rng.random(), -1.0], [1.0, rng.random(), 0.0]])
        return ident, rng.choice(["p", "p", "p", "q", None]), rng.choice([text, text, text, text, None]), vector

    return [row(i) for i in range(240)], [row(i) for i in range(120, 400)]


def _tokens(text):
    return T.token_kernel()(text)


def _brute(left, right):
    out = {}
    for a in left:
        for b in right:
            if a[1] is None or a[1] != b[1] or a[0] == b[0]:
                continue
            s, t = _tokens(a[2]), _tokens(b[2])
            if a[3] and b[3] and any(a[3]) and any(b[3]) and len(a[3]) == len(b[3]):
                x, y = (np.array(v, np.float32).astype(float) for v in (a[3], b[3]))
                strength, floor = round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), 0.7
            else:
                both = sum(w in set(t) for w in s)
                strength, floor = (both / (len(s) + len(t) - both) if s and t else 0.0), 0.15
            if strength >= floor:
                out[a[0], b[0]] = strength
    return out


@pytest.mark.parametrize("block_rows", [20480, 50])
def test_links_are_those_of_all_pairs(spark, rows, block_rows):
    left, right = (spark.createDataFrame(r, SCHEMA) for r in rows)
    memories = right.withColumns({"obsoleted_at": F.lit(None).cast("timestamp"), "weight": F.lit(1.0)})
    found = write.related_links(left, memories, block_rows=block_rows).collect()
    want = _brute(*rows)
    assert len(found) == len(want) > 1000 and {(r.from_id, r.to_id) for r in found} == set(want)
    assert all(abs(r.strength - want[r.from_id, r.to_id]) < 2e-9 for r in found)


@pytest.mark.parametrize("tile", [7, 64])
def test_links_of_small_tiles_are_whole(rows, tile, monkeypatch):
    """Frequent tokens in several products, rare ones in several steps."""
    monkeypatch.setattr(token_links._Tiles, "WIDTH", 8)
    monkeypatch.setattr(token_links._Tiles, "MOST", 50)
    monkeypatch.setattr(token_links, "DENSE", 0.05)
    sides = [[r for r in side if r[1] == "p"] for side in rows]
    packs = [[token_links.pack(np.array([r[0] for r in some]), [_tokens(r[2]) for r in some], [None if r[3] is None else np.array(r[3], np.float32) for r in some])
              for some in (side[:30], side[30:])] for side in sides]
    found = [(r.from_id, r.to_id, r.strength) for part in token_links.link_block(0.7, 0.15, tile)(*packs) for r in part.itertuples()]
    want = _brute(*sides)
    assert len(found) == len(want) and {(a, b) for a, b, _ in found} == set(want) and all(abs(s - want[a, b]) < 2e-9 for a, b, s in found)


def test_tokens_in_tasks_are_those_of_the_column(spark):
    texts = ["", "abc abcd ABCDE", "naïve İSTANBUL x1234y ＡＢＣＤ K123 a\tbcde\x00fghi", "don't stop-gap 12345 under_score", "再见 hello世界word", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r.t or [] for r in df.select(T.tokens(F.col("s")).alias("t")).collect()] == [[t.decode() for t in _tokens(t)] for t in texts]


def test_rows_travel_in_packs(spark, rows):
    """A row went out with a hash of 8 bytes for each token, and again for each 8192 rows of the other side."""
    rng = np.random.default_rng(2)
    tokens = [[f"word{i}".encode() for i in rng.zipf(1.3, 300) % 20000] for _ in range(400)]
    data = token_links.pack(np.arange(400), tokens, [None] * 400)
    assert len(data) < 400 * 300 * 8 / 4
    ids, row, code, times, size, vectors = token_links.unpack(data)
    assert list(ids) == list(range(400)) and set(size) == {300} and times.sum() == 400 * 300 and vectors == [None] * 400
    known = token_links.hashes(data)
    one = dict(zip(known[code[row == 7]], times[row == 7]))
    again = token_links.pack(np.arange(1), [tokens[7]], [None])
    _, _, c, t, _, _ = token_links.unpack(again)
    assert one == dict(zip(token_links.hashes(again)[c], t))
    left, right = (spark.createDataFrame(r, SCHEMA).withColumns({"obsoleted_at": F.lit(None).cast("timestamp"), "weight": F.lit(1.0)}) for r in rows)
    plan = write.related_links(left, right)._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("Exchange"):]
    assert "MapInPandas" in dealt and "Join" not in plan[:plan.index("MapInPandas")] and "regexp_extract_all" not in plan
