"""Rank fusion, neighbours and ordered helpers against brute force, with a hot project."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from mnemospark.functions import text as T
from mnemospark.operators import ranking, retrieve

MEMORY = ("id string, project_id string, summary string, context_vector array<float>, weight double, surprise_score double, "
          "occurred_at timestamp, obsoleted_at timestamp, created_at timestamp")
T0 = datetime(2024, 1, 1)


def memory(i, text, vec, weight=1.0, surprise=0.0, project="p", at=T0):
    return (i, project, text, vec and [float(x) for x in vec], weight, surprise, at, None, at)


def ask(spark, query, vec=(1.0, 0.0, 0.0), project="p"):
    return spark.createDataFrame([("q", project, query, list(vec))], "question_id string, project_id string, query string, query_vector array<float>")


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_fusion_rescues_exact_words(spark):
    rows = [memory("A", "banana theme unrelated", [1.0, 0, 0]), memory("B", "golden banana pendant", [0, 1.0, 0]),
            memory("X", "unrelated noise", [.9, .1, 0]), memory("Y", "more unrelated noise", [0, 0, 1.0]),
            memory("Z", "golden banana pendant", None, weight=0.1)]
    m = spark.createDataFrame(rows, MEMORY)
    q = ask(spark, "golden banana pendant")
    assert ids(retrieve.cosine_topk(q, m, 2)) == ["A", "X"]
    best = retrieve.rrf_topk(q, m, 5).orderBy("rank").collect()
    assert {best[0].id, best[1].id} == {"A", "B"} and "Z" in [r.id for r in best]


@pytest.mark.parametrize("k,first", [(1, "M"), (60, "N")])
def test_fusion_constant(spark, k, first):
    rows = [memory("M", "unrelated noise", [1.0, 0, 0]), memory("N", "target xyz", [.9, .1, 0])]
    rows += [memory(f"v{i:02d}", "target target target", None) for i in range(29)]
    got = ids(retrieve.rrf_topk(ask(spark, "target"), spark.createDataFrame(rows, MEMORY), 31, rrf_k=k))
    assert got.index(first) < got.index("N" if first == "M" else "M")


def brute_rrf(questions, memories, k, rrf_k, boost):
    def grams(s):
        s = s.lower()
        return {s[i:i + 2] for i in range(len(s) - 1)} if len(s) > 1 else set(s)

    out = {}
    for qid, project, query, vec in questions:
        pool = [m for m in memories if m[1] == project]
        sem, lex = [], []
        for m in pool:
            if m[3] is not None:
                na, nb = math.sqrt(sum(x * x for x in vec)), math.sqrt(sum(x * x for x in m[3]))
                sem.append((-round(sum(x * y for x, y in zip(vec, m[3])) / (na * nb), 9), -m[4], m[0]))
            a, b = grams(query), grams(m[2])
            d = round(2 * len(a & b) / (len(a) + len(b)), 9) if a and b else 0
            if d > 0:
                lex.append((-d, -m[4], m[0]))
        rank = [{t[2]: i + 1 for i, t in enumerate(sorted(c))} for c in (sem, lex)]
        fused = []
        for m in pool:
            s = sum(1 / (rrf_k + r[m[0]]) for r in rank if m[0] in r) * (1 + boost * m[5])
            if s:
                fused.append((-round(s, 12), -m[4], m[0]))
        out[qid] = [t[2] for t in sorted(fused)[:k]]
    return out


def test_fusion_equals_brute_force_with_hot_project(spark):
    """Most rows sit in one project, and a third of those are copies of one text."""
    rng = random.Random(5)
    words = ["red", "blue", "lock", "pool", "timeout", "cache", "retry", "index"]
    rows = []
    for i in range(900):
        text = "the same copied text" if i % 3 == 0 else " ".join(rng.choices(words, k=6))
        vec = None if i % 7 == 0 else [float(rng.randint(-3, 3)) + 0.5 for _ in range(4)]
        rows.append(memory(f"m{i:04d}", text, vec, rng.randint(1, 5) / 5, rng.randint(0, 4) / 4, "hot" if i % 10 else "cold"))
    questions = [(f"q{i}", "hot" if i % 2 else "cold", " ".join(rng.choices(words, k=4)), [float(rng.randint(-3, 3)) + 0.25 for _ in range(4)])
                 for i in range(8)]
    q = spark.createDataFrame(questions, "question_id string, project_id string, query string, query_vector array<float>")
    found = retrieve.rrf_topk(q, spark.createDataFrame(rows, MEMORY), 5, rrf_k=10, surprise_boost=0.25).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.question_id, []).append(r.id)
    assert got == brute_rrf(questions, rows, 5, 10, 0.25)


def test_neighbours_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    rows = [memory(f"m{i}", "", [float(rng.randint(-2, 2)) for _ in range(3)], rng.randint(1, 3) / 3, project="hot" if i % 3 else "p")
            for i in range(300)]
    m = spark.createDataFrame(rows, MEMORY)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ranking.nearest_neighbours(m, m, 4, block_rows=7)) == key(ranking.nearest_neighbours(m, m, 4))


def test_time_window_and_order(spark):
    rows = [memory(f"m{i}", "target word", [1.0, 0, 0], 1 - i / 10, at=T0 + timedelta(days=i)) for i in range(5)]
    m = spark.createDataFrame(rows, MEMORY)
    q = ask(spark, "target").withColumns({"occurred_after": F.lit(T0 + timedelta(days=1)), "occurred_before": F.lit(T0 + timedelta(days=3))})
    ranked = retrieve.newest_first(retrieve.rrf_topk(q, m, 5))
    assert [r.id for r in ranked.orderBy("display_rank").collect()] == ["m3", "m2", "m1"]


def test_clamped_sum_across_chunks(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "b", i, rng.choice([0.5, -0.7, 0.2])) for i in range(500)]
    want = {"hot": 0.4, "b": 1.7}
    for k, _, d in rows:
        want[k] = min(1.0, max(0.0, want[k] + d))
    df = ranking.clamped_sum(spark.createDataFrame(rows, "k string, seq long, d double"), "k", "seq", "d", chunk=5)
    start = {"hot": 0.4, "b": 1.7}
    for r in df.collect():
        assert max(r.floor, min(r.ceiling, start[r.k] + r["shift"])) == pytest.approx(want[r.k])


def test_ordinal_and_carry_forward(spark):
    rows = [("a" if i % 4 else "b", i, None if i % 5 else f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    last, count = {}, {}
    want = {}
    for k, i, v in rows:
        count[k] = count.get(k, 0) + 1
        want[i] = (count[k], last.get(k))
        last[k] = v or last.get(k)
    out = ranking.ordinal(ranking.carry_forward(df, ["k"], "seq", F.col("v"), "prev", chunk=7), ["k"], "seq", "n", chunk=9)
    assert {r.seq: (r.n, r.prev) for r in out.collect()} == want


def test_folds_over_sparse_microseconds(spark):
    """Sequence numbers far apart, one key with nine tenths of the rows: as one pass, and no chunk beyond its size."""
    rng = random.Random(5)
    seqs = rng.sample(range(1_700_000_000_000_000, 1_700_090_000_000_000), 3000)
    rows = [("cold" if i % 10 == 0 else "hot", s, rng.choice([0.5, -0.7, 0.2]), f"v{i}" if rng.random() < 0.05 else None) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "k string, seq long, d double, v string").repartition(6)
    weight, last, count, first, want = {"hot": 0.4, "cold": 1.7}, {}, {}, {}, {}
    for k, s, d, v in sorted(rows, key=lambda r: r[1]):
        weight[k] = min(1.0, max(0.0, weight[k] + d))
        count[k] = count.get(k, 0) + 1
        want[s] = (count[k], last.get(k), first.setdefault(k, s))
        last[k] = v or last.get(k)
    out = ranking.ordinal(ranking.carry_forward(df, ["k"], "seq", F.col("v"), "prev", chunk=64), ["k"], "seq", "n", chunk=50, first="start")
    assert {r.seq: (r.n, r.prev, r.start) for r in out.collect()} == want
    start = {"hot": 0.4, "cold": 1.7}
    for r in ranking.clamped_sum(df, "k", "seq", "d", chunk=16).collect():
        assert max(r.floor, min(r.ceiling, start[r.k] + r["shift"])) == pytest.approx(weight[r.k]) and r.events == count[r.k]
    placed = ranking.in_order(df, ["k"], "seq", 16)
    assert placed.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 16
    # The hot key lies in several partitions, and the order of places is that of the sequence.
    assert placed.filter("k = 'hot'").select(F.shiftright("_at", 33)).distinct().count() > 1
    assert [r.seq for r in placed.orderBy("_at").collect()] == [r[1] for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def test_folds_of_nothing(spark):
    df = spark.createDataFrame([], "k string, seq long, d double, v string")
    assert ranking.clamped_sum(df, "k", "seq", "d").count() == 0
    assert ranking.ordinal(ranking.carry_forward(df, ["k"], "seq", F.col("v"), "prev"), ["k"], "seq", "n").count() == 0


def bigrams(s):
    return {s[i:i + 2] for i in range(len(s) - 1)} or ({s} if s else set())


def test_overlap_topk_equals_all_pairs(spark):
    """Nine tenths of the rows in one project, small blocks, windows, names, ties, null and empty texts."""
    rng = random.Random(4)
    words = ["pool", "cache", "socket", "retry", "lease", "shard"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 4)))
    right = [(f"m{i:03d}", "hot" if i % 10 else "cold", None if i == 3 else "" if i == 4 else text(), rng.choice([None, "Pool", "lease-1", "x"]),
              None if i % 11 == 0 else T0 + timedelta(days=i % 7)) for i in range(150)]
    left = [(f"q{i}", "hot" if i % 3 else "cold", None if i == 5 else "" if i == 6 else text(), rng.choice([None, [], ["pool"], ["pool", "pool", "lease"]]),
             T0 + timedelta(days=2) if i % 2 else None, T0 + timedelta(days=4) if i % 4 == 0 else None) for i in range(20)]
    m = spark.createDataFrame(right, "id string, project_id string, s string, name string, at timestamp").withColumn("grams", T.char_bigrams(F.col("s")))
    q = spark.createDataFrame(left, "id string, project_id string, s string, refs array<string>, after timestamp, before timestamp").withColumn(
        "grams", T.char_bigrams(F.col("s")))
    for per_name in (0.0, 0.3):
        want = {}
        for ql, p, s, refs, after, before in left:
            scored = []
            for mr, rp, t, name, at in right:
                if p != rp or s is None or t is None or (after and not (at and at >= after)) or (before and not (at and at <= before)):
                    continue
                a, b = bigrams(s), bigrams(t)
                score = (2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0) + per_name * sum(r in (name or "").lower() for r in refs or [])
                if score > 0:
                    scored.append((-round(score, 9), mr, at))
            want |= {(ql, n): (mr, -x, at) for n, (x, mr, at) in enumerate(sorted(scored, key=lambda r: r[:2])[:6], 1)}
        got = {(r.left_id, r["rank"]): (r.right_id, r.score, r["at"]) for r in ranking.overlap_topk(q, m, 6, per_name=per_name, block_rows=8).collect()}
        assert got.keys() == want.keys() and len(got) > 80
        assert all(got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1], abs=2e-9) and got[key][2] == want[key][2] for key in want)
    assert ranking.overlap_topk(q, m.limit(0), 6).count() == ranking.overlap_topk(q.limit(0), m, 6).count() == 0


def test_capped_gate_and_heads_equal_all_pairs(spark):
    """The best of each question out of all gated pairs, and out of the ranked heads; weights tie often."""
    rng = random.Random(9)
    rows = [memory(f"m{i:03d}", "x", None, rng.choice([0.005, 0.3, 0.33, 0.36, 0.5, 0.55, 0.6])) for i in range(120)]
    m = spark.createDataFrame(rows, MEMORY).withColumn("language", F.element_at(F.array(*[F.lit(x) for x in ("go", "py", "", None)]), F.abs(F.xxhash64("id") % 4).cast("int") + 1))
    asked = [(f"q{t}{l}", "p", l, t) for t in ("debug", "other", None) for l in ("go", "py", "", None, "zz")]
    q = spark.createDataFrame(asked, "question_id string, project_id string, language string, task_type string")
    order = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("boosted"), "id"))
    full = retrieve.gated_pairs(q, m)
    for cap in (1, 7, 500):
        want = full.withColumn("rank", order).filter(F.col("rank") <= cap)
        cols = ["question_id", "id", "boosted", "rank"]
        assert sorted(retrieve.gate_and_rank(q, m, cap).select(cols).collect()) == sorted(want.select(cols).collect())
    heavy = Window.partitionBy("question_id").orderBy(F.desc("weight"), "id")
    fits = (F.col("context_language") == "") | (F.col("context_language") == F.col("language"))
    for hard in (False, True):
        pairs = full.filter(fits) if hard else full
        want = pairs.withColumn("r", F.row_number().over(heavy)).filter("r <= 9").select("question_id", "id", "weight")
        assert sorted(retrieve.heaviest(q, m, 9, hard).collect()) == sorted(want.collect()) and want.count() > 50


def test_percentiles(spark):
    rng = random.Random(2)
    data = {"a": [rng.random() for _ in range(333)], "b": [7.0] * 50, "c": [1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    for r in ranking.nearest_rank_percentiles(df, ["k"], "v", [0, 50, 95, 99, 100], buckets=16).collect():
        s = sorted(data[r.k])
        assert r.percentile == s[max(1, math.ceil(r.p / 100 * len(s))) - 1]


def test_mixed_search_branches(spark):
    m = spark.createDataFrame([memory("m", "x", None, 0.55)], MEMORY).withColumn("language", F.lit("go"))
    rules = spark.createDataFrame([("r1", "p", "always check connection limits", None), ("r2", "p", "nothing", None)],
                                  "id string, project_id string, content string, obsoleted_at timestamp")
    pits = spark.createDataFrame([("f1", "p", "e", True, 1, 0.2, None)], "id string, project_id string, entity_id string, "
                                 "was_user_corrected boolean, occurrence_count int, weight double, obsoleted_at timestamp")
    q = ask(spark, "check connection limits").withColumns({"language": F.lit(""), "task_type": F.lit("debug"), "entity_id": F.lit("e")})
    got = retrieve.mixed_search(q, m, rules, pits, 10).orderBy("rank").collect()
    assert [(r.kind, r.relevance) for r in got] == [("pitfall", 0.6), ("episodic", 0.55), ("semantic", 0.5)]


def test_overlaps_of_fusion_round_half_up():
    import numpy as np
    import pandas as pd

    none = {"vector": [None], "occurred_after": [np.nan], "occurred_before": [np.nan], "at": [np.nan]}
    left = pd.DataFrame({"l_grams": [np.arange(1024)], **{f"l_{k}": v for k, v in none.items()}})
    right = pd.DataFrame({"r_grams": [np.arange(1023, 2047)], **{f"r_{k}": v for k, v in none.items()}})
    assert retrieve._block_scores(left, right)[1][0, 0] == 0.000976563  # 2 / 2048 = 0.0009765625


def test_fusion_looks_at_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rows = [memory(f"m{i:03d}", f"note {i} on pools", (1.0, i / 100, 0.0)) for i in range(120)]
    m = spark.createDataFrame(rows, MEMORY).withColumn("summary", read("summary"))
    best = retrieve.rrf_topk(ask(spark, "note 7 on pools"), m, 5, rrf_k=1).collect()
    assert len(best) == 5 and seen.value == 120
