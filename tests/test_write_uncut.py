"""Supersession and merges where more than five nearer rows don't fit."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemospark.operators import evolve, write
from mnemospark.plans import pipelines
from test_memory import NEW, OLD, episodic, write_event

NO_PITS = "id string, entity_id string, project_id string, obsoleted_at timestamp"


def vector(i):
    return [1.0, i / 1000, 0.0]


def test_merge_finds_its_target_behind_nearer_rows_of_others(spark):
    others = [(f"o{i}", dict(summary=f"{i}{i}{i}", context_vector=vector(i), entity_group="other")) for i in range(8)]
    memories = episodic(spark, [*others, ("z", dict(summary="pool exhausted", context_vector=vector(90))), ("y", dict(summary="pool gone", context_vector=vector(91), language="c"))])
    result = pipelines.write_batch(write_event(spark, [dict(summary="##", context_vector=vector(0), occurred_at=OLD)]), memories, spark.createDataFrame([], NO_PITS), NEW)
    assert [(r.memory_id, r.merge_action) for r in result.outcomes.collect()] == [("z", "updated_existing")]


def test_a_statement_supersedes_all_older_ones(spark):
    said = [(f"m{i}", dict(summary=f"The user prefers PostgreSQL {i}", context_vector=vector(i), entity_group="")) for i in range(9)]
    event = dict(summary="The user now prefers SQLite", context_vector=vector(0), entity_group="", occurred_at=NEW)
    pits = spark.createDataFrame([], NO_PITS)
    result = pipelines.write_batch(write_event(spark, [event]), episodic(spark, said), pits, NEW)
    assert result.edges.filter("edge_type = 'SUPERSEDED'").count() == 9
    assert result.memories.filter(F.col("obsoleted_at").isNotNull()).count() == 9
    # The same among new rows: distinct entities keep the older ones from merging.
    batch = [dict(summary=f"The user prefers PostgreSQL {i}", context_vector=vector(i), entity_group=f"e{i}", occurred_at=OLD) for i in range(9)]
    result = pipelines.write_batch(write_event(spark, [*batch, event]), episodic(spark, []), pits, NEW)
    assert result.edges.filter("edge_type = 'SUPERSEDED'").count() == 9


def test_a_new_row_joins_behind_superseded_rows(spark):
    rows = [dict(id=f"r{i}", seq=i, vector=vector(i)) for i in range(8)] + [dict(id="n", seq=9, vector=vector(8))]
    new = spark.createDataFrame([(r["id"], "p", "go", "e", r["seq"], 1.0, r["vector"]) for r in rows],
                                "id string, project_id string, language string, entity_group string, seq long, weight double, context_vector array<float>")
    gone = spark.createDataFrame([("c", f"r{i}", 8) for i in range(1, 8)], "new_id string, old_id string, new_seq long")
    got = {r.memory_id: r.id for r in write.batch_joins(new, gone).collect()}
    assert got["n"] == "r0"


def test_judge_equals_all_pairs(spark):
    texts = ["always log secrets at all", "never log secrets at all", "always log secrets", "log", "", "x", "The cache holds tens", "the cache held tens of keys", None]
    rows = [(f"{k}{i}", dict(summary=t, context_vector=vector(i), entity_group=("", "e", "f", None)[(i + k) % 4], occurred_at=OLD + timedelta(minutes=(7 * i + k) % 5),
                             obsoleted_at=datetime(2029, 5, 2) if (i + k) % 7 == 0 else None)) for i, t in enumerate(texts) for k in range(4)]
    m = episodic(spark, rows)
    ids = m.select(F.col("id").alias("new_id")).crossJoin(m.select(F.col("id").alias("old_id")))
    columns = ["new_id", "old_id", "similarity", "polarity_flip", "polarity_old", "polarity_new", "new_occurred_at", "old_occurred_at"]
    want = evolve.covered_pairs(evolve.update_pairs(m, m, ids)).select(*columns).collect()
    got = write.covered_found(write.judge(m, m, block_rows=7)).select(*columns).collect()
    assert len(want) > 20 and sorted(want) == sorted(got)


def _tasks(df, key):
    return len({r.task for r in df.select(key, F.spark_partition_id().alias("task")).collect()})


def test_counted_updates_are_those_of_the_pairs(spark):
    rows = [(f"m{i:02d}", dict(summary=f"never restart node {i % 5} while {i % 7} runs", context_vector=[1.0, 0.1 * i], occurred_at=OLD + timedelta(days=i))) for i in range(30)]
    m = episodic(spark, rows)
    pairs = write.covered_found(write.judge(m, m)).collect()
    want = {(i, c): sum((p.new_id if c else p.old_id) == i for p in pairs) for p in pairs for i, c in ((p.new_id, True), (p.old_id, False))}
    counts = write.covered_counts(m, m, block_rows=7)
    assert {(r.id, r.carrier): r.edges for r in counts.collect()} == want and len(want) > 10
    changed = evolve.applied_counts(counts, m.withColumn("weight", F.lit(0.5))).collect()
    assert {(r.id, r.weight) for r in changed} == {(i, 0.75 if c else 0.0) for i, c in want}


def test_edges_of_one_entity_are_the_work_of_several_tasks(spark):
    new = spark.range(60).select("id", F.lit("p").alias("project_id"), F.lit("debug").alias("task_type"), F.lit("e").alias("entity_group"))
    pits = spark.range(5).select("id", F.lit("p").alias("project_id"), F.lit("e").alias("entity_id"), F.lit(None).cast("timestamp").alias("obsoleted_at"))
    found = write.triggered_pitfalls(new, pits)
    assert found.distinct().count() == found.count() == 300 and _tasks(found, "edge_type") > 1


def test_updates_of_one_project_are_the_work_of_several_tasks(spark):
    texts = F.concat(F.lit("the cache of node "), F.col("id").cast("string"), F.lit(" holds "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24))
    memories = spark.range(80).select(
        "id", F.lit("p").alias("project_id"), texts.alias("summary"), F.lit("").alias("entity_group"), F.timestamp_seconds("id").alias("occurred_at"),
        F.timestamp_seconds("id").alias("created_at"), F.lit(None).cast("timestamp").alias("obsoleted_at"))
    found = evolve.explicit_updates(memories.filter("id = 79"), memories)
    text = {r.id: r.summary for r in memories.collect()}
    grams = {i: {s[k:k + 2] for k in range(len(s) - 1)} for i, s in text.items()}
    want = {i for i in range(79) if 8 * len(grams[i] & grams[79]) >= len(grams[i]) + len(grams[79]) > 20 / 9 * len(grams[i] & grams[79])}
    assert {r.old_id for r in found.collect()} == want and len(want) > 20 and _tasks(found, "new_id") > 1


def test_few_pairs_tell_what_all_pairs_tell(spark):
    rows = [(f"m{i:02d}", dict(summary=f"never restart node {i % 5} while {i % 7} runs", context_vector=[1.0, 0.1 * (i % 9)], occurred_at=OLD + timedelta(days=i), weight=i % 3 / 2))
            for i in range(40)]
    m = episodic(spark, rows).withColumn("seq", F.substring("id", 2, 2).cast("long"))
    for block_rows in (7, 8192):
        found = write.judge(m, m, earlier="seq", block_rows=block_rows).collect()
        few = write.judge(m, m, earlier="seq", block_rows=block_rows, settled=True).collect()
        pairs, kept = ([(r.new_id, r.old_id) for r in rs if r.covers] for rs in (found, few))
        assert set(kept) <= set(pairs) and len(kept) == len(set(kept)) and len(pairs) > 300
        for side in (0, 1):
            others = {p[side]: {q[1 - side] for q in pairs if q[side] == p[side]} for p in pairs}
            assert {p[side] for p in kept} == set(others)
            assert all(len({q[1 - side] for q in kept if q[side] == k}) >= min(2, len(v)) for k, v in others.items())
        first = {o: min(n for n, x in pairs if x == o) for _, o in pairs}
        assert {o: min(r.position for r in few if r.covers and r.old_id == o) for o in first} == {o: float(n[1:]) for o, n in first.items()}
        best = [sorted(map(tuple, write.merge_found(spark.createDataFrame([(r.new_id, r.old_id, r.covers, r.cosine, r.weight) for r in rs],
                "new_id string, old_id string, covers boolean, cosine double, weight double")).collect())) for rs in (found, few)]
        assert best[0] == best[1]
    # Before, every pair was stored.
    assert len(kept) <= 5 * 40 < len(pairs)


def test_a_batch_retires_and_boosts_what_its_edges_name(spark, monkeypatch):
    said = []
    monkeypatch.setattr(evolve, "update_effects", lambda pairs, *a, f=evolve.update_effects, **kw: said.append(pairs) or f(pairs, *a, **kw))
    told = [dict(summary=f"The user {'now ' * (i % 4 == 3)}prefers {'PostgreSQL SQLite Oracle MariaDB'.split()[i % 4]} {i % 3}", entity_group=("", "", "e", "f")[i % 4], seq=i,
                 context_vector=[1.0, (i % 6) / 3, (i % 5) / 4], occurred_at=OLD + timedelta(hours=i * 7 % 60)) for i in range(60)]
    memories = episodic(spark, [(f"m{i}", dict(summary=f"The user prefers SQL {i}", context_vector=[1.0, i / 9, 0.0], entity_group="" if i % 2 else "e")) for i in range(9)])
    pits = spark.createDataFrame([], NO_PITS)
    result = pipelines.write_batch(write_event(spark, told), memories, pits, NEW)
    edges = {(r.from_id, r.to_id) for r in result.edges.filter("edge_type = 'SUPERSEDED'").collect()}
    few = {(r.new_id, r.old_id) for r in said[0].collect()}
    assert few <= edges and all({p[k] for p in few} == {p[k] for p in edges} for k in (0, 1)) and len(edges) > 20
    rows = {r.id: r.obsoleted_at for r in result.memories.collect()}
    assert {i for i, at in rows.items() if at == NEW} == {b for _, b in edges}
    assert sorted(r.weight for r in result.outcomes.collect()) == sorted(
        r.weight for r in result.outcomes.drop("weight").join(result.memories.select(F.col("id").alias("memory_id"), "weight"), "memory_id").collect())


def test_weights_of_a_batch_move_no_texts(spark):
    memories = episodic(spark, [("m1", dict(summary="pool exhausted", context_vector=[1.0, 0.0, 0.0]))])
    events = write_event(spark, [dict(summary="pool exhausted once more", context_vector=[0.99, 0.05, 0.0])])
    result = pipelines.write_batch(events, memories, spark.createDataFrame([], NO_PITS), NEW)
    plan = result.outcomes._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("max_by" in line for line in plan) and not [line for line in plan if "summary" in line and "LogicalRDD" not in line]
