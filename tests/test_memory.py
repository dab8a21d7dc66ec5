"""Write path, supersession, conflicts, distillation, context and snapshots."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemospark import schemas
from mnemospark.operators import context, distil, evolve, pitfalls as P, risk, write
from mnemospark.plans import pipelines
from mnemospark.sources import snapshots

OLD, NEW = datetime(2029, 5, 1), datetime(2029, 5, 3)


def episodic(spark, rows):
    """Rows of (id, overrides) on an otherwise plain episodic record."""
    base = dict(project_id="p", language="go", task_type="debug", summary="s", source_type="LLM", trust_level=3, weight=0.5,
                effective_frequency=1.0, entity_group="e", context_vector=None, full_snapshot_uri=None, is_correction=False,
                surprise_score=0.0, created_at=OLD, last_accessed_at=None, obsoleted_at=None, occurred_at=OLD)
    return spark.createDataFrame([tuple({**base, "id": i, **kw}[f] for f in schemas.EPISODIC.names) for i, kw in rows], schemas.EPISODIC)


@pytest.mark.parametrize("old,new,entities,shift,want", [
    ("The user prefers PostgreSQL", "The user now prefers SQLite", ("", ""), 1, 1),
    ("The user prefers PostgreSQL", "The user now prefers SQLite", ("", ""), 0, 0),
    ("The user prefers PostgreSQL", "The user now prefers SQLite", ("", ""), -1, 0),
    ("Alice got a shell necklace in Hawaii", "Carol plans to adopt a beagle puppy", ("", ""), 1, 0),
    ("The user prefers PostgreSQL", "The user prefers PostgreSQL", ("", ""), 1, 0),
    ("alpha beta gamma", "alpha beta gamma delta", ("", ""), 1, 0),
    ("Redis MaxOpenConns 不要设为 100", "Redis MaxOpenConns 应该设为 100", ("", ""), 1, 1),
    ("The user prefers PostgreSQL", "The user now prefers SQLite", ("bob", "alice"), 1, 0),
    ("The user prefers PostgreSQL", "The user now prefers SQLite", ("alice", "alice"), 1, 1),
    ("The user prefers PostgreSQL", "The user now prefers SQLite", ("", "alice"), 1, 1)])
def test_supersession(spark, old, new, entities, shift, want):
    rows = [("o", dict(summary=old, entity_group=entities[0])), ("n", dict(summary=new, entity_group=entities[1], occurred_at=OLD + timedelta(days=shift)))]
    m = episodic(spark, rows)
    pairs = evolve.update_pairs(m, m, spark.createDataFrame([("n", "o")], "new_id string, old_id string"))
    assert evolve.covered_pairs(pairs).count() == want
    gone = snapshots.obsolete(m, m.filter("id = 'o'"), NEW)
    assert evolve.covered_pairs(evolve.update_pairs(gone, gone, pairs.select("new_id", "old_id"))).count() == 0


def test_conflicts_and_resolution(spark):
    rows = [("a", "Redis MaxOpenConns 应该设为 100", 3), ("b", "Redis MaxOpenConns 不要设为 100", 5), ("c", "Redis MaxOpenConns 应该设为 200", 5)]
    rules = spark.createDataFrame([(i, "p", "RULE", c, t, 1.0, "g", None) for i, c, t in rows],
                                  "id string, project_id string, type string, content string, trust_level int, weight double, entity_group string, obsoleted_at timestamp")
    found = evolve.resolve_by_trust(evolve.rule_conflicts(rules))
    got = {(r.rule_a, r.rule_b): (r.status, r.winner, r.loser) for r in found.collect()}
    assert got == {("a", "b"): ("auto_resolved", "b", "a"), ("b", "c"): ("pending", None, None)}
    records = evolve.conflict_records(found, NEW)
    assert evolve.untracked(found, records).count() == 1
    decisions = records.filter("status = 'pending'").select(F.col("id").alias("conflict_id"), F.lit("c").alias("winner_id"), F.lit("  ").alias("note"))
    done, rejected = evolve.resolve_manually(records, decisions, NEW)
    assert [(r.loser_id, r.reason) for r in done.collect()] == [("b", "manual adjudication")] and rejected.isEmpty()


def write_event(spark, rows):
    base = dict(project_id="p", language="go", task_type="debug", entity_group="e", is_correction=False, surprise_score=0.0, occurred_at=None)
    schema = ("event_id string, project_id string, seq long, language string, task_type string, entity_group string, summary string, "
              "context_vector array<float>, is_correction boolean, surprise_score double, occurred_at timestamp")
    return spark.createDataFrame([tuple({**base, "event_id": f"n{i}", "seq": i, **kw}[c.split()[0]] for c in schema.split(", ")) for i, kw in enumerate(rows)], schema)


def test_write_batch(spark):
    memories = episodic(spark, [("m1", dict(summary="pool exhausted", context_vector=[1.0, 0.0, 0.0])),
                                ("m2", dict(summary="The user prefers PostgreSQL", context_vector=[0.0, 1.0, 0.0], entity_group=""))])
    events = write_event(spark, [
        dict(summary="pool exhausted once more", context_vector=[0.99, 0.05, 0.0]),
        dict(summary="The user now prefers SQLite", context_vector=[0.0, 1.0, 0.1], entity_group="", occurred_at=NEW),
        dict(summary="unrelated topic alpha", context_vector=[0.0, 0.0, 1.0]),
        dict(summary="unrelated topic alpha repeated", context_vector=[0.0, 0.01, 1.0])])
    pits = spark.createDataFrame([("f", "e", "p", None)], "id string, entity_id string, project_id string, obsoleted_at timestamp")
    result = pipelines.write_batch(events, memories, pits, NEW)
    actions = {r.event_id: r.merge_action for r in result.outcomes.collect()}
    assert actions == {"n0": "updated_existing", "n1": "created_new", "n2": "created_new", "n3": "updated_existing"}
    rows = {r.id: r for r in result.memories.collect()}
    assert len(rows) == 4 and rows["m1"].summary == "pool exhausted\npool exhausted once more" and rows["m1"].weight == 1.0
    assert rows["m2"].obsoleted_at == NEW and any(r.summary == "unrelated topic alpha\nunrelated topic alpha repeated" for r in rows.values())
    kinds = {r.edge_type: r["count"] for r in result.edges.groupBy("edge_type").count().collect()}
    assert kinds["SUPERSEDED"] == 1 and kinds["TRIGGERED_PITFALL"] == 1
    again = pipelines.write_batch(events, memories, pits, NEW)
    assert sorted(r.id for r in again.memories.collect()) == sorted(rows)


def test_write_batch_follows_the_order_of_writing(spark):
    from math import cos, radians, sin

    turns = [dict(summary=f"topic {c} told at angle {a}", context_vector=[cos(radians(a)), sin(radians(a)), 0.0]) for c, a in zip("abcd", (0, 25, 50, 75))]
    says = [dict(summary="The user prefers PostgreSQL", entity_group="", context_vector=[0.0, 0.0, 1.0], occurred_at=datetime(2029, 5, 1)),
            dict(summary="The user now prefers SQLite", entity_group="", context_vector=[0.0, 0.1, 1.0], occurred_at=datetime(2029, 5, 3))]
    events = write_event(spark, [*turns, *says])
    pits = spark.createDataFrame([], "id string, entity_id string, project_id string, obsoleted_at timestamp")
    result = pipelines.write_batch(events, episodic(spark, []), pits, NEW)
    actions = {r.event_id: r.merge_action for r in result.outcomes.collect()}
    assert [actions[f"n{i}"] for i in range(6)] == ["created_new", "updated_existing", "created_new", "updated_existing", "created_new", "created_new"]
    rows = {r.summary: r for r in result.memories.collect()}
    assert len(rows) == 4 and rows["The user prefers PostgreSQL"].obsoleted_at == NEW and rows["The user now prefers SQLite"].obsoleted_at is None
    edge = result.edges.filter("edge_type = 'SUPERSEDED'").collect()
    assert [(e.from_id, e.to_id) for e in edge] == [(rows["The user now prefers SQLite"].id, rows["The user prefers PostgreSQL"].id)]


def test_write_batch_settles_a_hot_group_in_one_round(spark, monkeypatch):
    from mnemospark.operators import write

    rounds = []
    monkeypatch.setattr(write, "durable", lambda df, f=write.durable: rounds.append(1) or f(df))
    events = write_event(spark, [dict(summary=f"the same told {i} times", context_vector=[1.0, i / 1000, 0.0]) for i in range(60)])
    pits = spark.createDataFrame([], "id string, entity_id string, project_id string, obsoleted_at timestamp")
    result = pipelines.write_batch(events, episodic(spark, []), pits, NEW)
    assert {r["count"] for r in result.outcomes.groupBy("merge_action").count().collect()} == {1, 59}
    assert len(rounds) == 2


def brute_hac(items, floor):
    def dice(a, b):
        x, y = ({s[i:i + 2] for i in range(len(s) - 1)} for s in (a, b))
        return 2 * len(x & y) / (len(x) + len(y))

    clusters = [[i] for i in range(len(items))]
    while True:
        best, pick = 0.0, None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                sims = [dice(items[a], items[b]) for a in clusters[i] for b in clusters[j]]
                mean = round(sum(sims) / len(sims), 9)
                if mean > best:
                    best, pick = mean, (i, j)
        if pick is None or best < floor:
            return clusters
        clusters[pick[0]] += clusters.pop(pick[1])


def test_clusters_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["timeout", "redis", "pool", "lock", "yaml", "parse"], k=4)) for _ in range(24)]
    scan = episodic(spark, [(f"i{n:02d}", dict(summary=t)) for n, t in enumerate(texts)]).withColumn("scan_rank", F.substring("id", 2, 2).cast("int"))
    got = {}
    for r in distil.cluster_entities(distil.entity_groups(scan)).collect():
        got.setdefault(r.cluster, []).append((r.member, int(r.id[1:])))
    assert sorted([i for _, i in sorted(ms)] for ms in got.values()) == sorted(brute_hac(texts, 0.3))


def test_vectors_form_clusters_and_pitfalls(spark):
    rows = [(f"i{n}", dict(summary=f"feed push fails with code {n}", entity_group="clawfeed-push-v3.py", context_vector=[1.0, 0.1 * n])) for n in range(3)]
    scan = episodic(spark, rows).withColumn("scan_rank", F.substring("id", 2, 1).cast("int"))
    clusters = distil.cluster_entities(distil.entity_groups(scan)).join(scan.select("id", "summary", "language"), "id")
    pits = distil.heuristic_pitfalls(clusters, F.lit(NEW)).collect()
    assert len(pits) == 1 and pits[0].signature.startswith("clawfeed-push-v3.py: ") and pits[0].occurrence_count == 3


@pytest.mark.parametrize("counts,base,total", [((10, 2), "p0", 12), ((1, 8), "p1", 9), ((3, 3, 5), "p0", 11)])
def test_merge_pitfalls(spark, counts, base, total):
    rows = [(f"p{i}", "e", "p", i, "same", None, c, "fix" * (i + 1), NEW + timedelta(days=i), i == 1, [f"s{i}"], None) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "id string, entity_id string, project_id string, position int, signature string, signature_embedding array<float>, "
                               "occurrence_count int, fix_strategy string, last_occurred_at timestamp, was_user_corrected boolean, source_episodic_ids array<string>, obsoleted_at timestamp")
    got = distil.merge_pitfalls(df, distil.dedup_pitfalls(df)).collect()
    assert [(r.id, r.occurrence_count, r.was_user_corrected) for r in got] == [(base, total, True)]
    assert got[0].fix_strategy == "fix" * len(counts) and sorted(got[0].source_episodic_ids) == [f"s{i}" for i in range(len(counts))]
    assert got[0].last_occurred_at == NEW + timedelta(days=len(counts) - 1)


def test_responses(spark):
    texts = ['[{"signature":"a","confidence":0.6},{"signature":"b","confidence":0.9}]', '```json\n{"signature":"c","root_cause_category":"CONFIG"}\n```',
             'so: {"signature":"d","root_cause_category":"??"} end', "none", '[{"signature":"e","confidence":0.1}]']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, response string")
    got = [(r.signature, r.root_cause_category, r.confidence, r.parsed) for r in distil.parse_responses(df).orderBy("n").collect()]
    assert got == [("b", "UNKNOWN", 0.9, True), ("c", "CONFIG", 0.0, True), ("d", "UNKNOWN", 0.0, True), (None, "UNKNOWN", 0.0, False), ("e", "UNKNOWN", 0.5, True)]


EPISODE = "question_id string, rank int, id string, summary string, language string"
PITFALL = ("question_id string, rank int, id string, entity_id string, signature string, fix_strategy string, root_cause_category string, "
           "trust_level int, last_occurred_at timestamp")


def block(spark, texts, pits=(), **kw):
    eps = spark.createDataFrame([("q", i, f"e{i}", t, "") for i, t in enumerate(texts)], EPISODE)
    adv = spark.createDataFrame([("q", i, f"p{i}", e, s, "f", "CONFIG", 3, None) for i, (e, s) in enumerate(pits)], PITFALL)
    return context.context_blocks(eps, adv, **kw).first()


def test_block_without_suppression_keeps_copies(spark):
    texts, pits = ["pool ran dry", "pool ran dry", "the pool ran dry again"], [("e", "same"), ("e", "same")]
    whole = block(spark, texts, pits, max_tokens=0, duplicate_percent=1000)
    assert (whole.episodes_out, whole.pitfalls_out, whole.suppressed_episodes, whole.suppressed_pitfalls) == (3, 2, 0, 0)
    cut = block(spark, texts, pits, max_tokens=0)
    assert (cut.episodes_out, cut.pitfalls_out) == (1, 1)


def test_context_suppression(spark):
    r = block(spark, ["use max_tokens 8000 for thinking", "use max_tokens 8000 for thinking", "use max_tokens 8000 for thinking now",
                      "use max_tokens 8000 for text", "the cafeteria closes at six on fridays"], [("a", "same"), ("b", "same"), ("a", "same")])
    assert r.episode_ids == ["e0", "e3", "e4"] and r.pitfall_ids == ["p0", "p1"] and r.block.startswith("[memory context]\n- use max")
    assert (r.suppressed_episodes, r.suppressed_pitfalls, r.budget_hit) == (2, 1, False) and r.output_tokens < r.input_tokens


def test_context_budget(spark):
    texts = [c * 40 for c in "abcde"]
    one = block(spark, texts, [("e", "x"), ("f", "yyyyyyyy")], max_tokens=1)
    assert (one.episodes_out, one.pitfalls_out, one.budget_hit) == (1, 1, True)
    some = block(spark, texts, max_tokens=30)
    assert some.episodes_out == 2 and some.output_tokens <= 30
    assert block(spark, [], [("e", "x")]).block.startswith("[Risk advisory]")


def test_risk(spark):
    schema = "id string, status string, occurrence_count int, weight double, trust_level int, was_user_corrected boolean, last_occurred_at timestamp"
    cases = {"strong": ("confirmed", 5, 1.0, 5, False, NEW), "hidden": ("suppressed", 5, 1.0, 5, True, NEW), "weak": ("proposed", 1, 1.0, 5, True, NEW),
             "old": ("confirmed", 5, 1.0, 5, False, NEW - timedelta(days=180))}
    pits = spark.createDataFrame([(k, *v) for k, v in cases.items()], schema)
    matches = spark.createDataFrame([(k, k) for k in cases], "question_id string, id string")
    requests = matches.select("question_id", F.lit(0.5).alias("complexity"), F.lit(0).alias("files"))
    got = {r.question_id: r for r in risk.risk_scores(requests, risk.contributions(matches, pits, NEW)).collect()}
    assert got["strong"].risk_score > 0.6 and got["strong"].reason_codes == ["high_risk_pitfall", "recent_error"]
    assert got["hidden"].risk_score == got["weak"].risk_score == 0.0 and 0 < got["old"].risk_score < 0.3 and got["old"].reason_codes == []


def test_risk_by_project_weighs_each_pitfall_once(spark):
    pits = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id") % 2).alias("project_id"), F.lit("confirmed").alias("status"), F.lit(1).alias("occurrence_count"),
                                  F.lit(1.0).alias("weight"), F.lit(1).alias("trust_level"), (F.col("id") == 3).alias("was_user_corrected"), F.lit(NEW).alias("last_occurred_at"))
    asked = spark.range(1000).select(F.col("id").alias("question_id"), F.concat(F.lit("p"), F.col("id") % 3).alias("project_id"), F.lit(0.5).alias("complexity"), F.lit(0).alias("files"))
    shares = risk.contributions(pits.select("id", "project_id"), pits, NEW, key="project_id")
    each = risk.contributions(asked.join(pits.select("id", "project_id"), "project_id"), pits, NEW)

    def rounded(scores):
        return {(r.question_id, round(r.risk_score, 9), tuple(r.reason_codes)) for r in scores.collect()}

    assert shares.count() == 40 and rounded(risk.risk_scores(asked, shares, key="project_id")) == rounded(risk.risk_scores(asked, each))
    top = asked.join(risk.top_contributions(shares, key="project_id"), "project_id")
    assert {(r.question_id, r.id, r["rank"]) for r in top.collect()} == {(r.question_id, r.id, r["rank"]) for r in risk.top_contributions(each).collect()}


def test_feedback_and_pitfall_state(spark):
    targets = spark.createDataFrame([("m", "episodic", 0.9, 1.0)], "id string, kind string, weight double, frequency double")
    fb = spark.createDataFrame([("m", 1, "corrected"), ("m", 2, "ignored"), ("m", 3, "bogus")], "memory_id string, seq long, action string")
    r = write.apply_feedback(targets, fb).first()
    assert r.weight == pytest.approx(0.95) and r.frequency == pytest.approx(1.85) and write.invalid_feedback(fb).count() == 1
    pit = spark.createDataFrame([("f", 0.5, 0, 2, 0, "")], "id string, weight double, times_adopted int, protection_level int, times_suppressed int, status string")
    ev = spark.createDataFrame([("f", i, "recurred") for i in range(4)] + [("f", 9, "adopted")], "pitfall_id string, seq long, action string")
    r = P.apply_pitfall_feedback(pit, ev).first()
    assert (r.weight, r.times_adopted, r.protection_level) == (pytest.approx(0.8), 1, 3)
    r = P.set_status(pit.withColumn("updated_at", F.lit(NEW)), spark.createDataFrame([("f", 1, "suppressed")], "pitfall_id string, seq long, status string"), NEW).first()
    assert (r.status, r.times_suppressed, r.weight) == ("suppressed", 1, pytest.approx(0.4))


def test_reconsolidation(spark):
    m = episodic(spark, [("e1", dict(weight=0.8, trust_level=5)), ("e2", {})])
    edges = spark.createDataFrame([("r", "e1", "DERIVED_FROM"), ("r", "gone", "DERIVED_FROM"), ("e1", "r", "DERIVED_FROM")], "from_id string, to_id string, edge_type string")
    c = spark.createDataFrame([("c1", 1, "r", "semantic", "truth", True), ("c2", 2, "e2", "episodic", "x", True)],
                              "correction_id string, seq long, id string, kind string, corrected_to string, user_corrected boolean")
    reached = evolve.correction_sources(c, edges, m)
    rows = {r.id: r for r in evolve.reconsolidate(reached, m).collect()}
    assert rows["e1"].weight == pytest.approx(1.2) and rows["e1"].trust_level == 5 and rows["e1"].summary == "s\n[corrected] truth"
    assert rows["e2"].surprise_score == 0.7 and rows["e2"].trust_level == 4 and rows["e2"].summary == "s"
    result = {r.correction_id: (r.updated, r.skipped) for r in evolve.reconsolidation_result(reached, m).collect()}
    assert result == {"c1": (1, 1), "c2": (1, 0)}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    m = episodic(spark, [("a", {}), ("b", dict(project_id="x"))])
    assert snapshots.read(spark, root, "episodic").count() == 0 and snapshots.write(m, root, "episodic") == 1
    delta = episodic(spark, [("a", dict(summary="first", weight=0.1)), ("a", dict(summary="last", weight=0.2)), ("c", {})])
    assert snapshots.write(snapshots.upsert(snapshots.read(spark, root, "episodic"), delta, order=F.col("weight")), root, "episodic") == 2
    now = {r.id: r.summary for r in snapshots.read(spark, root, "episodic").collect()}
    assert now == {"a": "last", "b": "s", "c": "s"} and snapshots.read(spark, root, "episodic", 1).count() == 2
    kept, counts = snapshots.delete_project(m, ["x"])
    assert [r.id for r in kept.collect()] == ["a"] and counts.first().deleted == 1
    bad = m.withColumn("trust_level", F.when(F.col("id") == "a", 9).otherwise(3))
    valid, rejects = schemas.validate(bad, "episodic")
    assert valid.count() == 1 and rejects.first().reject_reason == "bad_trust_level"


def test_consolidation_run(spark):
    rows = [(f"i{n}", dict(summary=f"timeout in pool number {n}", created_at=NEW - timedelta(hours=n))) for n in range(4)]
    rows.append(("late", dict(created_at=NEW - timedelta(days=9))))
    done = pipelines.consolidate(episodic(spark, rows), "run", NEW)
    run = done.run.first()
    assert (run.episodics_scanned, run.rules_persisted, run.pitfalls_persisted) == (4, done.rules.count(), 1) and run.candidate_rules_found >= 2
    assert done.edges.filter("edge_type = 'DERIVED_FROM'").count() == 4 * (run.rules_persisted + 1)


def test_merged_pitfalls_keep_a_fix_the_base_lacks(spark):
    rows = [(f"p{i}", "e", "p", i, "same", None, c, fix, NEW, False, [f"s{i}"], None) for i, (c, fix) in enumerate([(4, None), (1, "longer fix"), (9, None), (2, "fix")])]
    df = spark.createDataFrame(rows, "id string, entity_id string, project_id string, position int, signature string, signature_embedding array<float>, "
                               "occurrence_count int, fix_strategy string, last_occurred_at timestamp, was_user_corrected boolean, source_episodic_ids array<string>, obsoleted_at timestamp")
    [r] = distil.merge_pitfalls(df, distil.dedup_pitfalls(df)).collect()
    assert (r.id, r.occurrence_count, r.fix_strategy, r.source_episodic_ids, r.merged_members) == ("p2", 16, "longer fix", ["s2", "s0", "s1", "s3"], 4)
