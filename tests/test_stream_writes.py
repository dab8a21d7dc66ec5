"""Commits of whole versions, exactly-once write streams, rolling consolidation and bounded dedup state."""

import json
import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import gate
from mnemospark.operators.ranking import durable
from mnemospark.plans import pipelines
from mnemospark.sources import commits
from mnemospark.streaming import gate_stream, sinks
from mnemospark.workload.distil_cases import letter_counts
from test_memory import OLD, episodic

EVENTS = ("event_id string, project_id string, seq long, language string, task_type string, entity_group string, summary string, context_vector array<float>, "
          "user_confirmed boolean, is_correction boolean, caused_behavior_change boolean, subsequent_reference_count int, surprise_score double, occurred_at timestamp")
NOW = datetime(2029, 6, 1)


def events(n, start=0):
    """Every third event is confirmed; some restate, some contradict, some repeat an earlier statement."""
    said = ["The cache of {} holds ten keys", "The cache of {} now holds twenty keys", "Always rotate logs of {}", "Never rotate logs of {}", "Deploy {} on fridays"]
    rows = []
    for i in range(start, start + n):
        k = i % 7
        rows.append((f"e{i}", f"p{i % 3}", i, "go", "debug" if i % 2 else "feature", f"svc{i % 2}", said[i % 5].format(f"svc{k}"), [1.0, k / 3, (i % 5) / 10], i % 3 == 0, i % 11 == 0, False, i % 4,
                     0.0, OLD + timedelta(minutes=i)))
    return rows


def plain(df):
    """Rows as text; means may differ in their last digit with the order of summation."""
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


def folders(root, table):
    return {str(p): p.stat().st_mtime_ns for p in Path(root, table).rglob("part-*")}


def test_upsert_rewrites_touched_projects_only(spark, tmp_path):
    root = str(tmp_path)
    rows = episodic(spark, [(f"m{i}", dict(project_id=("a", "b/c", "ü", "")[i % 4], summary=f"s{i}")) for i in range(12)])
    first = commits.publish(spark, root, commits.Commit(), replace={"episodic": rows})
    before = folders(root, "episodic")
    second = commits.upsert(spark, root, "episodic", episodic(spark, [("m1", dict(project_id="b/c", summary="new")), ("x", dict(project_id="d"))]))
    assert second.number == 2 and {k: v for k, v in folders(root, "episodic").items() if k in before} == before
    assert {p for p in first.tables["episodic"] if first.tables["episodic"][p] != second.tables["episodic"][p]} == {"b/c"}
    got = {r.id: (r.project_id, r.summary) for r in commits.read(spark, root, "episodic").collect()}
    assert len(got) == 13 and got["m1"] == ("b/c", "new") and got["m2"] == ("ü", "s2") and got["m3"] == ("", "s3")
    assert {r.id for r in commits.read(spark, root, "episodic", ["ü", ""]).collect()} == {"m2", "m6", "m10", "m3", "m7", "m11"}
    assert commits.read(spark, root, "episodic", commit=first).count() == 12 and commits.read(spark, root, "semantic").count() == 0


def test_of_two_writers_one_fails(spark, tmp_path):
    root = str(tmp_path)
    rows = episodic(spark, [("m", {})])
    base = commits.latest(spark, root)
    commits.publish(spark, root, base, replace={"episodic": rows})
    with pytest.raises(commits.CommitConflict):
        commits.publish(spark, root, base, replace={"episodic": rows.withColumn("summary", F.lit("lost"))})
    assert commits.read(spark, root, "episodic").first().summary == "s" and commits.latest(spark, root).number == 1
    with pytest.raises(ValueError):
        commits.publish(spark, root, commits.latest(spark, root), replace={"episodic": rows}, touched=["other"])
    # A commit is one finished file; a writer that dies before leaves nothing that readers see.
    Path(root, "_commits", ".draft-dead").write_text('{"tables": {')
    assert commits.latest(spark, root).number == 1 and json.loads(Path(root, "_commits", "000000000001.json").read_text())["batches"] == {}


def feed(spark, source, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)


def test_write_stream_equals_batches_and_skips_replays(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "root", "cp"))
    parts = [events(24), events(18, 24)]

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        sinks.write_stream(gate_stream.passed_events(stream), root, checkpoint, clock=lambda: NOW).awaitTermination(240)

    for part in parts:
        feed(spark, source, part)
        run()
    done = commits.latest(spark, root)
    assert done.number == 2 and done.batches == {"events": 1}

    # The last batch comes again: its files are still the stream's next offset, but the commit knows its number.
    last = max(Path(checkpoint, "commits").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    for p in (last, last.with_name(f".{last.name}.crc")):
        if p.exists():
            os.remove(p)
    run()
    assert commits.latest(spark, root).number == 2

    # The same gate and the same batches by hand.
    whole = spark.createDataFrame(sum(parts, []), EVENTS)
    reasons = gate.gate_decisions(whole).filter("gate_reason <> 'below_threshold'")
    memories, edges = episodic(spark, []), None
    for part in parts:
        passed = spark.createDataFrame(part, EVENTS).join(reasons, "event_id")
        result = pipelines.write_batch(passed, memories, commits.read(spark, root, "pitfall"), NOW)
        memories, edges = durable(result.memories), result.edges if edges is None else edges.unionByName(result.edges)
    got = commits.read(spark, root, "episodic")
    assert got.count() > 5 and plain(got) == plain(memories.select(*got.columns))
    assert plain(commits.read(spark, root, "edges")) == plain(edges)
    assert got.filter("obsoleted_at is not null").count() > 0


def test_a_batch_that_died_before_its_commit_comes_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = spark.createDataFrame(events(9), EVENTS)

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(commits, "_log", dies)
        with pytest.raises(OSError):
            sinks.apply_events(spark, root, rows, 0, clock=lambda: NOW, link=False)
    assert commits.read(spark, root, "episodic").count() == 0
    assert sinks.apply_events(spark, root, rows.unionByName(rows), 0, clock=lambda: NOW, link=False) and not sinks.apply_events(spark, root, rows, 0, clock=lambda: NOW, link=False)
    first = plain(commits.read(spark, root, "episodic"))
    assert len(first) > 2 and commits.latest(spark, root).batches == {"events": 0}


# rolling consolidation


def month(n=60):
    """Two days of memories in two projects."""
    kinds = ["debug", "debug", "feature"]
    return [(f"m{i}", dict(project_id=f"p{i % 2}", task_type=kinds[i % 3], entity_group=f"e{i % 2}", summary=f"pool {'exhausted' if i % 2 else 'empty'} on host {i % 4}",
                           created_at=OLD + timedelta(minutes=48 * i), occurred_at=OLD + timedelta(minutes=48 * i), weight=0.5 + i / 1000)) for i in range(n)]


def consolidated(spark, tmp_path, name, order):
    source, root, checkpoint = (str(tmp_path / name / n) for n in ("in", "root", "cp"))
    rows = month()
    commits.publish(spark, root, commits.Commit(), replace={"episodic": episodic(spark, rows)})
    for at in order:
        episodic(spark, [rows[i] for i in at]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(episodic(spark, []).schema).parquet(source)
        sinks.consolidation_stream(stream, root, checkpoint, late="2 days", embed=letter_counts, threshold=0.0).awaitTermination(240)
    return root


def test_rolling_consolidation_does_not_depend_on_arrival(spark, tmp_path):
    forward = [range(0, 30), range(30, 60)]
    mixed = [list(range(59, -1, -2)), list(range(0, 60, 2))]
    # A row far ahead moves the watermark past both days.
    late = [("z", dict(project_id="p9", created_at=OLD + timedelta(days=9), occurred_at=OLD + timedelta(days=9)))]
    seen = []
    for name, order in (("a", forward), ("b", mixed)):
        root = consolidated(spark, tmp_path, name, order)
        source = str(tmp_path / name / "in")
        episodic(spark, late).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(episodic(spark, []).schema).parquet(source)
        sinks.consolidation_stream(stream, root, str(tmp_path / name / "cp"), late="2 days", embed=letter_counts, threshold=0.0).awaitTermination(240)
        seen.append({t: plain(commits.read(spark, root, t)) for t in ("semantic", "pitfall", "edges", "consolidation_runs")})
    assert seen[0] == seen[1] and len(seen[0]["consolidation_runs"]) == 2

    want = {t: [] for t in seen[0]}
    for day in range(2):
        start = OLD + timedelta(days=day)
        rows = episodic(spark, [r for r in month() if start <= r[1]["created_at"] < start + timedelta(days=1)])
        done = pipelines.consolidate(rows, sinks.run_name("windows", start), start + timedelta(days=1), embed=letter_counts, threshold=0.0)
        for t, df in (("semantic", done.rules), ("pitfall", done.pitfalls), ("edges", done.edges), ("consolidation_runs", done.run)):
            want[t] += plain(df.select(*commits.read(spark, root, t).columns))
    assert {t: sorted(v) for t, v in want.items()} == seen[0]


def test_sums_single_out_projects(spark):
    rows = episodic(spark, [*[(f"a{i}", dict(project_id="a", task_type="review", entity_group=f"x{i}")) for i in range(3)],
                            *[(f"b{i}", dict(project_id="b", task_type="review")) for i in range(2)], *[(f"c{i}", dict(project_id="c")) for i in range(2)],
                            ("d", dict(project_id="d")), ("d2", dict(project_id="d", created_at=OLD + timedelta(days=1)))])
    got = sinks.worth_consolidating(sinks.window_sums(rows)).select("project_id").collect()
    assert sorted(r.project_id for r in got) == ["a", "c"]


# bounded dedup


def test_dedup_state_stays_level(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "source_uri string, content_hash string, modified_at timestamp"
    held = []
    for day in range(4):
        at = OLD + timedelta(days=day)
        rows = [(f"u{day}-{i % 50}", "h", at + timedelta(minutes=i)) for i in range(100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = gate_stream.ingest_stream(spark.readStream.schema(schema).parquet(source), "6 hours").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(out).count() == 200 and max(held) <= 100 and held[-1] <= held[0]
