"""The gate in batch (chunked) and as a stream against one sequential pass."""

import random

from pyspark.sql import functions as F

from mnemospark.operators import gate
from mnemospark.streaming import gate_stream as stream

SCHEMA = ("event_id string, project_id string, seq long, summary string, user_confirmed boolean, is_correction boolean, "
          "caused_behavior_change boolean, subsequent_reference_count int, reset boolean")


def events(n, seed=0, hot=0.8):
    rng = random.Random(seed)
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotel"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=3) + [f"unique{rng.randint(0, 400)}", f"other{rng.randint(0, 400)}"])
        rows.append((f"e{i}", "hot" if rng.random() < hot else f"p{rng.randint(0, 4)}", i, text, rng.random() < .05, rng.random() < .08,
                     rng.random() < .03, rng.choice([0, 0, 0, 1, 2]), rng.random() < .01))
    return rows


def sequential(rows, min_cycles=2):
    import re

    def tok(s):
        return [t.lower() for t in re.findall("[A-Za-z0-9]{4,}", s)]

    def same(a, b):
        hits = sum(t in set(a) for t in b)
        return bool(a and b) and (hits >= 3 or hits / min(len(a), len(b)) > 0.3)

    rings, out = {}, {}
    for eid, project, _, text, confirmed, corr, behaviour, refs, reset in sorted(rows, key=lambda r: r[2]):
        ring = rings.setdefault(project, [])
        if reset:
            ring.clear()
        cycles = sum(same(tok(text), t) for t in ring)
        reason = ("user_confirmed" if confirmed else "cross_cycle_persistence" if cycles >= min_cycles else
                  "prediction_error" if corr or behaviour else "subsequent_reference" if refs >= 2 else "below_threshold")
        out[eid] = reason
        if reason != "below_threshold":
            ring.append(tok(text))
            del ring[:-20]
    return out


def test_chunked_fold_equals_sequential(spark):
    rows = events(900)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.event_id: r.gate_reason for r in gate.gate_decisions(df, min_cycles=3, chunks=9).collect()}
    want = sequential(rows, 3)
    assert got == want and len(set(want.values())) == 5


def test_few_rounds_where_hardly_anything_passes(spark, caplog):
    """One project, every 40th event passes by itself, so a ring reaches over many chunks; resets lie between."""
    rng = random.Random(6)
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]
    rows = [(f"e{i}", "hot", 10**15 + 977 * i, " ".join(rng.choices(words, k=3) + [f"unique{i}", f"other{i}", f"third{i}", f"fourth{i}", f"fifth{i}", f"sixth{i}"]),
             i % 40 == 0, False, False, 0, i in (500, 501)) for i in range(1200)]
    with caplog.at_level("INFO", logger="mnemospark.operators.gate"):
        got = {r.event_id: r.gate_reason for r in gate.gate_decisions(spark.createDataFrame(rows, SCHEMA), min_cycles=4, chunks=30).collect()}
    want = sequential(rows, 4)
    assert got == want and 30 < sum(v != "below_threshold" for v in want.values()) < 400
    rounds = sum("gate round" in r.message for r in caplog.records)
    assert 2 <= rounds <= 7  # log2 of 30 chunks, and two


def test_literal_decisions(spark):
    def row(i, text, confirmed=False, refs=0):
        return (f"e{i}", "p", i, text, confirmed, False, False, refs, False)

    rows = [row(0, "redis timeout pool exhausted", True), row(1, "redis timeout pool again"), row(2, "something else entirely", refs=3),
            row(3, "redis timeout pool later", True), row(4, "redis timeout pool finally")]
    got = {r.event_id: r.gate_reason for r in gate.gate_decisions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"e0": "user_confirmed", "e1": "below_threshold", "e2": "subsequent_reference", "e3": "user_confirmed",
                   "e4": "cross_cycle_persistence"}


def test_vectors_decide_where_present(spark):
    base = spark.createDataFrame([("a", "p", 0, "甲", True, False, False, 0, False), ("b", "p", 1, "乙", True, False, False, 0, False),
                                  ("c", "p", 2, "丙", False, False, False, 0, False)], SCHEMA)
    near = base.withColumn("context_vector", F.array(F.lit(1.0), F.col("seq") / 10).cast("array<float>"))
    got = {r.event_id: r.gate_reason for r in gate.gate_decisions(near).collect()}
    assert got["c"] == "cross_cycle_persistence"


def test_gate_off_persists_everything(spark):
    judged = gate.significance_gate(spark.createDataFrame(events(50), SCHEMA), mode="off")
    assert judged.filter("not should_persist").isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    rows = events(240, seed=4)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, 240, 80):  # three micro-batches in arrival order
        spark.createDataFrame(rows[i:i + 80], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = stream.gate_stream(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r.event_id: r.gate_reason for r in spark.read.parquet(out).collect()}
    assert got == sequential(rows)


def test_ingest_stream_drops_repeats(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "source_uri string, content_hash string, modified_at timestamp"
    for _ in range(2):
        spark.sql("select 'u' source_uri, 'h' content_hash, timestamp'2024-01-01' modified_at").write.mode("append").parquet(source)
        raw = spark.readStream.schema(schema).parquet(source)
        query = stream.ingest_stream(raw, "1 hour").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.read.parquet(out).count() == 1
