"""Every former budget of rows or characters at a size at which it would have bitten."""

from datetime import datetime

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import distil, evolve, pitfalls as P, retrieve as R, write

START = datetime(2029, 5, 1)


def memories(spark, n, **columns):
    base = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.lit("p").alias("project_id"), F.lit("en").alias("language"), F.lit("debug").alias("task_type"),
        F.concat(F.lit("note "), "id").alias("summary"), F.lit(1).alias("trust_level"), (1 - F.col("id") / (2 * n)).alias("weight"),
        F.lit("e").alias("entity_group"), F.lit(None).cast("array<float>").alias("context_vector"), F.lit(0.0).alias("surprise_score"),
        (F.lit(START) + F.make_interval(mins=F.col("id"))).alias("created_at"), F.lit(None).cast("timestamp").alias("obsoleted_at"))
    return base.withColumn("occurred_at", F.col("created_at")).withColumns(columns)


def test_scan_and_groups_read_every_row(spark):
    m = memories(spark, 1500)
    scan = R.recent_scan(m, START)
    assert scan.count() == 1500
    assert distil.entity_groups(scan).count() == 1500 and distil.entity_groups(scan, cap=50).count() == 50
    assert distil.rule_text(scan).first()["members"] == 1500
    assert R.recent_scan(m, START, 1000).count() == 1000


def test_gate_and_lexical_search_read_every_row(spark):
    m = memories(spark, 700, summary=F.when(F.col("id") == "3", "zebra crossing").otherwise(F.col("summary")))
    q = spark.createDataFrame([("q", "p", "zebra crossing", [1.0, 0.0], "", "")],
                              "question_id string, project_id string, query string, query_vector array<float>, language string, task_type string")
    assert R.gate_and_rank(q, m).count() == 700 and R.gate_stats(q, m).first()["after_filter"] == 700
    assert R.lexical_topk(q, m, 1).first()["id"] == "3"
    assert R.rrf_topk(q, m, 1).first()["id"] == "3"


def test_rules_links_and_updates_read_every_row(spark):
    m = memories(spark, 600)
    rules = m.select("id", "project_id", F.lit("RULE").alias("type"), "trust_level", "weight", "entity_group", "obsoleted_at",
                     F.when(F.col("id").cast("int") % 2 == 0, "always set limits to ten").otherwise("never set limits to ten").alias("content"))
    assert evolve.rule_conflicts(rules).count() == 300 * 300
    new = spark.createDataFrame([("n", "p", "alpha words there", None)], "id string, project_id string, summary string, context_vector array<float>")
    old = m.withColumn("summary", F.lit("alpha words here"))
    assert write.related_links(new, old).count() == 600
    said = m.withColumn("summary", F.when(F.col("id") == "599", "never log secrets at all").otherwise("always log secrets at all"))
    assert evolve.explicit_updates(said.filter("id = '599'"), said).count() == 599


def test_pitfalls_are_not_clamped(spark):
    pits = memories(spark, 300).select(
        "id", "project_id", F.col("entity_group").alias("entity_id"), F.concat(F.lit("timeout "), "id").alias("signature"), "weight", "obsoleted_at",
        F.when(F.col("id").cast("int") < 200, "suppressed").otherwise("confirmed").alias("status"), F.lit(3).alias("occurrence_count"),
        F.lit(1).alias("times_shown"), F.lit(0).alias("times_suppressed"))
    assert P.pitfall_topk(pits, 250).count() == 250 and P.pitfall_topk(pits, 0).count() == 0
    assert P.workbench(pits, 20, status="confirmed").count() == 20
    q = spark.createDataFrame([("q", "p", "timeout 250")], "question_id string, project_id string, query string")
    assert P.recall(q, pits, 1).first()["id"] == "250"


def test_whole_texts_are_kept(spark):
    long = "继续：" + "word " * 300 + "actually wrong"
    row = spark.range(1).select(T.derive_summary(F.lit(long)).alias("s"), T.is_correction(F.lit(long)).alias("c")).first()
    assert row["s"].endswith("actually wrong") and row["c"]


def test_upsert_leaves_the_base_where_it_is(spark):
    from mnemospark.sources import snapshots

    base = spark.range(1000).select("id", F.lit("old").alias("v"))
    delta = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (2000, "c", 1)], "id long, v string, o int")
    got = snapshots.upsert(base, delta, order=F.col("o"))
    rows = {r["id"]: r["v"] for r in got.collect()}
    assert len(rows) == 1001 and rows[5] == "b" and rows[2000] == "c" and rows[6] == "old"
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 2 and "LeftAnti" in plan


def test_percentiles_stand_an_outlier(spark):
    from mnemospark.operators import ranking

    values = [*range(5000), 10**12]
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("same", 7.0)] * 50, "k string, v double")
    got = {(r["k"], r["p"]): r["percentile"] for r in ranking.nearest_rank_percentiles(df, ["k"], "v", [1, 50, 99.99, 100]).collect()}
    assert got["k", 50.0] == values[2500] and got["k", 1.0] == values[50] and got["k", 100.0] == 10**12 and got["same", 50.0] == 7.0


def test_a_version_has_one_writer(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    from mnemospark import schemas
    from mnemospark.sources import snapshots

    root = str(tmp_path)
    none = spark.createDataFrame([], snapshots.TABLES["episodic"])
    assert schemas and snapshots.write(none, root, "episodic") == 1
    (tmp_path / "episodic" / "v00000002").mkdir()
    with pytest.raises(PySparkException):
        snapshots.write(none, root, "episodic")


def test_resolution_retires_losers_and_links_winners(spark):
    from datetime import datetime

    rows = [("a", "b", "auto_resolved", "a", "b"), ("c", "b", "auto_resolved", "c", "b"), ("d", "e", "pending", None, None)]
    resolved = spark.createDataFrame(rows, "rule_a string, rule_b string, status string, winner string, loser string")
    retired, edges = evolve.resolution_effects(resolved, datetime(2029, 5, 3))
    assert [r["id"] for r in retired.collect()] == ["b"]
    assert sorted((e["from_id"], e["to_id"], e["edge_type"], e["properties"]["resolution"]) for e in edges.collect()) == [
        ("a", "b", "CONFLICTS_WITH", "winner"), ("c", "b", "CONFLICTS_WITH", "winner")]
