"""Edges of a table of nodes."""

from mnemospark.operators import evolve


def test_ends_meet_the_nodes_in_one_join(spark):
    rows = [("a", "b", "X"), ("b", "b", "X"), ("b", "c", "X"), ("c", "a", "Y"), ("a", "b", "X"), (None, "a", "X")]
    edges = spark.createDataFrame(rows, "from_id string, to_id string, edge_type string")
    nodes = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "id string")

    def found(*args):
        return sorted((str(r.from_id), r.to_id, r.node_id, r.direction) for r in evolve.neighbours_of(edges, nodes, *args).collect())

    out = [("a", "b", "a", "out"), ("a", "b", "a", "out"), ("b", "b", "b", "out"), ("b", "c", "b", "out")]
    into = [("None", "a", "a", "in"), ("a", "b", "b", "in"), ("a", "b", "b", "in"), ("b", "b", "b", "in")]
    assert found("X") == sorted(out + into) and found("X", "out") == sorted(out) and found("X", "in") == sorted(into)
    assert ("c", "a", "c", "out") not in found(None) and ("c", "a", "a", "in") in found(None)
    plan = evolve.neighbours_of(edges, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_pitfalls_go_to_the_parts_of_their_entity_as_lists(spark):
    """Each pitfall went to as many parts as a shuffle has, whatever its entity held."""
    from pyspark.sql import functions as F

    from mnemospark.operators import write

    new = spark.createDataFrame([(i % 90, "p", "debug", f"e{i % 3}") for i in range(100)] + [(None, "p", "debug", "e0"), (200, None, "debug", "e0"), (201, "p", "debug", ""), (202, "p", "x", "e0")],
                                "id long, project_id string, task_type string, entity_group string")
    rows = [(i % 40, "p", f"e{i % 4}", None) for i in range(50)] + [(None, "p", "e1", None), (60, "q", "e0", None), (61, "p", "", None), (62, None, "e0", None), (63, "p", "e0", 1)]
    pits = spark.createDataFrame(rows, "id long, project_id string, entity_id string, o int").withColumn("obsoleted_at", F.timestamp_seconds("o"))
    e, p = new.filter("task_type = 'debug' and entity_group <> ''"), pits.filter("o is null")
    want = sorted((str(a.id), str(b.id)) for a in e.collect() for b in p.collect() if a.project_id is not None and a.project_id == b.project_id and a.entity_group == b.entity_id)
    for sizes in ({}, {"block_rows": 7, "listed": 3}):
        found = write.triggered_pitfalls(new, pits, **sizes)
        assert sorted((str(r.from_id), str(r.to_id)) for r in found.collect()) == want
    assert len(want) > 500
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        plan = write.triggered_pitfalls(new, pits)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    assert "collect_list" in plan and "[0,1,2,3" not in plan
