"""Long texts as ordered parts: rules and validation prompts of clusters of any size."""

from pyspark.sql import functions as F

from mnemospark.operators import distil, ranking

SCAN = "project_id string, task_type string, scan_rank long, id string, summary string"


def scan(spark):
    rows = [("p", "debug", 10**15 + 7919 * i, f"m{i}", None if i == 9 else f"note {i}") for i in range(100)]
    return spark.createDataFrame(rows + [("p", "review", i, f"r{i}", f"seen {i}") for i in range(3)] + [("q", "debug", 1, "x", "lone")], SCAN)


def joined(parts):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (r.project_id, r.task_type, r.part)):
        key = (r.project_id, r.task_type)
        assert r.offset == (len(out[key]) + 1 if key in out else 0)
        out[key] = out[key] + "\n" + r.content if key in out else r.content
    return out


def test_parts_make_the_rule(spark):
    df = scan(spark)
    parts = distil.rule_parts(df, items=8)
    assert parts.agg(F.max("items")).first()[0] == 8 and parts.filter("task_type = 'debug'").count() == 13
    whole = {(r.project_id, r.task_type): r.content for r in distil.rule_text(df.fillna({"summary": ""})).collect()}
    assert joined(parts) == whole and set(whole) == {("p", "debug"), ("p", "review")}


def test_validation_asks_for_every_member(spark):
    text = joined(distil.validation_parts(scan(spark), items=8))
    assert text["p", "review"] == (
        "Candidate rule: Pattern in p/review:\n- seen 0\n- seen 1\n- seen 2\n\nNotes it should describe:\n[0] seen 0\n[1] seen 1\n[2] seen 2\n"
        "\nAnswer with one number from 0 (not at all) to 1 (fully).")
    assert text["p", "debug"].count("note 99") == 2 and "[99] note 99" in text["p", "debug"]
    few = joined(distil.validation_parts(scan(spark), sample=20))["p", "debug"]
    assert "[19] note 19" in few and "[20]" not in few and "- note 99" in few


def test_parts_of_nothing(spark):
    df = scan(spark).limit(0)
    assert distil.rule_parts(df).count() == distil.validation_parts(df).count() == 0
    lone = ranking.ordered_parts(spark.createDataFrame([("k", 5, None)], "k string, o long, t string"), ["k"], "o", "t")
    assert [(r.part, r["items"], r.content, r.offset) for r in lone.collect()] == [(0, 1, "", 0)]


def test_backtest_embeds_a_copied_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(c):
        @F.udf("array<float>")
        def embed(text):
            seen.add(1)
            return None if text is None else [float(text.count("a")), float(text.count("b"))]

        return embed(c)

    rows = [("p", "debug", "aab", None)] * 30 + [("p", "debug", "b", [0.0, 0.0])] * 9 + [("p", "debug", "zzz", None), ("p", "debug", None, None)]
    rows += [("p", "debug", "aab", [3.0, 4.0])] * 2 + [("q", "debug", "b", None)] * 3
    scan = spark.createDataFrame(rows, "project_id string, task_type string, summary string, context_vector array<float>")
    rules = spark.createDataFrame([("p", "debug", "a"), ("q", "debug", "zz")], "project_id string, task_type string, content string")
    got = {r.project_id: r.backtest_accuracy for r in distil.backtest(rules, scan, counted).collect()}
    assert abs(got["p"] - (30 * 2 / 5 ** 0.5 + 9 * 0.0 + 2 * 0.6) / 41) < 1e-9 and got["q"] == 0.5
    assert seen.value <= 2 * (2 + 5)  # rules and different texts of a group; a task may be planned twice
