"""File sources, batch and stream, and ingest."""

import json

from pyspark.sql import functions as F

from mnemospark.sources import files as S, messages


def lay_out(root, contents):
    for name, text in contents.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(root)


def test_markdown(spark, tmp_path):
    root = lay_out(tmp_path, {
        "app/memory/one.md": '---\nname: "One"\ntype: note\noriginSessionId: s1\n---\n\nbody text\n', "app/memory/MEMORY.md": "index",
        "app/memory/two.md": "plain body", "app/memory/empty.md": "---\n---\n", "app/x.txt": "no"})
    raw = S.markdown_memories(S.read_files(spark, root), "md", S.project_from_path(F.col("path"), root, "none"))
    rows = {r.content: r for r in raw.collect()}
    assert set(rows) == {"body text", "plain body"}
    one = rows["body text"]
    assert one.metadata == {"name": "One", "memory_type": "note"} and one.agent_session_id == "s1" and one.project_id == "app"
    assert rows["plain body"].frontmatter == {}


def test_transcripts(spark, tmp_path):
    flat = [{"role": "assistant", "content": [{"type": "text", "text": "a1"}, {"type": "x"}]}, {"role": "user", "content": "u1"},
            {"role": "system", "content": "no"}, {"role": "user", "content": [{"type": "text", "text": "u2"}]}]
    nested = [{"role": "user", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "image", "text": "skip"}]}}]
    root = lay_out(tmp_path, {"p/a.jsonl": "\n".join(map(json.dumps, flat)) + "\n{broken\n", "p/empty.jsonl": '{"role":"system","content":"x"}',
                              "n/b.jsonl": "\n".join(map(json.dumps, nested))})
    raw = S.transcripts(S.read_files(spark, root + "/p"), "flat", F.lit("p")).collect()
    assert [(r.content, r.metadata["user_msg_count"], r.metadata["asst_msg_count"]) for r in raw] == [("u1\nu2\na1", "2", "1")]
    assert S.transcripts(S.read_files(spark, root + "/n"), "nested", F.lit("p"), nested=True).first().content == "hi"


def test_entries_and_config(spark, tmp_path):
    root = lay_out(tmp_path, {"MEMORY.md": "HEAD\nfirst\n§\n\n§\nsecond", "c/keep.md": "---\nproj: z\n---\ntext", "c/skip_me.md": "x"})
    raw = S.delimited_entries(S.read_files(spark, root + "/MEMORY.md"), "e", F.lit("p"), F.lit("memory"), headers=("HEAD",)).collect()
    assert [(r.content, r.metadata["entry_index"]) for r in raw] == [("first", "0"), ("second", "2")]
    config = {"name": "mine", "format": "yaml_frontmatter", "exclude": ["skip_*"], "project_id": "proj"}
    assert [(r.project_id, r.content) for r in S.configured(S.read_files(spark, root + "/c"), config).collect()] == [("z", "text")]


def test_stream_of_files(spark, tmp_path):
    root = lay_out(tmp_path / "in", {"a.md": "hello"})
    raw = S.markdown_memories(S.stream_files(spark, root), "md", F.lit("p"))
    out = str(tmp_path / "out")
    query = raw.select("content", "content_hash").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.content for r in spark.read.parquet(out).collect()] == ["hello"]


def test_refine(spark, tmp_path):
    root = lay_out(tmp_path, {"a.md": "panic in @pkg/pool.go today", "b.md": "---\nname: N\ndescription: D\n---\n重构 the module"})
    raw = S.markdown_memories(S.read_files(spark, root), "md", F.lit("proj"))
    got = {r.summary: (r.task_type, r.entity_group) for r in S.refined_episodes(S.refine(S.unseen(raw.unionByName(raw)))).collect()}
    assert got == {"panic in @pkg/pool.go today": ("debug", "pkg/pool.go"), "N: D": ("refactor", "")}


def test_chat_time(spark):
    got = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("soon",), ("",), ("2024-99-99 00:00:00",)], "t string").select(
        messages.date_prefixed(F.lit("x"), F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == ["[2024-01-02] x", "[2024-01-02] x", "x", "x", "x"]


def test_transcripts_beyond_one_split(spark, tmp_path):
    """Splits of 700 bytes: several tasks read one file, and its parts make the content of the whole-file way."""
    lines = [json.dumps({"role": ("user", "assistant", "system")[i % 3], "content": f"say {i} \u00e9 " + "x" * (i % 40) if i % 7 else [{"type": "text", "text": f"block {i}"}]},
                        ensure_ascii=False) for i in range(200)]
    root = lay_out(tmp_path, {"p/a.jsonl": "{broken\n\n" + "\r\n".join(lines), "p/b.jsonl": lines[1], "p/empty.jsonl": ""})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        read = S.read_lines(spark, root, glob="*.jsonl")
        assert read.filter("path like '%a.jsonl'").select("at.split").distinct().count() > 10
        parts, counts = S.transcript_parts(read, items=16)
        got = {}
        for r in sorted(parts.collect(), key=lambda r: (r.path, r.part)):
            text = got.get(r.path)
            assert r["items"] <= 16 and r.offset == (0 if text is None else len(text) + 1)
            got[r.path] = r.content if text is None else text + "\n" + r.content
        totals = {r.path: (str(r.user_msg_count), str(r.asst_msg_count)) for r in counts.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = S.transcripts(S.read_files(spark, root), "flat", F.lit("p")).collect()
    tail = lambda path: path.rsplit("/", 1)[1]
    assert {tail(k): t for k, t in got.items()} == {tail(r.source_uri): r.content for r in whole} and len(whole) == 2
    assert {tail(k): t for k, t in totals.items()} == {tail(r.source_uri): (r.metadata["user_msg_count"], r.metadata["asst_msg_count"]) for r in whole}
