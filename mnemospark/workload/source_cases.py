"""Sources: messages, files, mirrored writes, ingest."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from mnemospark.operators import gate
from mnemospark.operators.ranking import shared_folder
from mnemospark.sources import files as S, messages
from mnemospark.workload import oracle_views as O
from mnemospark.workload.registry import big, case
from mnemospark.workload.views import NOW

AT = datetime(2024, 1, 30)


def _files(df, path, text):
    return df.select(path.alias("path"), F.lit(AT).alias("modified_at"), F.lit(0).cast("bigint").alias("size_bytes"), text.alias("text"))


@case("frontmatter_source", f"""
SELECT '/root/' || source || '/memory/' || doc_id || '.md' AS source_uri, source AS project_id, sha256({O.trim_space('text')}) AS content_hash,
 'doc ' || doc_id AS name, CASE WHEN doc_id % 2 = 0 THEN 'lang ' || lang END AS description, 's' || doc_id AS session
FROM documents WHERE doc_id % 4 <> 3 OR {O.trim_space('text')} <> ''""")
def frontmatter_source(v):
    d = F.col("doc_id").cast("string")
    described = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('description: "lang '), "lang", F.lit('"\n'))).otherwise("")
    text = F.concat(F.lit("---\nname: doc "), d, F.lit("\n"), described, F.lit("originSessionId: s"), d, F.lit("\n---\n"), F.col("text"), F.lit("\n"))
    path = F.concat(F.lit("/root/"), "source", F.lit("/memory/"), d, F.lit(".md"))
    raw = S.markdown_memories(_files(v.table("documents"), path, text), "markdown", S.project_from_path(F.col("path"), "/root", "none"))
    return raw.select("source_uri", "project_id", "content_hash", F.try_element_at("metadata", F.lit("name")).alias("name"),
                      F.try_element_at("metadata", F.lit("description")).alias("description"), F.col("agent_session_id").alias("session"))


def _transcript(v, nested):
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    line = F.to_json(F.struct("role", F.struct(block.alias("content")).alias("message"))) if nested else F.when(
        F.col("turn") % 2 == 0, F.to_json(F.struct("role", F.col("text").alias("content")))).otherwise(
        F.to_json(F.struct("role", block.alias("content"))))
    rows = v.table("conversations").withColumn("line", line).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    text = F.concat(F.lit("not json\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return _files(rows, F.concat(F.lit("/t/Users-ann-app-"), "conv_id", F.lit("/agent/"), "conv_id", F.lit(".jsonl")), text)


_SAID = """
SELECT {key} AS source_uri, {project} AS project_id, sha256(string_agg(text, chr(10) ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, turn)) AS content_hash,
 CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS VARCHAR) AS users, CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS VARCHAR) AS assistants
FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id"""
_KEY = "'/t/Users-ann-app-' || conv_id || '/agent/' || conv_id || '.jsonl'"


@case("transcript_source", _SAID.format(key=_KEY, project="'Users-ann-app-' || conv_id"))
def transcript_source(v):
    raw = S.transcripts(_transcript(v, False), "flat", S.project_from_path(F.col("path"), "/t", "none"))
    return raw.select("source_uri", "project_id", "content_hash", F.col("metadata")["user_msg_count"].alias("users"), F.col("metadata")["asst_msg_count"].alias("assistants"))


@case("nested_transcript_source", _SAID.format(key=_KEY, project="'app-' || conv_id"))
def nested_transcript_source(v):
    workspace = S.project_from_path(F.col("path"), "/t", "none")
    raw = S.transcripts(_transcript(v, True), "nested", S.readable_workspace(workspace), nested=True, raw_project=workspace)
    return raw.select("source_uri", "project_id", "content_hash", F.col("metadata")["user_msg_count"].alias("users"), F.col("metadata")["asst_msg_count"].alias("assistants"))


@case("transcript_parts", """
SELECT session, part, items, md5(content) AS digest,
 CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY session ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM (SELECT session, (n - 1) // 40 AS part, count(*) AS items, string_agg(text, chr(10) ORDER BY n) AS content
 FROM (SELECT conv_id % 8 AS session, text, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY role <> 'user', conv_id, turn) AS n
  FROM conversations WHERE role IN ('user', 'assistant') AND text <> '') GROUP BY 1, 2)""")
def transcript_parts(v):
    """All conversations as eight transcripts, written as JSON lines in the shared folder and read split by split."""
    spark = v.table("conversations").sparkSession
    folder = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    rows = v.table("conversations").withColumn("session", F.col("conv_id") % 8).repartition("session").sortWithinPartitions("session", "conv_id", "turn")
    rows.select("session", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("value")).write.partitionBy("session").text(folder)
    parts, _ = S.transcript_parts(S.read_lines(spark, folder), items=40)
    session = F.regexp_extract("path", "session=([0-9]+)", 1).cast("bigint")
    return parts.select(session.alias("session"), "part", "items", "offset", F.md5("content").alias("digest"))


@case("entry_source", f"""
SELECT 'entries://notes#' || substr(sha256(t), 1, 8) AS source_uri, 'c' || conv_id AS project_id, CAST(n AS VARCHAR) AS entry_index FROM (
 SELECT conv_id, {O.trim_space('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) WHERE t <> ''""")
def entry_source(v):
    rows = v.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.when(x["turn"] == 0, F.concat(F.lit("# NOTES\n"), x["text"])).otherwise(x["text"])), "\n§\n")
    files = _files(rows, F.concat(F.lit("/n/c"), "conv_id", F.lit("/NOTES.md")), text)
    raw = S.delimited_entries(files, "entries", S.project_from_path(F.col("path"), "/n", "none"), F.lit("notes"), headers=("# NOTES",))
    return raw.select("source_uri", "project_id", F.col("metadata")["entry_index"].alias("entry_index"))


@case("configured_source", f"""
SELECT '/c/' || source || '-' || doc_id || '.txt' AS source_uri, lang AS project_id, sha256({O.trim_space('text')}) AS content_hash, source AS team FROM documents WHERE source <> 'src3'""")
def configured_source(v):
    d = F.col("doc_id").cast("string")
    text = F.concat(F.lit("---\nproj: "), "lang", F.lit("\nteam: "), "source", F.lit("\n---\n"), "text")
    config = {"name": "mine", "format": "yaml_frontmatter", "exclude": ["src3-*"], "project_id": "proj", "metadata": {"team": "team"}}
    raw = S.configured(_files(v.table("documents"), F.concat(F.lit("/c/"), "source", F.lit("-"), d, F.lit(".txt")), text), config)
    return raw.select("source_uri", "project_id", "content_hash", F.col("metadata")["team"].alias("team"))


def _raw(v):
    none = F.lit(None).cast("string")
    front = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("n"), "doc_id"), F.lit("description"), F.col("lang"))).otherwise(
        F.create_map().cast("map<string,string>"))
    return v.table("documents").select(
        F.col("source").alias("provider_name"), F.concat(F.lit("u/"), "source").alias("source_uri"), F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"), none.alias("agent_session_id"), F.col("source").alias("project_id"), F.lit(AT).alias("modified_at"),
        front.alias("frontmatter"), F.create_map().cast("map<string,string>").alias("metadata"), "doc_id")


def _seen(v):
    return v.table("labels").join(v.table("documents"), "doc_id").select(F.concat(F.lit("u/"), "source").alias("source_uri"), F.sha2("text", 256).alias("content_hash"))


@case("ingest_dedup", """
SELECT DISTINCT 'u/' || source AS source_uri, sha256(text) AS content_hash FROM documents WHERE ('u/' || source, sha256(text)) NOT IN (
 SELECT ('u/' || source, sha256(text)) FROM documents JOIN labels USING (doc_id))""")
def ingest_dedup(v):
    return S.unseen(_raw(v).drop("doc_id"), _seen(v)).select("source_uri", "content_hash")


@case("scan_stats", """
WITH d AS (SELECT source, sha256(text) AS h, count(*) AS n, bool_or(text <> '' OR doc_id % 3 = 0) AS ok FROM documents GROUP BY 1, 2),
s AS (SELECT DISTINCT source, sha256(text) AS h FROM documents JOIN labels USING (doc_id))
SELECT source AS provider_name, CAST(sum(n) AS BIGINT) AS found, CAST(sum(CASE WHEN s.h IS NULL AND ok THEN 1 ELSE 0 END) AS BIGINT) AS written,
 CAST(sum(n) - sum(CASE WHEN s.h IS NULL AND ok THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM d LEFT JOIN s USING (source, h) GROUP BY 1""")
def scan_stats(v):
    return S.scan_stats(_raw(v), _seen(v))


def _language_sql(x):
    from mnemospark import fixed_values as V

    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{lang}'" for w, lang in V.LANGUAGE_KEYWORDS) + " ELSE 'zh' END"


def _task_sql(x):
    from mnemospark import fixed_values as V

    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{'|'.join(words)}') THEN '{task}'" for task, words in V.TASK_KEYWORDS) + " ELSE 'feature' END"


@case("refine_heuristic", f"""
SELECT doc_id, {_language_sql("lower(source || ' ' || text)")} AS language, {_task_sql('lower(text)')} AS task_type,
 CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id || ': ' || lang ELSE text END AS summary,
 regexp_replace(regexp_extract(text, '@[\\w./-]+\\.(?:go|proto|ts|tsx|js|py|java|rs)'), '^@', '') AS entity FROM documents""")
def refine_heuristic(v):
    return S.refine(_raw(v)).select("doc_id", "language", "task_type", "summary", F.col("entity_group").alias("entity"))


@case("project_from_path", """
SELECT page_id, coalesce(list_filter(string_split(regexp_replace(regexp_replace(url, '^.*http:///?', ''), '[^/]*$', ''), '/'), lambda p: p <> '' AND p NOT IN ('memory', 'memories', 'projects'))[1], 'none') AS project FROM pages""")
def project_from_path(v):
    return v.table("pages").select("page_id", S.project_from_path(F.col("url"), "http://", "none").alias("project"))


@case("compression_insight", O.with_views("turns", ("t", f"SELECT session_id, seq, {O.trim_space('content')} AS t FROM v_turns")) + f"""
SELECT session_id, '[memory] ' || arg_max(t, seq) AS insight FROM t WHERE {O.confirmed('t')} OR {O.correction('t')} OR length(t) > 20 GROUP BY 1""")
def compression_insight(v):
    return messages.compression_insights(v.turn())


@case("ingest_counts", O.with_views("turns") + f"""
SELECT project_id, CASE WHEN {O.trim_space("CASE WHEN role = 'system' THEN ' ' ELSE content END")} = '' THEN 'empty_message' ELSE 'user_confirmed' END AS reason, count(*) AS n,
 CAST(sum(CASE WHEN role = 'system' THEN 0 ELSE 1 END) AS BIGINT) AS persisted, CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM v_turns GROUP BY 1, 2""")
def ingest_counts(v):
    """Gate-off ingest in which the system turns are blank."""
    blank = v.turn().withColumn("content", F.when(F.col("role") == "system", " ").otherwise(F.col("content")))
    events = messages.write_events(blank, gate_off=True)
    judged = gate.significance_gate(events.filter("drop_reason is null"), mode="off")
    return messages.ingest_counts(events.filter("drop_reason is not null"), judged, "project_id")


@case("read_only_context", O.with_views("turns") + f"""
SELECT event_id, CASE WHEN role = 'system' THEN 'read_only_context' WHEN {O.trim_space(O.derive_summary('content'))} = '' THEN 'empty_summary' END AS reason FROM v_turns""")
def read_only_context(v):
    agent = F.when(F.col("role") == "system", "helper").otherwise("primary")
    from mnemospark.functions import text as T

    return v.turn().select("event_id", messages.read_only_reason(agent, F.lit(""), T.derive_summary(F.col("content"))).alias("reason"))


@case("delegations", """
SELECT sha256('delegation' || chr(1) || 'c' || conv_id || chr(1) || turn) AS id, '委派：' || text || ' → ' || role AS summary, 'delegation://' || turn AS uri FROM conversations""")
def delegations(v):
    calls = v.table("conversations").select(F.concat(F.lit("c"), "conv_id").alias("project_id"), F.col("turn").alias("call_id"), F.col("turn").alias("child_id"),
                                            F.col("text").alias("task"), F.col("role").alias("result"))
    return messages.delegations(calls, NOW).select("id", "summary", F.col("full_snapshot_uri").alias("uri"))


_ACTIONS = "CASE event_type WHEN 'error' THEN 'remove' WHEN 'click' THEN 'replace' WHEN 'view' THEN 'replace' ELSE 'add' END"


_VERSIONS = f"""
WITH w AS (SELECT event_id AS seq, 'p' || (user_id % 10) AS project_id, 't' || (user_id % 7) AS target, {_ACTIONS} AS action, props FROM events),
l AS (SELECT *, max(CASE WHEN action <> 'remove' THEN seq END) OVER (PARTITION BY project_id, target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w),
n AS (SELECT *, sha256('mirror' || chr(1) || project_id || chr(1) || target || chr(1) || seq) AS new_id, sha256('mirror' || chr(1) || project_id || chr(1) || target || chr(1) || p) AS old_id FROM l)"""


@case("cdc_replace", f"""
WITH w AS (SELECT event_id AS seq, 'p' || (user_id % 10) AS project_id, 't' || (user_id % 7) AS target, {_ACTIONS} AS action FROM events),
l AS (SELECT *, max(CASE WHEN action <> 'remove' THEN seq END) OVER (PARTITION BY project_id, target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w)
SELECT seq, action, sha256('mirror' || chr(1) || project_id || chr(1) || target || chr(1) || p) AS previous_id, CAST(action <> 'add' AND p IS NOT NULL AS INTEGER) AS retires FROM l""")
def cdc_replace(v):
    return messages.mirror_versions(_mirrored(v)).select("seq", "action", "previous_id", F.col("retires").cast("int").alias("retires"))


def _mirrored(v):
    kind = F.col("event_type")
    return v.table("events").select(
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("project_id"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("target"), F.col("event_id").alias("seq"),
        F.when(kind == "error", "remove").when(kind.isin("click", "view"), "replace").otherwise("add").alias("action"), F.col("props").alias("content"))


@case("mirror_changes", _VERSIONS + """
SELECT 'episode' AS kind, new_id AS id, 'memory-write://' || target || '#' || substr(sha256(props), 1, 8) || '?action=' || action || '&source=user_explicit' AS other FROM n WHERE action <> 'remove'
UNION ALL SELECT DISTINCT 'retired', old_id, NULL FROM n WHERE action <> 'add' AND p IS NOT NULL
UNION ALL SELECT 'edge', old_id, new_id FROM n WHERE action = 'replace' AND p IS NOT NULL""")
def mirror_changes(v):
    """What a feed of mirrored writes changes: new episodes with their address, retired ids, edges from old to new."""
    episodes, retired, edges = messages.mirror_changes(messages.mirror_versions(_mirrored(v)), NOW)
    return episodes.select(F.lit("episode").alias("kind"), "id", F.col("full_snapshot_uri").alias("other")).unionByName(
        retired.select(F.lit("retired").alias("kind"), "id", F.lit(None).cast("string").alias("other"))).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("from_id").alias("id"), F.col("to_id").alias("other")))


@case("configured_json_source", """
SELECT '/j/' || conv_id || '.jsonl' AS source_uri, 'talks' AS project_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS content_hash FROM conversations
GROUP BY conv_id HAVING string_agg(text, chr(10) ORDER BY turn) <> ''""")
def configured_json_source(v):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.to_json(F.struct("text")).alias("line"))))
    rows = v.table("conversations").groupBy("conv_id").agg(lines.alias("l"))
    text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\nno line"))
    files = _files(rows, F.concat(F.lit("/j/"), "conv_id", F.lit(".jsonl")), text)
    return S.configured(files, {"name": "talks", "format": "json_lines"}).select("source_uri", "project_id", "content_hash")


@case("configured_raw_source", """
SELECT '/r/' || doc_id || '.txt' AS source_uri, 'plain' AS project_id, sha256(text) AS content_hash FROM documents WHERE text <> ''""")
def configured_raw_source(v):
    files = _files(v.table("documents"), F.concat(F.lit("/r/"), "doc_id", F.lit(".txt")), F.col("text"))
    return S.configured(files, {"name": "plain"}).select("source_uri", "project_id", "content_hash")
