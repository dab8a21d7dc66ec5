"""Memory files and transcripts, batch or stream, into the raw_memory schema.

Each function takes a DataFrame of whole files (path, modified_at, text), as
:func:`read_files` and :func:`stream_files` give it, so parsing is one
projection per file and never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T
from mnemospark.operators.ranking import CHUNK, ordered_parts

_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def _as_text(files: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\\r\\n", "\n")
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"),
                        text.alias("text"))


def read_files(spark: SparkSession, *paths: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _as_text(reader.load(list(paths)))


def stream_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _as_text(reader.load(path))


def read_lines(spark: SparkSession, *paths: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modified_at, at, line: the lines of files of any size, read by as many tasks as a file has splits.

    ``at`` (start of the split, number in the task) orders the lines of a file.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"))
    return reader.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), at.alias("at"),
        F.regexp_replace("value", "\\r$", "").alias("line"))


def file_sizes(spark: SparkSession, *paths: str) -> DataFrame:
    """path, size_bytes; contents are not read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size_bytes"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def project_from_path(path: Column, root: str, fallback: str) -> Column:
    """First directory below ``root`` that is not a generic memory folder."""
    below = F.regexp_replace(F.substring_index(path, root.rstrip("/") + "/", -1), "[^/]*$", "")
    parts = F.filter(F.split(below, "/"), lambda p: (p != "") & ~p.isin(V.PATH_SKIPPED_DIRECTORIES))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(fallback))


def readable_workspace(workspace: Column) -> Column:
    """``Users-name-a-b`` becomes ``a-b``; anything else stays."""
    parts = F.split(workspace, "-")
    rest = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "-")
    return F.when((F.size(parts) >= 3) & (F.element_at(parts, 1) == "Users"), rest).otherwise(workspace)


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(flat header map, trimmed body). A header opens on the first line and may be unclosed."""
    rule = "[ \\t]*---[ \\t]*"
    has = text.rlike(f"^{rule}(\\n|$)")
    rest = F.regexp_replace(text, f"^{rule}(\\n|$)", "")
    closed = rest.rlike(f"(?m)^{rule}$")
    header = F.when(closed, F.regexp_extract(rest, f"(?ms)\\A(.*?)^{rule}$", 1)).otherwise(rest)
    body = F.when(closed, F.regexp_replace(rest, f"(?ms)\\A.*?^{rule}$", "")).otherwise(F.lit(""))
    lines = F.regexp_extract_all(F.when(has, header).otherwise(""), F.lit("(?m)^[A-Za-z0-9_.-]+:[ \\t]*.*$"), F.lit(0))

    def entry(line: Column) -> Column:
        value = T.trim_space(F.regexp_replace(line, "^[^:]*:", ""))
        return F.struct(F.regexp_extract(line, "^([^:]*):", 1).alias("k"),
                        F.regexp_replace(value, "^(['\"])(.*)\\1$", "$2").alias("v"))

    entries = F.transform(lines, entry)
    # A repeated key keeps its first value; map_from_entries would reject it.
    unique = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(unique), T.trim_space(F.when(has, body).otherwise(text))


def _raw(df: DataFrame, provider: str, uri: Column, content: Column, project: Column, session: Column,
         front: Column, metadata: Column) -> DataFrame:
    return df.select(
        F.lit(provider).alias("provider_name"), uri.alias("source_uri"), content.alias("content"),
        T.content_hash(content).alias("content_hash"), session.alias("agent_session_id"),
        project.alias("project_id"), "modified_at", front.alias("frontmatter"), metadata.alias("metadata"))


def _present(pairs: list[tuple[str, Column]]) -> Column:
    entries = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))) for k, v in pairs]))
    return F.map_from_entries(entries)


def markdown_memories(files: DataFrame, provider: str, project: Column, skip: tuple[str, ...] = ("MEMORY.md",)
                      ) -> DataFrame:
    """One record per ``.md`` file; known header keys are mapped, index files and empty files dropped."""
    kept = files.filter(F.lower("path").endswith(".md") & ~file_name(F.col("path")).isin(*skip))
    front, body = frontmatter(F.col("text"))
    parsed = kept.withColumns({"_f": front, "_b": body}).filter((F.col("_b") != "") | (F.size("_f") > 0))

    def key(name: str) -> Column:
        return F.try_element_at(F.col("_f"), F.lit(name))

    metadata = _present([("name", key("name")), ("memory_type", F.coalesce(key("type"), key("memory_type"))),
                         ("description", key("description")), ("enabled", key("enabled"))])
    return _raw(parsed, provider, F.col("path"), F.col("_b"), project, key("originSessionId"), F.col("_f"), metadata)


_BLOCKS = "array<struct<type:string,text:string>>"


def _said(line: Column, nested: bool) -> Column:
    """struct(role, text) of a transcript line."""
    role = F.get_json_object(line, "$.role")
    content = F.get_json_object(line, "$.message.content" if nested else "$.content")
    blocks = F.from_json(content, _BLOCKS)
    wanted = (lambda b: (b["text"] != "") & (b["type"] == "text")) if nested else (lambda b: b["text"] != "")
    joined = F.array_join(F.transform(F.filter(blocks, wanted), lambda b: b["text"]), "\n")
    text = F.when(content.startswith("["), joined)
    return F.struct(role.alias("role"), (text if nested else F.coalesce(text, content)).alias("text"))


def transcript_parts(lines: DataFrame, nested: bool = False, items: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(parts, transcripts) of transcripts of any length, from :func:`read_lines`.

    Parts: path, part, items, content, offset; joined by line breaks they are the content that :func:`transcripts` gives.
    Transcripts: path, modified_at, user_msg_count, asst_msg_count. A file may be longer than a task can hold: lines are
    parsed where they are read and numbered over the splits. Files without a text have no row.
    """
    parsed = lines.filter(F.trim("line").startswith("{")).withColumn("_s", _said(F.col("line"), nested))
    said = parsed.filter(F.col("_s.role").isin("user", "assistant") & (F.col("_s.text") != "")).select(
        "path", "modified_at", F.struct((F.col("_s.role") == "assistant").alias("later"), "at").alias("place"), F.col("_s.text").alias("text"))
    later = F.col("place.later").cast("bigint")
    counts = said.groupBy("path").agg(F.max("modified_at").alias("modified_at"), F.sum(1 - later).alias("user_msg_count"), F.sum(later).alias("asst_msg_count"))
    return ordered_parts(said, ["path"], "place", "text", items=items), counts


def transcripts(files: DataFrame, provider: str, project: Column, nested: bool = False,
                raw_project: Column | None = None) -> DataFrame:
    """One record per JSONL transcript: user texts, then assistant texts, in line order.

    Flat lines carry role and content (text or blocks); nested lines carry
    role and message.content blocks, of which only type 'text' counts.
    Malformed lines are skipped.
    """
    def parse(line: Column) -> Column:
        return _said(line, nested)

    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x).startswith("{"))
    parsed = files.filter(F.lower("path").endswith(".jsonl")).withColumn("_l", F.transform(lines, parse))

    def texts(role: str) -> Column:
        said = F.filter("_l", lambda x: (x["role"] == role) & F.coalesce(x["text"] != "", F.lit(False)))
        return F.transform(said, lambda x: x["text"])

    split = parsed.withColumns({"_u": texts("user"), "_a": texts("assistant")}).filter(
        F.size("_u") + F.size("_a") > 0)
    pairs = [("user_msg_count", F.size("_u")), ("asst_msg_count", F.size("_a"))]
    if raw_project is not None:
        pairs.insert(0, ("raw_project_id", raw_project))
    content = F.array_join(F.concat("_u", "_a"), "\n")
    none = F.lit(None).cast("string")
    return _raw(split, provider, F.col("path"), content, project, none,
                F.create_map().cast("map<string,string>"), _present(pairs))


def delimited_entries(files: DataFrame, provider: str, project: Column, target: Column,
                      scheme: str = "entries://", headers: tuple[str, ...] = ()) -> DataFrame:
    """One record per entry of a delimiter-separated file; block headers are stripped.

    The entry's hash names it, so rewriting the file keeps the URI of unchanged entries.
    """
    rows = files.withColumn("_target", target).select(
        "modified_at", "path", "_target", F.posexplode(F.split("text", V.ENTRY_DELIMITER)).alias("_i", "_e"))
    entry = T.trim_space(F.col("_e"))
    for header in headers:
        entry = F.when(entry == header, F.lit("")).when(
            entry.startswith(header + "\n"), T.trim_space(F.substring(entry, len(header) + 2, 1 << 30))).otherwise(entry)
    kept = rows.withColumn("_t", entry).filter(F.col("_t") != "")
    uri = F.concat(F.lit(scheme), F.col("_target"), F.lit("#"), T.entry_hash(F.col("_t")))
    none = F.lit(None).cast("string")
    return _raw(kept, provider, uri, F.col("_t"), project, none, F.create_map().cast("map<string,string>"),
                _present([("target", F.col("_target")), ("entry_index", F.col("_i"))]))


def configured(files: DataFrame, config: dict) -> DataFrame:
    """User-described source. ``config``: name, exclude (glob patterns on the file name),
    format (yaml_frontmatter | json_lines | raw_text), project_id / session_id (header
    keys) and metadata ({key: header key})."""
    import fnmatch

    rows = files
    for pattern in config.get("exclude", []):
        rows = rows.filter(~file_name(F.col("path")).rlike(fnmatch.translate(pattern).replace("\\z", "\\Z")))
    kind = config.get("format", "raw_text")
    empty = F.create_map().cast("map<string,string>")
    if kind == "yaml_frontmatter":
        front, body = frontmatter(F.col("text"))
    elif kind == "json_lines":
        lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x).startswith("{"))
        values = F.transform(lines, lambda x: F.get_json_object(x, "$.text"))
        front, body = empty, F.array_join(F.filter(values, lambda v: v.isNotNull()), "\n")
    else:
        front, body = empty, F.col("text")
    parsed = rows.withColumns({"_f": front, "_b": body}).filter((F.col("_b") != "") | (F.size("_f") > 0))

    def key(name: str | None) -> Column:
        return F.try_element_at(F.col("_f"), F.lit(name)) if name else F.lit(None).cast("string")

    project = F.coalesce(F.nullif(key(config.get("project_id")), F.lit("")), F.lit(config["name"]))
    metadata = _present([(k, key(v)) for k, v in config.get("metadata", {}).items()]) if config.get("metadata") else empty
    return _raw(parsed, config["name"], F.col("path"), F.col("_b"), project, key(config.get("session_id")),
                F.col("_f"), metadata)


# --- dedup, refinement, statistics ---------------------------------------------

def unseen(raw: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First record of each (source_uri, content_hash) that is not in ``seen``."""
    fresh = raw.dropDuplicates(["source_uri", "content_hash"])
    if seen is None:
        return fresh
    return fresh.join(seen.select("source_uri", "content_hash"), ["source_uri", "content_hash"], "left_anti")


def refine(raw: DataFrame) -> DataFrame:
    """Keyword refinement: language, task, entity, summary and confidence."""
    header = F.array_join(F.transform(F.map_values("frontmatter"), lambda v: F.concat(v, F.lit(" "))), "")
    content = F.when(F.col("content") == "", F.coalesce(header, F.lit(""))).otherwise(F.col("content"))

    def key(name: str) -> Column:
        return F.coalesce(F.try_element_at("frontmatter", F.lit(name)), F.lit(""))

    named = F.when(key("description") != "", F.concat(key("name"), F.lit(": "), key("description"))).otherwise(key("name"))
    rows = raw.withColumn("_c", content)
    return rows.withColumns({
        "language": T.infer_language(F.coalesce("project_id", F.lit("")), F.col("_c")),
        "task_type": T.infer_task_type(F.col("_c")), "entity_group": T.mentioned_entity(F.col("_c")),
        "summary": F.when(key("name") != "", named).otherwise(F.col("_c")),
        "confidence": F.when(F.col("_c") == "", F.lit(0.3)).otherwise(F.lit(0.6)),
    }).drop("_c")


def refined_episodes(refined: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Episodic rows of confident refinements; the file time is the creation time."""
    none = F.lit(None)
    return refined.filter(F.col("confidence") >= minimum).select(
        T.stable_id("ingest", F.col("source_uri"), F.col("content_hash")).alias("id"), "project_id", "language",
        "task_type", "summary", F.lit("LLM").alias("source_type"), F.lit(V.TRUST_DEFAULT).alias("trust_level"),
        F.lit(1.0).alias("weight"), F.lit(1.0).alias("effective_frequency"), "entity_group",
        none.cast("array<float>").alias("context_vector"), F.col("source_uri").alias("full_snapshot_uri"),
        F.lit(False).alias("is_correction"), F.lit(0.0).alias("surprise_score"),
        F.col("modified_at").alias("created_at"), none.cast("timestamp").alias("last_accessed_at"),
        none.cast("timestamp").alias("obsoleted_at"), F.col("modified_at").alias("occurred_at"))


def refine_prompts(raw: DataFrame) -> DataFrame:
    """Prompt text per record for an outside inference step."""
    kind = F.coalesce(F.try_element_at("metadata", F.lit("memory_type")), F.lit(""))
    return raw.select("source_uri", "content_hash", F.concat(
        F.lit("provider: "), F.col("provider_name"), F.lit("\nproject: "), F.coalesce("project_id", F.lit("")),
        F.lit("\nmemory_type: "), kind, F.lit("\ncontent:\n"), F.col("content")).alias("prompt"))


def scan_stats(raw: DataFrame, seen: DataFrame, minimum: float = 0.5) -> DataFrame:
    """found, written and skipped per provider; a repeated or known record is skipped,
    and so is one whose refinement is not confident."""
    known = seen.select("source_uri", "content_hash").distinct().withColumn("_seen", F.lit(True))
    once = refine(raw).groupBy("provider_name", "source_uri", "content_hash").agg(
        F.count("*").alias("_n"), F.max("confidence").alias("_conf"))
    joined = once.join(known, ["source_uri", "content_hash"], "left")
    written = F.when(F.col("_seen").isNull() & (F.col("_conf") >= minimum), F.lit(1)).otherwise(0)
    return joined.groupBy("provider_name").agg(
        F.sum("_n").alias("found"), F.sum(written).cast("bigint").alias("written"),
        (F.sum("_n") - F.sum(written)).cast("bigint").alias("skipped"))
