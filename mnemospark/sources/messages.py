"""Conversation turns, mirrored memory writes and delegations as input tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T, weights as W
from mnemospark.operators.ranking import carry_forward


def chat_time(c: Column) -> Column:
    """Zoned or plain date-time text as a timestamp, NULL when it is neither."""
    s = T.trim_space(c)
    zoned = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:[0-9]{2})$"), s)
    plain = F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), s)
    return F.coalesce(F.try_to_timestamp(zoned), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")))


def date_prefixed(content: Column, time_text: Column) -> Column:
    """``[yyyy-MM-dd] `` before the content when the time parses; the date as written."""
    parsed = chat_time(time_text)
    written = F.substring(T.trim_space(time_text), 1, 10)
    return F.when(parsed.isNotNull(), F.concat(F.lit("["), written, F.lit("] "), content)).otherwise(content)


def write_events(turns: DataFrame, gate_off: bool = False, date_prefix: bool = True) -> DataFrame:
    """Derive write events from turns (event_id, project_id, seq, content[, chat_time]).

    Blank contents stay, with drop_reason 'empty_message', so they can be counted.
    """
    content = T.trim_space(F.col("content"))
    when = F.col("chat_time") if "chat_time" in turns.columns else F.lit(None).cast("string")
    body = date_prefixed(F.col("_c"), when) if date_prefix else F.col("_c")
    base = turns.withColumn("_c", content).withColumn("_b", body)
    confirmed = F.lit(True) if gate_off else T.is_confirmed(F.col("_b"))
    correction = F.lit(False) if gate_off else T.is_correction(F.col("_b"))
    summary = F.col("_b") if gate_off else T.derive_summary(F.col("_b"))
    return base.withColumns({
        "summary": summary, "user_confirmed": confirmed, "is_correction": correction,
        "caused_behavior_change": F.lit(False), "subsequent_reference_count": F.lit(0),
        "occurred_at": chat_time(when), "drop_reason": F.when(F.col("_c") == "", F.lit("empty_message")),
    }).withColumn("surprise_score", W.surprise_score(
        F.col("user_confirmed"), F.col("is_correction"), F.col("caused_behavior_change"))).drop("_c", "_b")


def read_only_reason(agent_context: Column, session_context: Column, summary: Column) -> Column:
    """Why a turn is not offered to the gate, NULL when it is."""
    def other(c: Column) -> Column:
        return (F.coalesce(c, F.lit("")) != "") & (c != "primary")

    return F.when(other(agent_context) | other(session_context), F.lit("read_only_context")).when(
        T.trim_space(F.coalesce(summary, F.lit(""))) == "", F.lit("empty_summary"))


def ingest_counts(dropped: DataFrame, judged: DataFrame, *keys: str) -> DataFrame:
    """persisted / skipped / count per reason, over dropped and judged events."""
    rows = dropped.select(*keys, F.col("drop_reason").alias("reason"), F.lit(False).alias("persisted")).unionByName(
        judged.select(*keys, F.col("gate_reason").alias("reason"), F.col("should_persist").alias("persisted")))
    kept = F.col("persisted").cast("bigint")
    return rows.groupBy(*keys, "reason").agg(
        F.count("*").alias("n"), F.sum(kept).alias("persisted"), F.sum(1 - kept).alias("skipped"))


def compression_insights(messages: DataFrame, tag: str = "[memory] ") -> DataFrame:
    """Last non-trivial message per session (session_id, seq, content)."""
    text = T.trim_space(F.col("content"))
    anchors = messages.withColumn("_t", text).filter(
        T.is_confirmed(F.col("_t")) | T.is_correction(F.col("_t")) | (F.length("_t") > 20))
    return anchors.groupBy("session_id").agg(F.max_by("_t", "seq").alias("_t")).select(
        "session_id", F.concat(F.lit(tag), F.col("_t")).alias("insight"))


def _user_episode(df: DataFrame, ident: Column, summary: Column, source: str, trust: int, uri: Column, at: Column
                  ) -> DataFrame:
    none = F.lit(None)
    return df.select(
        ident.alias("id"), "project_id", F.lit("").alias("language"), F.lit("feature").alias("task_type"),
        summary.alias("summary"), F.lit(source).alias("source_type"), F.lit(trust).alias("trust_level"),
        F.lit(1.0).alias("weight"), F.lit(1.0).alias("effective_frequency"), F.lit("").alias("entity_group"),
        none.cast("array<float>").alias("context_vector"), uri.alias("full_snapshot_uri"),
        F.lit(False).alias("is_correction"), F.lit(0.0).alias("surprise_score"), at.alias("created_at"),
        none.cast("timestamp").alias("last_accessed_at"), none.cast("timestamp").alias("obsoleted_at"),
        at.alias("occurred_at"))


def delegations(calls: DataFrame, now: datetime | Column, scheme: str = "delegation://") -> DataFrame:
    """Episodes of delegated tasks (project_id, call_id, child_id, task, result); blank tasks are skipped."""
    at = now if isinstance(now, Column) else F.lit(now)
    asked = calls.filter(T.trim_space(F.coalesce("task", F.lit(""))) != "")
    summary = F.concat(F.lit("委派："), F.col("task"), F.lit(" → "), F.coalesce("result", F.lit("")))
    return _user_episode(asked, T.stable_id("delegation", F.col("project_id"), F.col("call_id")), summary,
                         "DELEGATION", V.TRUST_DEFAULT, F.concat(F.lit(scheme), F.col("child_id").cast("string")), at)


def mirror_versions(writes: DataFrame) -> DataFrame:
    """Resolve an ordered feed of add / replace / remove (project_id, target, seq, action, content).

    memory_id names the version an add or replace creates; previous_id is the
    latest earlier pushed version of the target, which replace and remove
    retire. A remove pushes nothing, so a later remove meets the same version.
    """
    target = F.when(F.coalesce("target", F.lit("")) == "", F.lit("memory")).otherwise(F.col("target"))
    known = writes.filter(F.col("action").isin("add", "replace", "remove")).withColumn("target", target)
    pushed = F.when(F.col("action") != "remove", T.stable_id("mirror", F.col("project_id"), F.col("target"), F.col("seq")))
    rows = known.withColumn("memory_id", pushed)
    rows = carry_forward(rows, ["project_id", "target"], "seq", F.col("memory_id"), "previous_id")
    return rows.withColumn("retires", (F.col("action") != "add") & F.col("previous_id").isNotNull())


def mirror_changes(versions: DataFrame, now: datetime | Column, scheme: str = "memory-write://"
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new episodes, retired ids, DERIVED_FROM edges old -> new)."""
    at = now if isinstance(now, Column) else F.lit(now)
    new = versions.filter(F.col("memory_id").isNotNull())
    origin = F.col("origin") if "origin" in versions.columns else F.lit(None).cast("string")
    uri = F.concat(F.lit(scheme), F.col("target"), F.lit("#"), T.entry_hash(F.col("content")), F.lit("?action="),
                   F.col("action"), F.lit("&source=user_explicit"), F.when(
                       F.coalesce(origin, F.lit("")) != "", F.concat(F.lit("&origin="), origin)).otherwise(""))
    episodes = _user_episode(new, F.col("memory_id"), F.col("content"), "USER", V.TRUST_MAX, uri, at)
    retired = versions.filter("retires").select(F.col("previous_id").alias("id")).distinct().withColumn(
        "obsoleted_at", at)
    edges = versions.filter((F.col("action") == "replace") & F.col("retires")).select(
        F.col("previous_id").alias("from_id"), F.col("memory_id").alias("to_id"),
        F.lit("DERIVED_FROM").alias("edge_type"), F.create_map().cast("map<string,string>").alias("properties"),
        at.alias("created_at"))
    return episodes, retired, edges
