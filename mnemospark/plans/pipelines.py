"""Whole jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T, vectors as X, weights as W
from mnemospark.operators import context, distil, evolve, linkage, pitfalls as P, retrieve, risk, write
from mnemospark.operators.ranking import durable
from mnemospark.sources import snapshots


@dataclass
class WriteResult:
    """Next episodic snapshot, new edges, pitfall touches and one row per event."""

    memories: DataFrame
    edges: DataFrame
    pitfall_touches: DataFrame
    outcomes: DataFrame


def write_batch(events: DataFrame, memories: DataFrame, pitfalls: DataFrame, now: datetime, link: bool = True
                ) -> WriteResult:
    """Gate-passed events against a snapshot, then among the new rows.

    ``events``: event_id, project_id, seq, language, task_type, entity_group,
    summary, context_vector, is_correction, surprise_score, occurred_at. Order
    of effects: judgement of every pair (:func:`write.judge`), supersession, merge or create, boost, links. The second
    pass does the same among the new rows (:func:`write.batch_joins`); a new row that
    joined another isn't superseded by itself.
    """
    at = F.lit(now)
    carriers = events.withColumn("id", F.col("event_id").cast("string")).withColumn("created_at", at)
    told = durable(write.directed(carriers))
    found = durable(write.judge(told, memories, settled=True))
    by_id = carriers.withColumn("event_id", F.col("id"))
    targets = durable(write.merge_found(found).withColumnRenamed("new_id", "event_id").join(by_id.select("event_id", "seq"), "event_id"))
    merged = write.merge_append(memories, by_id, targets, at)

    def created_by(rows: DataFrame) -> DataFrame:
        return write.create_new(rows.join(targets.select("event_id"), "event_id", "left_anti"), at)

    fresh = created_by(by_id)
    keyed = by_id.select("event_id", "seq", "project_id").withColumn(
        "memory_id", T.stable_id("episodic", F.col("project_id"), F.col("event_id")))

    # Second pass: the new rows among themselves, in the order of writing; rows without a vector take no part.
    ordered = durable(created_by(told.withColumn("event_id", F.col("id"))).join(keyed.select(F.col("memory_id").alias("id"), "seq", "event_id"), "id").fillna(
        "", ["language", "entity_group"]))
    newer = durable(write.judge(ordered, ordered, earlier="seq", settled=True).filter("covers"))
    joins = durable(write.batch_joins(ordered, newer.select("new_id", "old_id", F.col("position").alias("new_seq"))))
    joined = joins.select(F.col("memory_id").alias("old_id"))
    later = newer.select("new_id", "old_id").join(joined, "old_id", "left_anti").select("new_id", "old_id")
    # Where all pairs kept of a row are with rows that joined another, it may cover one that didn't.
    unsure = durable(newer.select(F.col("new_id").alias("id")).distinct().join(later.select(F.col("new_id").alias("id")), "id", "left_anti"))
    standing_rows = ordered.join(joined.withColumnRenamed("old_id", "id"), "id", "left_anti")
    if not unsure.isEmpty():
        more = write.judge(ordered.join(unsure, "id", "left_semi"), standing_rows, earlier="seq", settled=True).filter("covers")
        later = later.unionByName(more.select("new_id", "old_id"))
    of_event = ordered.select(F.col("id").alias("new_id"), "event_id")

    def by_event(pairs: DataFrame) -> DataFrame:
        return pairs.join(of_event, "new_id").withColumn("new_id", F.col("event_id")).drop("event_id")

    inner = durable(joins.join(keyed.select("memory_id", "event_id", "seq"), "memory_id"))
    standing = fresh.join(inner.select(F.col("memory_id").alias("id")), "id", "left_anti")
    grown = write.merge_append(standing, by_id, inner.select("event_id", "seq", "id", "similarity"), at)

    home = (targets.select("event_id", F.col("id").alias("carrier"), F.lit("updated_existing").alias("merge_action"))
            .unionByName(inner.select("event_id", F.col("id").alias("carrier"), F.lit("updated_existing").alias("merge_action"))))
    home = durable(keyed.join(home, "event_id", "left").select(
        "event_id", "project_id", F.coalesce("carrier", "memory_id").alias("memory_id"),
        F.coalesce("merge_action", F.lit("created_new")).alias("merge_action")))

    def at_home(pairs: DataFrame) -> DataFrame:
        return pairs.join(home.select(F.col("event_id").alias("new_id"), "memory_id"), "new_id").withColumn("new_id", F.col("memory_id"))

    def created_with(columns: list[str]) -> DataFrame:
        return snapshots.upsert(standing.select(*columns), grown.select(*columns))

    def written(columns: list[str]) -> DataFrame:
        return snapshots.upsert(memories.select(*columns), merged.select(*columns)).unionByName(created_with(columns))

    # Few pairs tell what is retired and boosted, and weights are found without moving texts; the edges, which are all pairs, come from a judgement of their own.
    few = durable(at_home(found.filter("covers").select("new_id", "old_id").unionByName(by_event(later))))
    retired, boosted = evolve.update_effects(few, written(["id", "weight"]), at)

    def settled_rows(columns: list[str]) -> DataFrame:
        return snapshots.obsolete(snapshots.patch(written(columns), boosted), retired, at)

    columns = memories.columns
    next_rows = settled_rows(columns)
    covered = write.covered_found(write.judge(told, memories))
    among = write.covered_found(write.judge(ordered, standing_rows, earlier="seq")).join(ordered.select(F.col("id").alias("new_id"), F.col("seq").alias("new_seq")), "new_id")
    superseded = evolve.superseded_edges(at_home(covered.unionByName(by_event(among).select(*covered.columns))), at)

    edges = superseded
    touches = pitfalls.select("id", F.lit(None).cast("timestamp").alias("at")).limit(0)
    if link:
        new_rows = created_with(columns)
        related = write.related_links(new_rows, next_rows)
        hits = write.triggered_pitfalls(new_rows, pitfalls)
        edges = (edges
                 .unionByName(write.as_edges(related, at, strength=F.col("strength"), dimension=F.lit("SEMANTIC")))
                 .unionByName(write.as_edges(hits, at, similarity=F.lit(0.0))))
        touches = hits.select(F.col("to_id").alias("id"), at.alias("at"))
    weighed = settled_rows(["id", "weight", "obsoleted_at"])
    outcomes = home.join(weighed.select(F.col("id").alias("memory_id"), "weight"), "memory_id").select(
        "event_id", "project_id", "memory_id", "merge_action", "weight")
    return WriteResult(next_rows, edges, touches, outcomes)


def answer(questions: DataFrame, memories: DataFrame, pitfalls: DataFrame, now: datetime,
           k: int = V.EPISODE_TOP, max_tokens: int = V.CONTEXT_TOKENS, surprise_boost: float = 0.25) -> DataFrame:
    """Context block per question (question_id, project_id, question, query_vector)."""
    ready = expand_questions(questions, now)
    ranked = retrieve.newest_first(
        retrieve.rrf_topk(ready, memories, k, surprise_boost=surprise_boost)
        .join(ready.select("question_id", "sort_newest"), "question_id"), F.col("sort_newest"))
    episodes = ranked.select("question_id", "id", F.col("display_rank").alias("rank")).join(
        memories.select("id", "summary", "language"), "id")
    recalled = P.recall(questions.withColumn("query", F.col("question")), pitfalls)
    advice = recalled.select("question_id", "id", "rank").join(pitfalls, "id")
    return context.context_blocks(episodes, advice, max_tokens)


def expand_questions(questions: DataFrame, now: datetime) -> DataFrame:
    """Adds the expanded query and the implied time window."""
    window = T.relative_time(F.col("question"), now)
    return questions.withColumns({"query": T.expand_query(F.col("question")), "_w": window}).withColumns({
        "occurred_after": F.col("_w.after"), "occurred_before": F.col("_w.before"),
        "sort_newest": F.col("_w.sort_newest")}).drop("_w")


def edit_context(requests: DataFrame, files: DataFrame, memories: DataFrame, pitfalls: DataFrame, now: datetime
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(risk per request, surfaced pitfalls, next pitfall counters) of planned edits.

    ``requests``: question_id, project_id, goal, query_vector. ``files``:
    question_id, path, size_bytes. The query is the goal followed by the paths.
    """
    paths = files.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("_p"))
    asked = requests.join(paths, "question_id", "left").withColumn(
        "question", T.trim_space(F.concat_ws(" ", "goal", "_p"))).drop("_p")
    ready = expand_questions(asked, now)
    episodes = retrieve.rrf_topk(ready, memories, V.EPISODE_TOP, surprise_boost=0.25)
    matches = P.recall(asked.withColumn("query", F.col("question")), pitfalls)
    shares = risk.contributions(matches, pitfalls, now)
    complexity = risk.module_complexity(files)
    scores = risk.risk_scores(requests.select("question_id").join(complexity, "question_id", "left"), shares, episodes)
    surfaced = risk.top_contributions(shares)
    return scores, surfaced, P.record_shown(pitfalls, surfaced.select("id"))


@dataclass
class Consolidation:
    rules: DataFrame
    pitfalls: DataFrame
    edges: DataFrame
    run: DataFrame


def consolidate(memories: DataFrame, run_id: str, now: datetime, hours: float = 24.0,
                limit: int | None = None, embed: Callable[[Column], Column] = X.keyword_vector,
                threshold: float = V.BACKTEST_MIN) -> Consolidation:
    """Recent scan, then rules and pitfalls from the same scan, edges and the run row."""
    at = F.lit(now)
    since = at - F.expr(f"interval {int(hours * 3600)} seconds")
    scan = linkage.durable(retrieve.recent_scan(memories, since, limit))  # a table: each step reads only its columns
    candidates = durable(distil.rule_text(scan))
    tested = durable(candidates.join(distil.backtest(candidates, scan, embed), ["project_id", "task_type"]))
    rules, rule_edges = distil.persist_rules(tested, run_id, at, threshold)

    groups = distil.entity_groups(scan)
    clusters = durable(distil.cluster_entities(groups))
    described = clusters.join(scan.select(F.col("id").cast("string").alias("id"), "summary", "language"), "id")
    extracted = distil.heuristic_pitfalls(described, at).withColumn(
        "signature_embedding", embed(F.col("signature")))
    extracted = durable(extracted)
    merged = durable(distil.merge_pitfalls(extracted, distil.dedup_pitfalls(extracted)))
    kept = merged.drop("merged_members")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    cluster_total = clusters.select("project_id", "entity_group", "cluster").distinct()
    found = count(tested, "_c").crossJoin(count(cluster_total, "_p")).select(
        (F.col("_c") + F.col("_p")).alias("candidate_rules_found"))
    parts = [
        count(scan, "episodics_scanned"), found,
        rules.agg(F.count("*").alias("rules_persisted"), F.avg("backtest_accuracy").alias("average_accuracy")),
        count(extracted, "pitfalls_extracted"),
        merged.agg(F.coalesce(F.sum(F.col("merged_members") - 1), F.lit(0)).alias("pitfalls_merged"),
                   F.count("*").alias("pitfalls_persisted")),
    ]
    run = parts[0]
    for part in parts[1:]:  # every part is a single row
        run = run.crossJoin(part)
    none = F.lit(None).cast("string")
    run = run.select(
        F.lit(run_id).alias("run_id"), at.alias("started_at"), at.alias("completed_at"), "episodics_scanned",
        "candidate_rules_found", "rules_persisted", "pitfalls_extracted", "pitfalls_merged", "pitfalls_persisted",
        F.coalesce("average_accuracy", F.lit(0.0)).alias("average_accuracy"), none.alias("rules_error"),
        none.alias("pitfall_error"))
    edges = rule_edges.unionByName(distil.derived_edges(kept, run_id, at))
    return Consolidation(rules, kept, edges, run)
