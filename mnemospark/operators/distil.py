"""Consolidation: recent episodes become rules and pitfalls."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T, vectors as X
from mnemospark.operators import linkage
from mnemospark.operators.ranking import CHUNK, ordered_parts, ordinal, pinned, top_per_key


# --- rules --------------------------------------------------------------------

def pattern_clusters(episodes: DataFrame, min_size: int = V.PATTERN_MIN_SIZE) -> DataFrame:
    """Size of each (project, task_type) group that reaches the minimum."""
    return episodes.groupBy("project_id", "task_type").agg(
        F.count("*").alias("members"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    ).filter(F.col("members") >= min_size)


def rule_text(scan: DataFrame, min_size: int = V.PATTERN_MIN_SIZE) -> DataFrame:
    """One candidate rule per cluster: bulleted summaries in scan order.

    A rule's text holds its whole cluster; bound it by a limit of the scan where that is wanted.
    """
    ordered = F.array_sort(F.collect_list(F.struct("scan_rank", "id", "summary")))
    clusters = scan.groupBy("project_id", "task_type").agg(ordered.alias("_m")).filter(F.size("_m") >= min_size)
    bullets = F.array_join(F.transform("_m", lambda m: F.concat(F.lit("- "), m["summary"])), "\n")
    head = T.filled(V.RULE_HEADING + "\n", F.col("project_id"), F.col("task_type"))
    return clusters.select("project_id", "task_type", F.size("_m").alias("members"),
                           F.concat(head, bullets).alias("content"),
                           F.transform("_m", lambda m: m["id"].cast("string")).alias("source_episodic_ids"))


def _numbered(scan: DataFrame, min_size: int) -> DataFrame:
    """Members of the clusters that reach the minimum, with their number (from 0) in scan order."""
    keys = ["project_id", "task_type"]
    large = scan.groupBy(*keys).count().filter(F.col("count") >= min_size).select(*keys)
    members = scan.select(*keys, F.struct("scan_rank", "id").alias("_at"), "summary").join(large, keys)
    return ordinal(members, keys, "_at", "_n").withColumn("_n", F.col("_n") - 1)


def _in_parts(sections: list[DataFrame], items: int) -> DataFrame:
    """Lines (project_id, task_type, line, _n) of each section in turn, as ordered parts."""
    lines = [s.withColumn("_place", F.struct(F.lit(i).alias("section"), F.col("_n").alias("n"))).select("project_id", "task_type", "_place", "line")
             for i, s in enumerate(sections)]
    whole = lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    return ordered_parts(whole, ["project_id", "task_type"], "_place", "line", items=items)


def _rule_sections(members: DataFrame, lead: str = "") -> list[DataFrame]:
    head = T.filled(lead + V.RULE_HEADING, F.col("project_id"), F.col("task_type"))
    return [members.filter("_n = 0").withColumn("line", head), members.withColumn("line", F.concat(F.lit("- "), F.coalesce("summary", F.lit(""))))]


def rule_parts(scan: DataFrame, min_size: int = V.PATTERN_MIN_SIZE, items: int = CHUNK) -> DataFrame:
    """project_id, task_type, part, items, content, offset: the text of :func:`rule_text` as parts of at most ``items`` lines."""
    return _in_parts(_rule_sections(_numbered(scan, min_size)), items)


def validation_parts(scan: DataFrame, min_size: int = V.PATTERN_MIN_SIZE, sample: int | None = None, items: int = CHUNK) -> DataFrame:
    """The question how well a rule describes its cluster, as ordered parts: the rule, then its members (with ``sample``, the first so many).

    Answers come back through :func:`parse_rule_score`. Clusters of any size: a row holds one part.
    """
    members = _numbered(scan, min_size)
    asked = members if sample is None else members.filter(F.col("_n") < sample)
    one = members.filter("_n = 0")
    return _in_parts([
        *_rule_sections(members, "Candidate rule: "), one.withColumn("line", F.lit("\nNotes it should describe:")),
        asked.withColumn("line", F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.coalesce("summary", F.lit("")))),
        one.withColumn("line", F.lit("\nAnswer with one number from 0 (not at all) to 1 (fully).")),
    ], items)


def backtest(rules: DataFrame, scan: DataFrame, embed: Callable[[Column], Column] = X.keyword_vector) -> DataFrame:
    """Mean cosine between a rule's text and its members; 0.5 without any signal.

    ``embed`` turns a text column into vectors; members that carry a
    context_vector keep it. Copies of a text are embedded once and count as often as they occur.
    """
    ruled = pinned(rules.select("project_id", "task_type", "content"), _rv=embed(F.col("content"))).drop("content")
    stored = F.col("context_vector") if "context_vector" in scan.columns else F.lit(None).cast("array<float>")
    known = F.coalesce(X.has_magnitude(stored), F.lit(False))
    carried = scan.filter(known).select("project_id", "task_type", stored.alias("_mv"), F.lit(1).cast("bigint").alias("_n"))
    copies = scan.filter(~known).groupBy("project_id", "task_type", "summary").agg(F.count("*").alias("_n"))
    texts = pinned(copies, _mv=embed(F.col("summary"))).select("project_id", "task_type", "_mv", "_n")
    signal = X.has_magnitude(F.col("_rv")) & X.has_magnitude(F.col("_mv"))
    members = carried.unionByName(texts) if "context_vector" in scan.columns else texts
    scored = ruled.join(members, ["project_id", "task_type"]).withColumn(
        "_c", F.when(signal, X.cosine(F.col("_rv"), F.col("_mv"))))
    mean = F.sum(F.col("_c") * F.col("_n")) / F.sum(F.when(F.col("_c").isNotNull(), F.col("_n")))
    return scored.groupBy("project_id", "task_type").agg(
        F.coalesce(mean, F.lit(V.BACKTEST_NO_SIGNAL)).alias("backtest_accuracy"))


def persist_rules(rules: DataFrame, run_id: str, now: Column, threshold: float = V.BACKTEST_MIN
                  ) -> tuple[DataFrame, DataFrame]:
    """(semantic rows, DERIVED_FROM edges) of candidate rules that pass the backtest."""
    kept = rules.filter(F.col("backtest_accuracy") >= threshold)
    none = F.lit(None).cast("timestamp")
    semantic = kept.select(
        T.stable_id("rule", F.lit(run_id), F.col("project_id"), F.col("task_type")).alias("id"), "project_id",
        F.lit("PATTERN").alias("type"), "content", F.lit("INFERRED").alias("source_type"),
        F.lit(V.TRUST_DEFAULT).alias("trust_level"), F.lit(1.0).alias("weight"),
        F.lit(1.0).alias("effective_frequency"),
        F.concat_ws(":", F.lit("consolidation"), "project_id", "task_type").alias("entity_group"),
        F.lit(run_id).alias("consolidation_run_id"), "backtest_accuracy", "source_episodic_ids",
        F.lit(0.0).alias("surprise_score"), F.lit(None).cast("array<float>").alias("context_vector"),
        now.alias("created_at"), none.alias("last_accessed_at"), none.alias("obsoleted_at"))
    return semantic, derived_edges(semantic, run_id, now)


def derived_edges(nodes: DataFrame, run_id: str, now: Column) -> DataFrame:
    return nodes.select(
        F.col("id").alias("from_id"), F.explode("source_episodic_ids").alias("to_id"),
        F.lit("DERIVED_FROM").alias("edge_type"), F.create_map(F.lit("run_id"), F.lit(run_id)).alias("properties"),
        now.alias("created_at"))


# --- pitfalls -----------------------------------------------------------------

def entity_groups(scan: DataFrame, cap: int | None = None, min_size: int = 2,
                  cross_project: bool = False) -> DataFrame:
    """Debug episodes per entity in scan order (with ``cap``, the first so many), for entities with at
    least ``min_size``. Adds position and, unless cross_project, groups by project too."""
    keys = ["entity_group"] if cross_project else ["project_id", "entity_group"]
    debug = scan.filter((F.col("task_type") == "debug") & (F.col("entity_group") != ""))
    sizes = debug.groupBy(*keys).agg(F.count("*").alias("group_size")).filter(F.col("group_size") >= min_size)
    order = [F.asc("scan_rank"), F.asc("id")]
    return top_per_key(debug, keys, order, cap, "position").join(sizes, keys)


def _bigrams(s: str) -> frozenset:
    return frozenset([s]) if len(s) == 1 else frozenset(map("".join, zip(s, s[1:])))


def _cluster_group(cosine_floor: float, dice_floor: float):
    """Average-link clustering of one entity's episodes."""

    def overlaps(grams: list[frozenset]) -> np.ndarray:
        code = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
        size = np.array([len(g) for g in grams])
        shared = np.zeros((len(grams), len(grams)), np.float32)
        owner = np.repeat(np.arange(len(grams)), size)
        at = np.array([code[g] for gs in grams for g in gs], np.int64)
        for start in range(0, len(code), 4096):
            part, here = np.zeros((len(grams), 4096), np.float32), (at >= start) & (at < start + 4096)
            part[owner[here], at[here] - start] = 1
            shared += part @ part.T
        return 2.0 * shared.astype(np.float64) / np.maximum(size[:, None] + size[None, :], 1)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position", ignore_index=True)
        n = len(group)
        vectors = [None if v is None or not np.any(v) else np.asarray(v, dtype=np.float64) for v in group["vector"]]
        lex = overlaps([_bigrams(s) for s in group["summary"]])
        there = np.array([v is not None for v in vectors])
        seen = (there[:, None] & there[None, :]).astype(np.float64)
        cos = np.zeros((n, n))
        for size in {len(v) for v in vectors if v is not None}:
            at = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == size])
            x = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in at])
            cos[np.ix_(at, at)] = x @ x.T
        floor = cosine_floor if there.any() else dice_floor
        members = linkage.merged_members(cos, seen, lex, np.ones(n), floor)
        label = {m: (ms[0], p) for ms in members for p, m in enumerate(ms)}
        out = group[["project_id", "entity_group", "id"]].copy()
        out["cluster"] = [group["position"].iloc[label[m][0]] for m in range(n)]
        out["member"] = [label[m][1] for m in range(n)]
        return out

    return run


def cluster_entities(groups: DataFrame, vector: str | None = "context_vector",
                     cosine_floor: float = V.PITFALL_MERGE_COSINE, dice_floor: float = V.PITFALL_MERGE_DICE,
                     task_rows: int = linkage.TASK_ROWS) -> DataFrame:
    """Cluster of each episode of :func:`entity_groups`, named by the position of its first member, and the member's place in it.

    Cosine decides; bigram overlap where no vector of an entity carries a signal. Entities of up to ``task_rows`` episodes are
    clustered by one task each, larger ones in rounds over blocks (:func:`linkage.cluster_rounds`), with the same result.
    """
    v = F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")
    keys = ["project_id", "entity_group"]
    # Read again by every count and by both ways below; the order of a group is sorted out once.
    slim = linkage.durable(groups.select(*keys, F.col("id").cast("string").alias("id"), "position", "summary", v.alias("vector")))
    sizes = slim.groupBy(*keys).agg(F.count("*").alias("_rows"))
    sized = slim.join(sizes, keys)
    small = sized.filter(F.col("_rows") <= task_rows).drop("_rows").groupBy(*keys).applyInPandas(
        _cluster_group(cosine_floor, dice_floor), "project_id string, entity_group string, id string, cluster long, member long")
    large = sized.filter(F.col("_rows") > task_rows).drop("_rows")
    if large.isEmpty():
        return small
    rounds = linkage.cluster_rounds(large, cosine_floor, dice_floor, task_rows=task_rows)
    return small.unionByName(rounds.select(*keys, "id", F.col("root").alias("cluster"), "member"))


def representatives(clusters: DataFrame, keys: tuple[str, ...] = ("project_id", "entity_group", "cluster")) -> DataFrame:
    """Most representative member of each cluster: highest mean overlap with the rest.

    ``clusters`` has keys, id, member, summary; ids are unique. Copies of a text have the same overlaps, so its first member speaks for them; these
    meet in blocks, and each block sends one sum for each of its rows.
    """
    texts = clusters.groupBy(*keys, "summary").agg(
        F.min_by("id", "member").alias("id"), F.min("member").alias("member"), F.count("*").alias("n"))
    rows = linkage.durable(pinned(linkage.durable(texts), grams=T.char_bigrams(F.col("summary"))))
    sums = linkage.overlap_sums(rows.select(*keys, "id", "n", "grams"), list(keys)).withColumnRenamed("id", "_id")
    scored = rows.drop("grams", "n").join(sums, F.col("id") == F.col("_id"))
    best = scored.groupBy(*keys).agg(
        F.max_by(F.struct("id", "summary", "total", "others"), F.struct("total", -F.col("member"))).alias("b"))
    mean = F.col("b.total") / (F.greatest(F.col("b.others"), F.lit(1)) * 1000000.0)
    return best.select(*keys, F.col("b.id").alias("id"), F.col("b.summary").alias("summary"),
                       (F.col("b.others") + 1).alias("size"), mean.alias("mean_overlap"))


def heuristic_pitfalls(clusters: DataFrame, now: Column, min_size: int = 2) -> DataFrame:
    """One pitfall per cluster of at least ``min_size`` episodes (columns of the cluster
    plus project_id, entity_group, language, summary, member)."""
    keys = ["project_id", "entity_group", "cluster"]
    sources = clusters.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("member", "id"))).alias("_m"),
        F.min_by("language", "member").alias("language")).filter(F.size("_m") >= min_size)
    rep = representatives(clusters).select(*keys, F.col("summary").alias("_rep"))
    none = F.lit(None)
    signature = F.concat(F.col("entity_group"), F.lit(": "), F.col("_rep"))
    return sources.join(rep, keys).select(
        T.stable_id("pitfall", F.col("project_id"), F.col("entity_group"), signature).alias("id"),
        F.col("entity_group").alias("entity_id"), T.infer_entity_type(F.col("entity_group")).alias("entity_type"),
        "project_id", "language", signature.alias("signature"),
        none.cast("array<float>").alias("signature_embedding"), F.lit("UNKNOWN").alias("root_cause_category"),
        F.col("_rep").alias("fix_strategy"), F.lit(False).alias("was_user_corrected"),
        F.size("_m").alias("occurrence_count"), none.cast("timestamp").alias("last_occurred_at"),
        F.lit("INFERRED").alias("source_type"), F.lit(2).alias("trust_level"), F.lit(1.0).alias("weight"),
        now.alias("created_at"), now.alias("updated_at"), none.cast("timestamp").alias("obsoleted_at"),
        F.transform("_m", lambda m: m["id"]).alias("source_episodic_ids"), F.lit("proposed").alias("status"),
        *[F.lit(0).alias(c) for c in ("times_shown", "times_suppressed", "times_adopted", "protection_level")],
        F.col("cluster").alias("position"))


def dedup_pitfalls(pitfalls: DataFrame, floor: float = V.PITFALL_DEDUP_COSINE) -> DataFrame:
    """leader_id of each pitfall of one run: cosine of signatures, or equal
    signatures where a vector is missing; never across entities.

    The input is the output of one extraction run: one pitfall per cluster of an entity.
    """
    slim = pitfalls.select("project_id", "entity_id", F.col("id").cast("string").alias("id"), "position", "signature",
                           F.col("signature_embedding").cast("array<double>").alias("vector"))
    return linkage.leaders(slim, ["project_id", "entity_id"], floor)


def merge_pitfalls(pitfalls: DataFrame, leaders: DataFrame) -> DataFrame:
    """Fold each dedup group in position order into one row.

    The base changes to a member whose count exceeds everything merged so far;
    counts add up, sources join, the longest fix (in bytes), the latest
    occurrence and any user correction survive.
    """
    carried = [c for c in pitfalls.columns if c != "position"]
    order = Window.partitionBy("leader_id").orderBy("position", "id")
    before = F.sum("occurrence_count").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = pitfalls.join(leaders, "id").withColumns({"_at": F.row_number().over(order), "_before": before})
    # The first member is the base until another's count exceeds all before it; the sources of a new base stand before the others.
    swap = (F.col("_at") == 1) | F.coalesce(F.col("occurrence_count") > F.col("_before"), F.lit(False))
    turned = placed.withColumn("_swap", swap).withColumn("_place", F.when(F.col("_swap") & (F.col("_at") > 1), -F.col("_at")).otherwise(F.col("_at")))
    sources = F.array_sort(F.collect_list(F.struct("_place", F.col("source_episodic_ids").alias("s"))))
    longest = F.struct(F.coalesce(F.octet_length("fix_strategy"), F.lit(-1)), "_swap", F.when(F.col("_swap"), F.col("_at")).otherwise(-F.col("_at")))
    merged = {
        "occurrence_count": F.sum("occurrence_count").cast(pitfalls.schema["occurrence_count"].dataType),
        "source_episodic_ids": F.flatten(F.transform(sources, lambda x: x["s"])),
        "fix_strategy": F.max_by("fix_strategy", longest),
        "last_occurred_at": F.max("last_occurred_at"),
        "was_user_corrected": F.bool_or("was_user_corrected"),
        "obsoleted_at": F.min_by("obsoleted_at", "_at"),
    }
    base = F.max_by(F.struct(*[c for c in carried if c not in merged]), F.when(F.col("_swap"), F.col("_at")))
    groups = turned.groupBy("leader_id").agg(base.alias("b"), F.count("*").cast("int").alias("merged_members"), *[c.alias(n) for n, c in merged.items()])
    return groups.select(*[F.col(c if c in merged else f"b.{c}") for c in carried], "merged_members")


# --- prompt and response tables -------------------------------------------------

def rule_prompts(scan: DataFrame, min_size: int = V.PATTERN_MIN_SIZE) -> DataFrame:
    """Prompt text per pattern cluster, for an outside inference step."""
    ordered = F.array_sort(F.collect_list(F.struct("scan_rank", "id", "summary")))
    lines = F.transform("_m", lambda m, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), m["summary"], F.lit("\n")))
    head = F.concat(F.lit("Notes of project "), F.col("project_id"), F.lit(", task "), F.col("task_type"), F.lit(":\n"))
    return scan.groupBy("project_id", "task_type").agg(ordered.alias("_m")).filter(F.size("_m") >= min_size).select(
        "project_id", "task_type", F.concat(head, F.array_join(lines, "")).alias("prompt"))


def pitfall_prompts(groups: DataFrame) -> DataFrame:
    """Prompt text per entity group."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "id", "summary")))
    lines = F.transform("_m", lambda m, i: F.concat(
        F.lit("["), i.cast("string"), F.lit("] "), m["summary"], F.lit("\n")))
    n = F.size("_m").cast("string")
    prompt = F.concat(
        T.filled(V.PITFALL_HEADING, F.col("entity_group"), F.col("project_id"), F.coalesce("language", F.lit("")), n),
        F.lit("\n\n"), F.array_join(lines, ""), F.lit("\nName what went wrong repeatedly, why, and how to avoid it.\n"))
    return groups.groupBy("project_id", "entity_group").agg(
        ordered.alias("_m"), F.min_by("language", "position").alias("language")).select(
        "project_id", "entity_group", prompt.alias("prompt"))


_RESPONSE = "signature string, root_cause_category string, fix_strategy string, confidence double"


def strip_fences(raw: Column) -> Column:
    """Drop a leading fence line and everything from the last fence on."""
    text = T.trim_space(raw)
    opened = F.regexp_replace(text, "^```[^\\n]*\\n", "")
    return F.when(text.startswith("```"), T.trim_space(F.regexp_replace(opened, "(?s)```(?!.*```).*$", ""))).otherwise(text)


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """signature, root_cause_category, fix_strategy, confidence, parsed.

    An array gives its most confident element (raised to 0.5 when all are below),
    else a single object, else the outermost braces; an unknown category becomes
    UNKNOWN.
    """
    body = responses.withColumn("_t", strip_fences(F.col(text)))
    array = F.from_json("_t", f"array<struct<{_RESPONSE.replace(' ', ':').replace(',:', ',')}>>")
    inner = F.regexp_extract("_t", "(?s)\\{.*\\}", 0)
    # An array of one is what from_json makes of a bare object, so arrays are told apart by their bracket.
    body = body.withColumn("_a", F.when(F.col("_t").startswith("["), array)).withColumn(
        "_o", F.coalesce(F.when(F.col("_t").startswith("{"), F.from_json("_t", _RESPONSE)), F.from_json(inner, _RESPONSE)))
    best = F.aggregate(F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(1))), F.element_at("_a", 1),
                       lambda acc, x: F.when(x["confidence"] > acc["confidence"], x).otherwise(acc))
    from_array = F.col("_a").isNotNull() & (F.size("_a") > 0)
    pick = body.withColumn("_p", F.when(from_array, F.when(F.size("_a") == 1, F.element_at("_a", 1)).otherwise(best))
                           .otherwise(F.col("_o")))
    confidence = F.coalesce("_p.confidence", F.lit(0.0))
    category = F.col("_p.root_cause_category")
    return pick.withColumns({
        "parsed": F.col("_p").isNotNull() & F.coalesce("_p.signature", "_p.root_cause_category", "_p.fix_strategy",
                                                       F.col("_p.confidence").cast("string")).isNotNull(),
        "signature": F.col("_p.signature"), "fix_strategy": F.col("_p.fix_strategy"),
        "root_cause_category": F.when(category.isin(V.ROOT_CAUSES), category).otherwise(F.lit("UNKNOWN")),
        "confidence": F.when(from_array, F.greatest(confidence, F.lit(0.5))).otherwise(confidence),
    }).drop("_t", "_a", "_o", "_p")


def parse_rule_score(raw: Column) -> Column:
    """Leading number of a validator answer when it lies in [0, 1], else NULL."""
    number = F.regexp_extract(T.trim_space(raw), "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)", 0)
    score = F.when(number != "", number).try_cast("double")
    return F.when(score.between(0.0, 1.0), score)
