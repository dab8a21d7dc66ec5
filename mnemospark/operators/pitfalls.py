"""Pitfall search, workbench views and state changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T, weights as W
from mnemospark.operators.ranking import apply_clamped, clamped_sum, nearest_neighbours, overlap_topk, pinned, top_per_key
from mnemospark.operators.retrieve import pitfall_priority


def pitfall_topk(pitfalls: DataFrame, k: int = 10, *, project_id: str | None = None, language: str | None = None,
                 entity_id: str | None = None, root_cause: str | None = None, min_weight: float = 0.0) -> DataFrame:
    """Structured filter, the k heaviest first."""
    out = pitfalls.filter(F.col("obsoleted_at").isNull())
    for name, value in (("project_id", project_id), ("language", language), ("entity_id", entity_id),
                        ("root_cause_category", root_cause)):
        if value:
            out = out.filter(F.col(name) == value)
    if min_weight > 0:
        out = out.filter(F.col("weight") >= min_weight)
    return out.orderBy(F.desc("weight"), F.asc("id")).limit(max(k, 0))


def by_entity(lookups: DataFrame, pitfalls: DataFrame) -> DataFrame:
    """Active pitfalls of each looked-up (entity_id, project_id)."""
    return lookups.select("entity_id", "project_id").distinct().join(
        pitfalls.filter(F.col("obsoleted_at").isNull()), ["entity_id", "project_id"])


def prioritised(pitfalls: DataFrame, keys: list[str], k: int) -> DataFrame:
    return top_per_key(pitfalls, keys, pitfall_priority(), k)


def vector_search(questions: DataFrame, pitfalls: DataFrame, k: int = 10,
                  threshold: float = V.SAME_INFORMATION_COSINE) -> DataFrame:
    """Signature cosine: with an entity only matches above the threshold, else the best k of the project."""
    active = pitfalls.filter(F.col("obsoleted_at").isNull())
    args = dict(left_id="question_id", left_vector="query_vector", right_vector="signature_embedding")
    open_ended = nearest_neighbours(questions.filter("entity_id = ''"), active, k, **args)
    anchored = nearest_neighbours(questions.filter("entity_id <> ''"), active, k, on=("project_id", "entity_id"),
                                  **args).filter(F.col("similarity") > threshold)
    return open_ended.unionByName(anchored).withColumnsRenamed({"left_id": "question_id", "right_id": "id"})


def recall(questions: DataFrame, pitfalls: DataFrame, k: int = V.PITFALL_TOP, pool: int | None = None
           ) -> DataFrame:
    """Overlap of query and signature, +0.3 per entity reference that names the pitfall's entity.

    Active pitfalls of the project with a weight of at least 0.5 that may be injected;
    with ``pool``, only among its heaviest.
    """
    active = pitfalls.filter(F.col("obsoleted_at").isNull() & (F.col("weight") >= 0.5))
    heavy = active if pool is None else top_per_key(active, ["project_id"], [F.desc("weight"), F.asc("id")], pool, "_pool")
    usable = heavy.filter(W.injectable(F.col("status"), F.col("occurrence_count"), F.col("weight")))
    usable = pinned(usable, grams=T.char_bigrams(F.col("signature"), True)).withColumn("name", F.col("entity_id"))
    q = pinned(questions, grams=T.char_bigrams(F.col("query"), True), refs=T.entity_references(F.col("query")))
    best = overlap_topk(q.withColumn("id", F.col("question_id")), usable, k, per_name=0.3)
    return best.select(F.col("left_id").alias("question_id"), F.col("right_id").alias("id"), "score", "rank")


def workbench(pitfalls: DataFrame, k: int = 20, status: str | None = None, **conditions) -> DataFrame:
    """Summary rows of the k heaviest pitfalls, of one status if given."""
    normal = W.normal_status(F.col("status"))
    rows = pitfall_topk(pitfalls if status is None else pitfalls.filter(normal == status), k, **conditions)
    return rows.withColumns({
        "injectable": W.injectable(F.col("status"), F.col("occurrence_count"), F.col("weight")),
        "interference_rate": W.interference_rate(F.col("times_shown"), F.col("times_suppressed")),
        "status": normal,
    })


def explain(pitfalls: DataFrame, episodic: DataFrame) -> DataFrame:
    """One row per pitfall and source episode; sources that are gone keep their id."""
    sources = pitfalls.select(
        "id", "entity_id", "signature", W.normal_status(F.col("status")).alias("status"),
        F.posexplode_outer("source_episodic_ids").alias("position", "source_id"))
    found = episodic.select(F.col("id").alias("source_id"), F.col("summary").alias("source_summary"))
    return sources.join(found, "source_id", "left")


def set_status(pitfalls: DataFrame, changes: DataFrame, now: datetime | Column) -> DataFrame:
    """Apply the latest (pitfall_id, seq, status) per pitfall. Suppressing also counts
    a suppression and takes the ignored delta, once per suppress event."""
    at = now if isinstance(now, Column) else F.lit(now)
    normal = W.normal_status(F.col("status"))
    per = changes.withColumn("_s", normal).groupBy(F.col("pitfall_id").alias("id")).agg(
        F.max_by("_s", "seq").alias("_status"), F.sum((F.col("_s") == "suppressed").cast("int")).alias("_n"))
    drop = V.PITFALL_DELTAS["ignored"]
    return pitfalls.join(per, "id").withColumns({
        "status": F.col("_status"), "updated_at": at,
        "times_suppressed": F.greatest(F.lit(0), F.col("times_suppressed") + F.col("_n")).cast("int"),
        "weight": F.when(F.col("_n") > 0, W.clamp01(F.col("weight") + drop * F.col("_n"))).otherwise(F.col("weight")),
    }).drop("_status", "_n")


def apply_pitfall_feedback(pitfalls: DataFrame, feedback: DataFrame) -> DataFrame:
    """Adopted / ignored / recurred in seq order, weight clamped after each event."""
    valid = feedback.filter(F.col("action").isin(V.PITFALL_FEEDBACK)).select(
        F.col("pitfall_id").alias("id"), "seq", "action", W.pitfall_delta(F.col("action")).alias("delta"))
    steps = clamped_sum(valid, "id", "seq", "delta")
    counts = valid.groupBy("id").agg(
        F.sum((F.col("action") == "adopted").cast("int")).alias("_adopted"),
        F.sum((F.col("action") == "recurred").cast("int")).alias("_recurred"))
    return pitfalls.join(steps, "id").join(counts, "id").withColumns({
        "weight": apply_clamped(F.col("weight"), F.col("shift"), F.col("floor"), F.col("ceiling")),
        "times_adopted": (F.col("times_adopted") + F.col("_adopted")).cast("int"),
        "protection_level": F.least(F.lit(V.PROTECTION_MAX), F.col("protection_level") + F.col("_recurred")).cast("int"),
    }).drop("shift", "floor", "ceiling", "events", "_adopted", "_recurred")


def record_shown(pitfalls: DataFrame, shown: DataFrame) -> DataFrame:
    """+1 per time a pitfall (column id) was surfaced."""
    counts = shown.groupBy("id").agg(F.count("*").alias("_n"))
    return pitfalls.join(counts, "id").withColumn(
        "times_shown", F.greatest(F.lit(0), F.col("times_shown") + F.col("_n")).cast("int")).drop("_n")


def touch_pitfalls(pitfalls: DataFrame, touches: DataFrame) -> DataFrame:
    """Later of the known and the touched time, occurrence + 1 per touch (id, at)."""
    per = touches.groupBy("id").agg(F.max("at").alias("_at"), F.count("*").alias("_n"))
    return pitfalls.join(per, "id").withColumns({
        "last_occurred_at": F.greatest("last_occurred_at", "_at"),
        "occurrence_count": (F.col("occurrence_count") + F.col("_n")).cast("int"),
    }).drop("_at", "_n")


def relink(pitfalls: DataFrame, links: DataFrame, now: datetime | Column) -> DataFrame:
    """Re-anchor (id, entity_id[, entity_type]); an empty type keeps the old one."""
    at = now if isinstance(now, Column) else F.lit(now)
    new = links.select("id", F.col("entity_id").alias("_e"), F.col("entity_type").alias("_t"))
    return pitfalls.join(new, "id").withColumns({
        "entity_id": F.col("_e"), "updated_at": at,
        "entity_type": F.when(F.coalesce("_t", F.lit("")) == "", F.col("entity_type")).otherwise(F.col("_t")),
    }).drop("_e", "_t")


def set_fields(table: DataFrame, delta: DataFrame, *columns: str) -> DataFrame:
    """Rows named in ``delta`` (id, columns...) with those columns replaced."""
    new = delta.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    out = table.join(new, "id")
    return out.withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
