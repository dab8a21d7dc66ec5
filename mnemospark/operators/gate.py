"""Significance gate over ordered write events.

The cross-cycle condition looks at the last 20 summaries that passed in the
same project, so each decision depends on earlier ones. The fold keeps only that
ring as state. Events are range-partitioned by (project, seq), which splits a
hot project over many chunks; each chunk is first folded from an empty ring and
tells what it passed itself. One sweep over these lists, 20 summaries a chunk at
most, gives the ring every chunk starts from, however few pass in the chunks before
it; chunks whose ring turns out to differ are folded again. Once no ring changes, the
result equals one sequential pass: the first chunk is right from the start, and a
chunk is right as soon as all before it are. A round is repeated only for what a ring
made pass or fail that then changes later rings.
"""

from __future__ import annotations

import itertools
import logging
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import text as T
from mnemospark.operators.ranking import durable

LOG = logging.getLogger(__name__)

EVENT_COLUMNS = [
    "event_id", "project_id", "seq", "summary", "user_confirmed", "is_correction",
    "caused_behavior_change", "subsequent_reference_count",
]


def static_reason(cycles: Column | int, min_cycles: int = 2, min_refs: int = 2) -> Column:
    """Gate verdict once the number of similar cycles is known."""
    count = F.lit(cycles) if isinstance(cycles, int) else cycles
    return (
        F.when(F.col("user_confirmed"), F.lit("user_confirmed"))
        .when(count >= min_cycles, F.lit("cross_cycle_persistence"))
        .when(F.col("is_correction") | F.col("caused_behavior_change"), F.lit("prediction_error"))
        .when(F.col("subsequent_reference_count") >= min_refs, F.lit("subsequent_reference"))
        .otherwise(F.lit("below_threshold"))
    )


def signal_columns(events: DataFrame, *extra: Column) -> DataFrame:
    """What the fold needs of each event: its static verdict, tokens and unit vector."""
    vector = F.col("context_vector") if "context_vector" in events.columns else F.lit(None).cast("array<float>")
    reset = F.col("reset") if "reset" in events.columns else F.lit(False)
    return events.select(
        "project_id", "seq", "event_id", static_reason(0).alias("alone"),
        T.tokens(F.col("summary")).alias("tokens"), vector.cast("array<double>").alias("vector"),
        F.coalesce(reset, F.lit(False)).alias("reset"), *extra,
    )


class Ring:
    """Last passed summaries of one project as (tokens, vector) pairs."""

    def __init__(self, items=(), size: int = V.WORKING_MEMORY_SIZE):
        self.items = deque(items, maxlen=size)

    @staticmethod
    def item(tokens, vector) -> tuple:
        tokens = list(tokens) if tokens is not None else []
        if vector is None or len(vector) == 0:
            return tokens, None
        v = np.asarray(vector, dtype=np.float64)
        norm = np.linalg.norm(v)
        return tokens, (v / norm if norm > 0 else None)

    def similar(self, item: tuple, cosine: float) -> int:
        tokens, vector = item
        known, n = set(tokens), len(tokens)
        hits = 0
        for other_tokens, other in self.items:
            if vector is not None and other is not None and len(vector) == len(other):
                hits += round(float(vector @ other), 9) >= cosine
            elif n and other_tokens:
                shared = sum(t in known for t in other_tokens)
                hits += shared >= 3 or shared * 10 > 3 * min(n, len(other_tokens))
        return hits

    def decide(self, alone: str, item: tuple, min_cycles: int, cosine: float) -> str:
        reason = alone
        if alone != "user_confirmed" and self.similar(item, cosine) >= min_cycles:
            reason = "cross_cycle_persistence"
        if reason != "below_threshold":
            self.items.append(item)
        return reason

    def rows(self) -> tuple[list, list]:
        return [t for t, _ in self.items], [[] if v is None else v.tolist() for _, v in self.items]


_PASSED = "tokens array<array<string>>, vectors array<array<double>>"
_FOLDED = f"project_id string, chunk int, event_id string, reason string, {_PASSED}, cut boolean"
_RINGS = f"project_id string, chunk int, {_PASSED}"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fold(min_cycles: int, cosine: float):
    """Reason of each event and, per chunk, what it passed since its last reset (``cut``: it had one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ring, own, cut = None, Ring(), Ring(), False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.project_id, row.chunk) != current:
                    if current is not None:
                        out.append((*current, None, None, *own.rows(), cut))
                    current, ring, own, cut = (row.project_id, row.chunk), Ring(), Ring(), False
                if row.kind == 0:
                    # Vectors in a ring have unit length already.
                    ring = Ring((list(t), np.asarray(v, np.float64) if len(v) else None) for t, v in zip(row.ring_tokens, row.ring_vectors))
                    continue
                if row.reset:
                    ring, own, cut = Ring(), Ring(), True
                item = Ring.item(row.tokens, row.vector)
                reason = ring.decide(row.alone, item, min_cycles, cosine)
                if reason != "below_threshold":
                    own.items.append(item)
                out.append((*current, row.event_id, reason, None, None, None))
            yield pd.DataFrame(out, columns=_names(_FOLDED))
        if current is not None:
            yield pd.DataFrame([(*current, None, None, *own.rows(), cut)], columns=_names(_FOLDED))

    return run


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ring that each chunk of a project starts from; rows in order of (project, chunk)."""
    current, ring = None, deque(maxlen=V.WORKING_MEMORY_SIZE)
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.project_id != current:
                current, ring = row.project_id, deque(maxlen=V.WORKING_MEMORY_SIZE)
            out.append((row.project_id, row.chunk, [t for t, _ in ring], [v for _, v in ring]))
            if row.cut:
                ring.clear()
            ring.extend(zip(([*t] for t in row.tokens), ([*v] for v in row.vectors)))
        yield pd.DataFrame(out, columns=_names(_RINGS))


def gate_decisions(events: DataFrame, min_cycles: int = 2, cosine: float = V.SAME_INFORMATION_COSINE,
                   chunks: int | None = None) -> DataFrame:
    """event_id, gate_reason for every event; equals the per-project sequential fold.

    ``events`` has EVENT_COLUMNS and optionally context_vector (cosine decides
    where both sides have one, token overlap otherwise) and reset (clear the
    ring before this event).
    """
    spark = events.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = events.schema["event_id"].dataType.simpleString()
    placed = durable(
        signal_columns(events).withColumn("event_id", F.col("event_id").cast("string"))
        .repartitionByRange(n, "project_id", "seq").withColumn("chunk", F.spark_partition_id())
    )
    nothing = {"ring_tokens": "array<array<string>>", "ring_vectors": "array<array<double>>"}
    rows = placed.withColumn("kind", F.lit(1)).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    keys = ["project_id", "chunk"]

    def fold(subset: DataFrame) -> tuple[DataFrame, DataFrame]:
        grouped = subset.repartition(*keys).sortWithinPartitions(*keys, "kind", "seq")
        folded = durable(grouped.mapInPandas(_fold(min_cycles, cosine), _FOLDED))
        return folded.filter("event_id is not null").select(*keys, "event_id", "reason"), folded.filter("event_id is null").select(*keys, "tokens", "vectors", "cut")

    def replaced(old: DataFrame, new: DataFrame, at: DataFrame) -> DataFrame:
        return durable(old.join(at, keys, "left_anti").unionByName(new))

    decisions, passed = fold(rows)
    used = passed.select(*keys, *[F.array().cast(t).alias(c) for c, t in nothing.items()])
    for turn in itertools.count(1):
        given = passed.repartition("project_id").sortWithinPartitions(*keys).mapInPandas(_sweep, _RINGS)
        given = given.withColumnsRenamed({"tokens": "new_tokens", "vectors": "new_vectors"})
        changed = durable(given.join(used, keys).filter(
            (F.col("new_tokens") != F.col("ring_tokens")) | (F.col("new_vectors") != F.col("ring_vectors"))
        ).select(*keys, F.col("new_tokens").alias("ring_tokens"), F.col("new_vectors").alias("ring_vectors")))
        count = changed.count()
        LOG.info("gate round %d: %d chunks start from another ring", turn, count)
        if not count:
            break
        entry = changed.withColumns({"seq": F.lit(-1).cast("bigint"), "kind": F.lit(0)})
        at = changed.select(*keys)
        again = rows.join(at, keys, "left_semi")
        newly, now_passed = fold(again.unionByName(entry, allowMissingColumns=True))
        decisions, passed, used = replaced(decisions, newly, at), replaced(passed, now_passed, at), replaced(used, changed, at)
    return decisions.select(F.col("event_id").cast(id_type).alias("event_id"), F.col("reason").alias("gate_reason"))


def significance_gate(events: DataFrame, mode: str = "on", **options) -> DataFrame:
    """Events with gate_reason and should_persist. ``mode='off'`` confirms everything."""
    if mode == "off":
        judged = events.withColumn("gate_reason", F.lit("user_confirmed"))
    else:
        judged = events.join(gate_decisions(events, **options), "event_id")
    return judged.withColumn("should_persist", F.col("gate_reason") != "below_threshold")


def gate_counts(judged: DataFrame, *keys: str) -> DataFrame:
    return judged.groupBy(*keys, "gate_reason").agg(
        F.count("*").alias("n"), F.sum(F.col("should_persist").cast("bigint")).alias("persisted"))
