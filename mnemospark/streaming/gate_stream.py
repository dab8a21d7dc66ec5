"""The significance gate as a stateful stream, deduplicated ingest and rolling counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemospark import fixed_values as V
from mnemospark.operators.gate import Ring, signal_columns

_DECISION = "project_id string, event_id string, seq bigint, gate_reason string, payload string"
_STATE = "tokens array<string>, vector array<double>"


class GateProcessor(StatefulProcessor):
    """Ring of the last passed summaries per project. Rows of a project are judged in
    seq order inside a micro-batch; across micro-batches arrival decides."""

    def __init__(self, min_cycles: int = 2, cosine: float = V.SAME_INFORMATION_COSINE):
        self._min_cycles, self._cosine = min_cycles, cosine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._ring = handle.getListState("ring", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ring = Ring(Ring.item(t, v) for t, v in self._ring.get()) if self._ring.exists() else Ring()
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", ignore_index=True)
        reasons = []
        for row in batch.itertuples(index=False):
            if row.reset:
                ring = Ring()
            reasons.append(ring.decide(row.alone, Ring.item(row.tokens, row.vector), self._min_cycles, self._cosine))
        tokens, vectors = ring.rows()
        if tokens:
            self._ring.put(list(zip(tokens, vectors)))
        else:  # a list state cannot hold an empty list
            self._ring.clear()
        yield pd.DataFrame({"project_id": key[0], "event_id": batch["event_id"], "seq": batch["seq"],
                            "gate_reason": reasons, "payload": batch["payload"]})

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame, min_cycles: int = 2, cosine: float = V.SAME_INFORMATION_COSINE) -> DataFrame:
    """Streaming decisions; a row with reset = true clears its project's ring first, a column payload is handed on.

    Needs the RocksDB state store provider.
    """
    payload = F.col("payload") if "payload" in events.columns else F.lit(None).cast("string")
    rows = signal_columns(events, payload.alias("payload")).withColumns({
        "event_id": F.col("event_id").cast("string"), "seq": F.col("seq").cast("bigint")})
    return rows.groupBy("project_id").transformWithStateInPandas(
        GateProcessor(min_cycles, cosine), outputStructType=_DECISION, outputMode="Append", timeMode="None")


def passed_events(events: DataFrame, **options) -> DataFrame:
    """All columns of the events that pass the gate, and gate_reason; a stream for :func:`sinks.write_stream`."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    judged = gate_stream(events.withColumn("payload", F.to_json(F.struct(*events.columns), exact)), **options)
    return judged.filter(F.col("gate_reason") != "below_threshold").select(
        F.from_json("payload", events.schema, exact).alias("e"), "gate_reason").select("e.*", "gate_reason")


def ingest_stream(raw: DataFrame, remembered: str = "24 hours") -> DataFrame:
    """Drop records whose (source_uri, content_hash) was seen within ``remembered`` of their modified_at.

    Keys are state that expires by event time, so the remembered set stays level however long the stream runs; a record
    that comes back later is new to the stream and met by the batch dedup (``files.unseen``) instead.
    """
    return raw.withWatermark("modified_at", remembered).dropDuplicatesWithinWatermark(["source_uri", "content_hash"])


def live_counts(memories: DataFrame, window: str = "24 hours", slide: str | None = None, late: str = "1 hour"
                ) -> DataFrame:
    """Rolling counts per project and task; later rows are left to batch consolidation."""
    span = F.window("occurred_at", window, slide) if slide else F.window("occurred_at", window)
    return memories.withWatermark("occurred_at", late).groupBy(span.alias("w"), "project_id", "task_type").agg(
        F.count("*").alias("members")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "project_id", "task_type", "members")
