"""Micro-batches that change tables exactly once: write batches and consolidation of closed windows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark import fixed_values as V
from mnemospark.functions import vectors as X
from mnemospark.operators.ranking import durable
from mnemospark.plans import pipelines
from mnemospark.schemas import TABLES
from mnemospark.sources import commits


def _started(stream: DataFrame, apply: Callable[[DataFrame, int], bool], checkpoint: str, available_now: bool, interval: str, mode: str) -> StreamingQuery:
    def whole(batch: DataFrame, batch_id: int) -> None:
        # Once, and also where the batch turns out to be known: state behind it commits only with every partition.
        rows = durable(batch)
        _committed(lambda: apply(rows, batch_id))

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(whole)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def _committed(attempt: Callable[[], bool], tries: int = 8) -> bool:
    """Repeat on top of the newest commit where another stream has committed meanwhile."""
    for left in reversed(range(tries)):
        try:
            return attempt()
        except commits.CommitConflict:
            if not left:
                raise
    return False


def _projects(rows: DataFrame) -> list[str | None]:
    return [r[0] for r in rows.select("project_id").distinct().collect()]


def apply_events(spark: SparkSession, root: str, events: DataFrame, batch_id: int, source: str = "events", clock: Callable[[], datetime] = datetime.now,
                 link: bool = True) -> bool:
    """One micro-batch of gate-passed events: :func:`pipelines.write_batch` against the projects it touches, committed with its number.

    A batch that was committed before is skipped (False). Snapshot, edges, pitfall touches and batch number appear together; if the job dies on the way, none
    does and the batch may come again. An event that comes twice inside a batch counts once.
    """
    base = commits.latest(spark, root)
    if base.batches.get(source, -1) >= batch_id:
        return False
    rows = events.dropDuplicates(["event_id"])
    touched = _projects(rows)
    memories, pitfalls = (commits.read(spark, root, t, touched, base) for t in ("episodic", "pitfall"))
    now = clock()
    result = pipelines.write_batch(rows, memories, pitfalls, now, link=link)
    hits = result.pitfall_touches.groupBy("id").agg(F.max("at").alias("_at"))
    shown = pitfalls.join(hits, "id", "left").withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_at")
    commits.publish(spark, root, base, replace={"episodic": result.memories, "pitfall": shown}, touched=touched, append={"edges": result.edges},
                    batch=(source, batch_id))
    return True


def write_stream(events: DataFrame, root: str, checkpoint: str, source: str = "events", clock: Callable[[], datetime] = datetime.now, link: bool = True,
                 available_now: bool = True, interval: str = "300 seconds") -> StreamingQuery:
    """Write every micro-batch of gate-passed events into the tables under ``root`` exactly once (:func:`apply_events`)."""

    def apply(batch: DataFrame, batch_id: int) -> bool:
        return apply_events(batch.sparkSession, root, batch, batch_id, source, clock, link)

    return _started(events, apply, checkpoint, available_now, interval, "append")


def window_sums(memories: DataFrame, window: str = "24 hours", late: str = "1 hour", at: str = "created_at") -> DataFrame:
    """Additive sums per window, project, task and entity, kept as streaming state until the watermark closes the window.

    Rows later than ``late`` are left out, as a closed window is consolidated already. On a batch table the same sums come at once.
    """
    span = F.window(at, window)
    sums = memories.withWatermark(at, late).groupBy(span.alias("w"), "project_id", "task_type", "entity_group").agg(
        F.count("*").alias("members"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.sum("weight").alias("weight"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in sums.columns if c != "w"])


def worth_consolidating(sums: DataFrame, min_pattern: int = V.PATTERN_MIN_SIZE, min_group: int = 2) -> DataFrame:
    """(window_start, window_end, project_id) with a task pattern or a debug entity of the least size, from the sums alone."""
    keys = ["window_start", "window_end", "project_id"]
    patterns = sums.groupBy(*keys, "task_type").agg(F.sum("members").alias("n")).filter(F.col("n") >= min_pattern)
    groups = sums.filter((F.col("task_type") == "debug") & (F.col("entity_group") != "") & (F.col("members") >= min_group))
    return patterns.select(*keys).unionByName(groups.select(*keys)).distinct()


def apply_windows(spark: SparkSession, root: str, sums: DataFrame, batch_id: int, source: str = "windows", embed: Callable[[Column], Column] = X.keyword_vector,
                  threshold: float = V.BACKTEST_MIN) -> bool:
    """Consolidate the windows that a micro-batch closed; rules, pitfalls, edges, run rows and the batch number are committed together.

    Each window is one run of :func:`pipelines.consolidate` over the projects that the sums single out, as of the end of the window. A run is named
    by its window, so ids don't depend on when or in which batch it closed.
    """
    base = commits.latest(spark, root)
    if base.batches.get(source, -1) >= batch_id:
        return False
    due = durable(worth_consolidating(sums))
    spans = due.select("window_start", "window_end").distinct().orderBy("window_start").collect()
    out: dict[str, DataFrame] = {}
    for start, end in spans:
        projects = _projects(due.filter(F.col("window_start") == F.lit(start)))
        rows = commits.read(spark, root, "episodic", projects, base).filter((F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)))
        done = pipelines.consolidate(rows, run_name(source, start), end, (end - start).total_seconds() / 3600, embed=embed, threshold=threshold)
        parts = {"semantic": done.rules, "pitfall": done.pitfalls, "edges": done.edges, "consolidation_runs": done.run}
        for table, part in parts.items():
            part = part.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
            out[table] = out[table].unionByName(part) if table in out else part
    commits.publish(spark, root, base, append=out, batch=(source, batch_id))
    return True


def run_name(source: str, start: datetime) -> str:
    return f"{source}:{int(start.timestamp())}"


def consolidation_stream(memories: DataFrame, root: str, checkpoint: str, window: str = "24 hours", late: str = "1 hour", source: str = "windows",
                         embed: Callable[[Column], Column] = X.keyword_vector, threshold: float = V.BACKTEST_MIN, available_now: bool = True,
                         interval: str = "300 seconds") -> StreamingQuery:
    """Rolling consolidation: sums per window are state between micro-batches, and every window is consolidated once when the watermark passes its end.

    ``memories`` is a stream of the rows that are written to the episodic table under ``root``.
    """

    def apply(batch: DataFrame, batch_id: int) -> bool:
        return apply_windows(batch.sparkSession, root, batch, batch_id, source, embed, threshold)

    return _started(window_sums(memories, window, late), apply, checkpoint, available_now, interval, "append")
