"""Edit risk for a table of edit requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from mnemospark import fixed_values as V
from mnemospark.functions import weights as W
from mnemospark.operators.ranking import top_per_key


def module_complexity(files: DataFrame) -> DataFrame:
    """Mean complexity per question_id over (question_id, path, size_bytes)."""
    return files.groupBy("question_id").agg(
        F.avg(W.file_complexity(F.col("size_bytes"))).alias("complexity"), F.count("*").alias("files"))


def contributions(matches: DataFrame, pitfalls: DataFrame, now: datetime | Column, key: str = "question_id") -> DataFrame:
    """Risk share of each injectable pitfall matched to a question (question_id, id).

    Where all questions of a project match alike, ``key`` may be the project: its pitfalls are then weighed once, not once for each question.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    usable = pitfalls.filter(W.injectable(F.col("status"), F.col("occurrence_count"), F.col("weight"))).select(
        "id", "was_user_corrected", "last_occurred_at",
        W.risk_contribution(F.col("occurrence_count"), F.col("trust_level"), F.col("last_occurred_at"), at)
        .alias("contribution"))
    recent = F.unix_micros(at) - F.unix_micros("last_occurred_at") < 7 * 86400000000
    return matches.select(key, "id").join(usable, "id").withColumn(
        "recent", F.coalesce(recent, F.lit(False)))


def top_contributions(contributed: DataFrame, k: int = V.PITFALL_TOP, key: str = "question_id") -> DataFrame:
    return top_per_key(contributed, [key], [F.desc("contribution"), F.asc("id")], k)


def risk_scores(requests: DataFrame, contributed: DataFrame, recalled: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """risk_score and sorted reason_codes per request (question_id, complexity, files and the ``key`` of ``contributed``).

    ``recalled`` holds the question_ids that retrieved at least one episode.
    """
    sums = contributed.groupBy(key).agg(
        F.sum("contribution").alias("_total"), F.bool_or("was_user_corrected").alias("_user"),
        F.bool_or("recent").alias("_recent"), F.max("contribution").alias("_top"))
    joined = requests.join(sums, key, "left")
    if recalled is not None:
        joined = joined.join(recalled.select("question_id").distinct().withColumn("_recall", F.lit(True)),
                             "question_id", "left")
    else:
        joined = joined.withColumn("_recall", F.lit(False))
    complexity = F.coalesce("complexity", F.lit(0.5))
    base = F.least(F.lit(1.0), F.coalesce("_total", F.lit(0.0)))
    codes = F.array_sort(F.array_compact(F.array(
        F.when(F.col("_user"), F.lit("user_corrected")), F.when(F.col("_recent"), F.lit("recent_error")),
        F.when(F.col("_top") >= 0.6, F.lit("high_risk_pitfall")), F.when(F.col("_recall"), F.lit("memory_recall")),
        F.when(F.coalesce("files", F.lit(0)) > 0, F.lit("editing_files")),
        F.when(complexity >= 0.75, F.lit("high_complexity")))))
    return joined.select(
        "question_id", F.least(F.lit(1.0), base * W.complexity_factor(complexity)).alias("risk_score"),
        codes.alias("reason_codes"))
