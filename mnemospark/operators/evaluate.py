"""Rates over logged outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemospark import fixed_values as V


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def arm_rates(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Error reduction, injection quality and cost of logged edits per key.

    One row per edit: baseline_error, generic_error, memory_error, injected,
    useful, suppressed (booleans).
    """
    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0))

    sums = outcomes.groupBy(*keys).agg(
        F.count("*").alias("edits"), total("baseline_error").alias("baseline_errors"),
        total("generic_error").alias("generic_errors"), total("memory_error").alias("memory_errors"),
        total("injected").alias("injections"), total("useful").alias("useful_injections"),
        total("suppressed").alias("suppressed_injections"))
    base, edits = F.col("baseline_errors"), F.col("edits")
    overhead = F.col("injections") * V.INJECTION_OVERHEAD
    return sums.withColumns({
        "reduction_rate": _ratio(base - F.col("memory_errors"), base),
        "generic_reduction_rate": _ratio(base - F.col("generic_errors"), base),
        "useful_rate": _ratio(F.col("useful_injections"), F.col("injections")),
        "false_rate": _ratio(F.col("suppressed_injections"), F.col("injections")),
        "time_ratio": _ratio(edits + F.col("memory_errors") + overhead, edits + base),
        "token_overhead": 1 + overhead / F.greatest(F.lit(1), edits),
    })
