"""Registered queries: a DataFrame job over the views and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemospark.workload.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c: Column | str) -> Column:
    """Rounded for comparison; summation order differs between engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c))
