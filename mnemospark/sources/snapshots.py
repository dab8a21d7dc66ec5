"""Versioned parquet snapshots: jobs read one version and write the next."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemospark.schemas import TABLES

_PARTITIONED = {"episodic", "semantic", "pitfall"}


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """Complete versions of a table, oldest first; Spark's success marker is the commit."""
    fs, base = _fs(spark, f"{root}/{table}")
    if not fs.exists(base):
        return []
    found = []
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(_fs(spark, f"{root}/{table}/{name}/_SUCCESS")[1]):
            found.append(int(name[1:]))
    return sorted(found)


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table at a version (default: the latest complete one), empty if it has none."""
    known = versions(spark, root, table)
    if not known:
        return spark.createDataFrame([], TABLES[table])
    chosen = known[-1] if version is None else version
    rows = spark.read.schema(TABLES[table]).parquet(f"{root}/{table}/v{chosen:08d}")
    return rows.select(*TABLES[table].names)


def write(df: DataFrame, root: str, table: str) -> int:
    """Write the next version and return its number. The version being read is never touched.

    Fails if another writer has begun the same version, whose rows would be lost otherwise.
    """
    spark = df.sparkSession
    known = versions(spark, root, table)
    version = known[-1] + 1 if known else 1
    aligned = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
    writer = aligned.write.mode("errorifexists")
    if table in _PARTITIONED:
        writer = writer.partitionBy("project_id")
    writer.parquet(f"{root}/{table}/v{version:08d}")
    return version


def upsert(base: DataFrame, delta: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """Rows of ``delta`` replace rows of ``base`` with the same key.

    Several delta rows of one key are settled by ``order`` (highest wins). Only the delta is
    aggregated; the base is filtered by an anti join on the keys, which Spark broadcasts when
    they are few, so a small delta doesn't move the base.
    """
    columns = base.columns
    rank = order if order is not None else F.lit(0)
    latest = delta.select(F.struct(*columns).alias("_r"), rank.alias("_o")).groupBy(F.col(f"_r.{key}").alias("_k")).agg(F.max_by("_r", "_o").alias("_r"))
    kept = base.join(latest.select(F.col("_k").alias("_replaced")), base[key].eqNullSafe(F.col("_replaced")), "left_anti")
    return kept.select(*columns).unionByName(latest.select("_r.*"))


def patch(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite the columns ``delta`` carries where its key matches."""
    columns = [c for c in delta.columns if c != key]
    renamed = delta.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(renamed, key, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in base.columns])


def delete_project(table: DataFrame, projects: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, deleted count per project)."""
    gone = F.col("project_id").isin(projects)
    return table.filter(~F.coalesce(gone, F.lit(False))), table.filter(gone).groupBy("project_id").agg(
        F.count("*").alias("deleted"))


def with_event_time(memories: DataFrame) -> DataFrame:
    """Fill a missing event time from the creation time."""
    return memories.withColumn("occurred_at", F.coalesce("occurred_at", "created_at"))


def obsolete(base: DataFrame, retired: DataFrame, at: datetime | Column) -> DataFrame:
    """Mark the given ids obsolete; an earlier mark stays."""
    when = at if isinstance(at, Column) else F.lit(at)
    ids = retired.select("id").distinct().withColumn("_hit", F.lit(True))
    return base.join(ids, "id", "left").withColumn(
        "obsoleted_at", F.coalesce("obsoleted_at", F.when(F.col("_hit"), when))).drop("_hit").select(*base.columns)
