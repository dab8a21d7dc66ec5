"""Tables under commits: one small file per version names the folders that hold each project.

A commit replaces the rows of the projects it touches, appends to others, and remembers the last batch
of every source, all by the appearance of one file. Folders are written before and never change, so readers keep
what they have begun with, a failed writer leaves only folders nobody names, and a batch that comes
again is seen to be there. The store must rename within a folder atomically and refuse an existing name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemospark.schemas import TABLES

_LOG, _PROJECT, _NONE = "_commits", "_in", "__HIVE_DEFAULT_PARTITION__"


class CommitConflict(RuntimeError):
    """Another writer committed first; read again and repeat."""


@dataclass(frozen=True)
class Commit:
    """``tables``: table to project to folders below the root; ``batches``: source to the last batch of it."""

    number: int = 0
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> Commit:
    """The newest commit, number 0 where there is none."""
    done = [n for n in _names(spark, f"{root}/{_LOG}") if n.endswith(".json") and n[:-5].isdigit()]
    if not done:
        return Commit()
    return Commit(int(done[-1][:-5]), **json.loads(_text(spark, f"{root}/{_LOG}/{done[-1]}")))


def applied(spark: SparkSession, root: str, source: str) -> int:
    """Number of the last batch of ``source`` that was committed, -1 before the first."""
    return latest(spark, root).batches.get(source, -1)


def read(spark: SparkSession, root: str, table: str, projects: Iterable[str | None] | None = None, commit: Commit | None = None) -> DataFrame:
    """Rows of a table as of a commit (None: the newest); with ``projects`` only their folders are read."""
    held = (commit or latest(spark, root)).tables.get(table, {})
    wanted = held if projects is None else {_name(p) for p in projects} & set(held)
    folders = sorted({f"{root}/{folder}" for name in wanted for folder in held[name]})
    if not folders:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).parquet(*folders)


def _name(project: str | None) -> str:
    """As a folder is named: Spark gives a null and an empty project one folder."""
    return project or _NONE


def _written(spark: SparkSession, root: str, table: str, rows: DataFrame) -> dict[str, str]:
    """Folder of each project of ``rows``, written beside all others."""
    fields = TABLES[table].fields
    folder = f"{table}/{uuid.uuid4().hex}"
    aligned = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    place = F.col("project_id") if "project_id" in TABLES[table].names else F.lit(None).cast("string")
    aligned.withColumn(_PROJECT, place).write.partitionBy(_PROJECT).parquet(f"{root}/{folder}")
    held = [n for n in _names(spark, f"{root}/{folder}") if n.startswith(f"{_PROJECT}=")]
    return {unquote(n[len(_PROJECT) + 1:]): f"{folder}/{n}" for n in held}


def publish(spark: SparkSession, root: str, base: Commit, *, replace: dict[str, DataFrame] | None = None, touched: Iterable[str | None] | None = None,
            append: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None) -> Commit:
    """Commit on top of ``base``, the commit that the rows were made from.

    ``replace`` has all rows of the ``touched`` projects (None: of every project); folders of others stay as they are.
    ``append`` adds rows and leaves folders in place. Tables without a project are one. Raises :class:`CommitConflict` if another
    commit followed ``base``.
    """
    tables = {t: {p: list(f) for p, f in held.items()} for t, held in base.tables.items()}
    gone = None if touched is None else {_name(p) for p in touched}
    for table, rows in (replace or {}).items():
        kept = {} if gone is None else {p: f for p, f in tables.get(table, {}).items() if p not in gone}
        new = _written(spark, root, table, rows)
        if not set(kept).isdisjoint(new):
            raise ValueError(f"rows of projects that weren't named as touched: {sorted(set(kept) & set(new))[:5]}")
        tables[table] = kept | {p: [f] for p, f in new.items()}
    for table, rows in (append or {}).items():
        held = tables.setdefault(table, {})
        for project, folder in _written(spark, root, table, rows).items():
            held[project] = [*held.get(project, []), folder]
    done = Commit(base.number + 1, tables, base.batches | ({batch[0]: batch[1]} if batch else {}))
    _log(spark, root, done)
    return done


def _log(spark: SparkSession, root: str, commit: Commit) -> None:
    """The commit itself: a finished file gets its final name, unless there is one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, draft = _at(spark, f"{root}/{_LOG}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps({"tables": commit.tables, "batches": commit.batches}).encode()))
    finally:
        stream.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/{_LOG}/{commit.number:012d}.json")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(draft).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise CommitConflict(f"commit {commit.number} is taken") from e
        raise


def upsert(spark: SparkSession, root: str, table: str, delta: DataFrame, key: str = "id", batch: tuple[str, int] | None = None) -> Commit:
    """Rows of ``delta`` replace rows of the same project and key; only projects of the delta are read and rewritten."""
    from mnemospark.sources import snapshots

    base = latest(spark, root)
    touched = [r[0] for r in delta.select("project_id").distinct().collect()]
    old = read(spark, root, table, touched, base)
    new = snapshots.upsert(old, delta.select(*old.columns), key)
    return publish(spark, root, base, replace={table: new}, touched=touched, batch=batch)
