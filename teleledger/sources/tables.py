"""The stored tables: Parquet snapshots, by version, partitioned by Japan date, and what streams committed since.

A table starts with a snapshot, or with nothing; jobs then add commits, which count on from the snapshot's version.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger import schema
from teleledger.functions import clock
from teleledger.sources import commits

_DATE = commits.DAY


def snapshot_path(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/{name}/version={version:010d}"


def latest_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The newest commit, or else the newest complete snapshot; a half-written one has no success marker."""
    at = commits.newest(spark, root.rstrip("/"), name)
    return _latest_snapshot(spark, root, name) if at is None else at


def _latest_snapshot(spark: SparkSession, root: str, name: str) -> int | None:
    found = sorted((x for x in commits.names_in(spark, f"{root.rstrip('/')}/{name}") if x.startswith("version=")), reverse=True)
    whole = (x for x in found if "_SUCCESS" in commits.names_in(spark, f"{root.rstrip('/')}/{name}/{x}"))
    return next((int(x.split("=")[1]) for x in whole), None)


def base_of(spark: SparkSession, root: str, name: str) -> commits.Commit | None:
    """What the next commit goes on from: the newest one, or the newest snapshot."""
    found = commits.load(spark, root.rstrip("/"), name)
    at = None if found else _latest_snapshot(spark, root, name)
    return found if at is None else commits.adopt(spark, root.rstrip("/"), name, at, f"version={at:010d}")


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None,
               from_: str | datetime | None = None, to: str | datetime | None = None,
               id_type: T.DataType = T.LongType()) -> DataFrame:
    """A stored table with its fixed schema. ``from_`` and ``to`` prune partitions by date; they keep whole days."""
    at = version if version is not None else latest_version(spark, root, name)
    if at is None:
        raise FileNotFoundError(f"no snapshot of {name} under {root}")
    commit = commits.load(spark, root.rstrip("/"), name, at)
    if commit is not None:
        return commits.read(spark, root.rstrip("/"), name, commit, id_type, from_, to)
    fields = schema.TABLES[name](id_type)
    time = schema.PARTITION_TIME.get(name)
    if time is None:
        return spark.read.schema(fields).parquet(snapshot_path(root, name, at))
    stored = T.StructType(fields.fields + [T.StructField(_DATE, T.DateType())])
    rows = spark.read.schema(stored).parquet(snapshot_path(root, name, at))
    if from_:
        rows = rows.filter(F.col(_DATE) >= F.lit(clock.jst_day(from_)))
    if to:
        rows = rows.filter(F.col(_DATE) <= F.lit(clock.jst_day(to) + timedelta(days=1)))
    return rows.drop(_DATE)


def write_snapshot(df: DataFrame, root: str, name: str, version: int, mode: str = "errorifexists") -> str:
    """Write a table as a new version; readers switch once it is complete."""
    path = snapshot_path(root, name, version)
    rows, partitions = commits.laid_out(df, name)
    rows.write.mode(mode).partitionBy(*partitions).parquet(path)
    return path


def append_rows(df: DataFrame, root: str, name: str, version: int) -> None:
    """Append to a snapshot that is open for appends: views and recordings."""
    rows, partitions = commits.laid_out(df, name)
    rows.write.mode("append").partitionBy(*partitions).parquet(snapshot_path(root, name, version))
