"""The commit log of a stored table: a small file per version that says which folders hold each Japan day.

A commit adds folders, or puts new ones in the place of some days; all other days keep theirs, so a change costs what it
touches. Readers see a version whole or not at all. A commit names the stream and micro-batch it came from: a batch that runs
again finds itself done. A stream that is started with a new checkpoint folder is a new one and goes on from the
newest version. One writer at a time per table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger import schema
from teleledger.functions import clock

DAY = "day"
#: Folders of one day that readers open; beyond it ``compact`` makes one of them.
MOST_FOLDERS = 32
_LOG = "_commits"
Transaction = tuple[str, int]


@dataclass(frozen=True)
class Commit:
    version: int
    days: dict[str, list[str]] = field(default_factory=dict)  # folders below the table's, by day; "" if it has no days
    done: dict[str, int] = field(default_factory=dict)  # the last micro-batch of each stream

    def holds(self, txn: Transaction | None) -> bool:
        return txn is not None and self.done.get(txn[0], -1) >= txn[1]


def laid_out(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """Rows with their day, in evenly sized files: small days are put together, a huge day is split."""
    time = schema.PARTITION_TIME.get(name)
    if time is None:
        return df.hint("rebalance"), []
    dated = df.withColumn(DAY, clock.jst_date(F.col(time), clock.is_wall_clock(df, time)))
    return dated.hint("rebalance", DAY), [DAY]


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def names_in(spark: SparkSession, path: str) -> list[str]:
    system, target = _files(spark, path)
    return [x.getPath().getName() for x in system.listStatus(target)] if system.exists(target) else []


def newest(spark: SparkSession, root: str, name: str) -> int | None:
    found = [int(x.split(".")[0]) for x in names_in(spark, f"{root}/{name}/{_LOG}") if x.endswith(".json") and x[0].isdigit()]
    return max(found, default=None)


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> Commit | None:
    """A version of the table, the newest if none is given."""
    at = newest(spark, root, name) if version is None else version
    if at is None:
        return None
    path = f"{root}/{name}/{_LOG}/{at:010d}.json"
    system, target = _files(spark, path)
    if not system.exists(target):
        return None
    return Commit(**json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))


def _publish(spark: SparkSession, root: str, name: str, commit: Commit) -> Commit:
    folder = f"{root}/{name}/{_LOG}"
    text = json.dumps({"version": commit.version, "days": commit.days, "done": commit.done})
    system, half = _files(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = system.create(half)
    out.write(bytearray(text.encode()))
    out.close()
    _, whole = _files(spark, f"{folder}/{commit.version:010d}.json")
    if system.exists(whole) or not system.rename(half, whole):
        raise RuntimeError(f"{name} version {commit.version} was written by somebody else")
    return commit


def adopt(spark: SparkSession, root: str, name: str, version: int, folder: str) -> Commit:
    """A snapshot that was written as a folder, as a commit to go on from."""
    return Commit(version, _days_of(spark, root, name, folder))


def _days_of(spark: SparkSession, root: str, name: str, folder: str) -> dict[str, list[str]]:
    if schema.PARTITION_TIME.get(name) is None:
        return {"": [folder]}
    return {x.split("=", 1)[1]: [folder] for x in names_in(spark, f"{root}/{name}/{folder}") if x.startswith(f"{DAY}=")}


def _write(df: DataFrame, root: str, name: str) -> dict[str, list[str]]:
    folder = f"parts/{uuid.uuid4().hex}"
    rows, by = laid_out(df, name)
    rows.write.partitionBy(*by).parquet(f"{root}/{name}/{folder}")
    return _days_of(df.sparkSession, root, name, folder)


def _base(spark: SparkSession, root: str, name: str, base: Commit | None) -> Commit:
    return load(spark, root, name) or base or Commit(-1)


def _next(base: Commit, days: dict[str, list[str]], txn: Transaction | None) -> Commit:
    return Commit(base.version + 1, days, {**base.done, **({txn[0]: txn[1]} if txn else {})})


def append(df: DataFrame, root: str, name: str, txn: Transaction | None = None, base: Commit | None = None) -> Commit:
    """Add rows. ``base``: what to go on from if the log has nothing yet."""
    spark = df.sparkSession
    now = _base(spark, root, name, base)
    if now.holds(txn):
        return now
    days = {d: list(x) for d, x in now.days.items()}
    for day, made in _write(df, root, name).items():
        days.setdefault(day, []).extend(made)
    return _publish(spark, root, name, _next(now, days, txn))


def merge(updated: DataFrame, inserted: DataFrame, root: str, name: str, txn: Transaction | None = None,
          base: Commit | None = None) -> Commit:
    """Put ``updated`` rows in the place of those with their id and add ``inserted``; only days that lose a row are written anew."""
    spark = updated.sparkSession
    now = _base(spark, root, name, base)
    if now.holds(txn):
        return now
    rows = read(spark, root, name, now, updated.schema["id"].dataType)
    dated, _ = laid_out(rows, name)
    hit = dated.join(updated.select("id"), "id", "left_semi").select(F.col(DAY).cast("string").alias(DAY)).distinct()
    touched = {r[DAY] for r in hit.collect()}  # days, as many as the calendar has
    kept = read(spark, root, name, Commit(now.version, {d: x for d, x in now.days.items() if d in touched}), updated.schema["id"].dataType)
    kept = kept.join(updated.select("id"), "id", "left_anti")
    made = _write(kept.unionByName(updated).unionByName(inserted), root, name)
    days = {d: list(x) for d, x in now.days.items() if d not in touched}
    for day, folders in made.items():
        days.setdefault(day, []).extend(folders)
    return _publish(spark, root, name, _next(now, days, txn))


def compact(spark: SparkSession, root: str, name: str, id_type, most: int = MOST_FOLDERS) -> Commit | None:
    """Write days of very many folders anew as one; rows stay as they are."""
    now = load(spark, root, name)
    many = {d: x for d, x in now.days.items() if len(x) > most} if now else {}
    if not many:
        return now
    made = _write(read(spark, root, name, Commit(now.version, many), id_type), root, name)
    return _publish(spark, root, name, _next(now, {**now.days, **made}, None))


def _within(days: Iterable[str], from_: str | datetime | None, to: str | datetime | None) -> list[str]:
    first = clock.jst_day(from_) if from_ else None
    last = clock.jst_day(to) + timedelta(days=1) if to else None

    def fits(day: str) -> bool:
        try:
            at = date.fromisoformat(day)
        except ValueError:  # no day, or rows without a time
            return day == "" or not (first or last)
        return (first is None or at >= first) and (last is None or at <= last)

    return [d for d in days if fits(d)]


def read(spark: SparkSession, root: str, name: str, commit: Commit, id_type, from_: str | datetime | None = None,
         to: str | datetime | None = None) -> DataFrame:
    """The rows of a version; days out of bounds are not opened."""
    fields = schema.TABLES[name](id_type)
    paths = [f"{root}/{name}/{folder}" + (f"/{DAY}={day}" if day else "") for day in _within(commit.days, from_, to) for folder in commit.days[day]]
    return spark.read.schema(fields).parquet(*paths) if paths else spark.createDataFrame([], fields)
