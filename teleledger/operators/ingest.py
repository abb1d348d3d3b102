"""Arrivals end to end: views and recordings come with their program and leave as table rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger.functions import ids, paths, text
from teleledger.operators import recordings as rec
from teleledger.operators.series import Assigned, assign_series
from teleledger.operators.upsert import Upsert, upsert_programs
from teleledger.schema import PROGRAM_FIELDS
from teleledger.session import drop_shuffles

# Fixed value: a view that names no speed.
DEFAULT_SPEED = 1.0


@dataclass(frozen=True)
class ViewsIngested:
    upsert: Upsert
    views: DataFrame


_RECORDING = ["id", "program_id", "file_path", "file_size", "watched_at", "deleted_at", "created_at"]


@dataclass(frozen=True)
class RecordingsIngested:
    upsert: Upsert
    recordings: DataFrame
    assigned: Assigned
    rejected: DataFrame

    def with_series(self) -> DataFrame:
        """The recordings, each with every ``title`` and ``series_id`` its program's arrivals stand for."""
        titles = self.assigned.assigned.select("program_id", "series_id", "title").distinct()
        # Ids do not compress; they are made of the joined rows, not carried to them.
        joined = self.upsert.resolved.join(titles, "program_id")
        return joined.withColumn("id", _recording_id()).select(*_RECORDING, "title", "series_id")


def _recording_id() -> Column:
    return ids.minted(F.lit("recording"), F.col("program_id"), F.col("file_path"), F.col("seq"))


def _program() -> list[Column]:
    return [F.col(f"program.{f}").alias(f) for f in PROGRAM_FIELDS]


def ingest_views(programs: DataFrame, arrivals: DataFrame, as_of: Column | None = None) -> ViewsIngested:
    """Arrivals: ``program`` struct, ``viewed_time, speed, seq``. A new program dates from its first view."""
    flat = arrivals.select(
        *_program(), "viewed_time", F.col("viewed_time").alias("created_at"),
        F.coalesce("speed", F.lit(DEFAULT_SPEED)).alias("speed"), "seq")
    change = upsert_programs(programs, flat)
    entered = as_of if as_of is not None else F.current_timestamp()
    rows = change.resolved.select("program_id", "viewed_time", "speed", entered.alias("created_at"))
    return ViewsIngested(change, rows)


def ingest_recordings(programs: DataFrame, series: DataFrame, links: DataFrame, arrivals: DataFrame,
                      overrides: DataFrame | None = None) -> RecordingsIngested:
    """Arrivals: ``program`` struct, ``file_path, file_size, watched_at, deleted_at, created_at, seq``.

    A malformed path refuses the whole arrival. The rest resolves its program, becomes a
    recording and links its program to the series its name stands for.
    """
    valid, rejected = rec.split_valid(arrivals)
    flat = valid.select(
        *_program(), F.col("created_at").alias("viewed_time"), "created_at",
        "file_path", "file_size", "watched_at", "deleted_at", "seq")
    change = upsert_programs(programs, flat)
    rows = change.resolved.withColumn("id", _recording_id()).select(*_RECORDING)
    named = change.resolved.select("program_id", "name", "created_at", "seq")
    known = programs.select(F.col("id").cast("string").alias("id")).unionByName(change.inserted.select("id"))
    assigned = assign_series(known, series, links, named, overrides)
    drop_shuffles(arrivals.sparkSession)
    return RecordingsIngested(change, rows, assigned, rejected)


def from_recorder(info: DataFrame, prefix: str, at: Column, listing: DataFrame | None = None) -> DataFrame:
    """Recorder reports as recording arrivals; live viewing (no file) is left out.

    Listing: ``path, length``, the sizes of files found; a file not found has no size.
    """
    files = info.filter(F.length("rec_file_path") > 0)
    path = paths.from_recorder(prefix, F.col("rec_file_path"))
    rows = files.select(_recorder_program().alias("program"), path.alias("file_path"), at.alias("created_at"),
                        F.col("id").alias("seq"))
    if listing is None:
        return rows.withColumn("file_size", F.lit(None).cast("bigint"))
    sizes = listing.groupBy(F.col("path").alias("file_path")).agg(F.max("length").alias("file_size"))
    return rows.join(sizes, "file_path", "left")


def views_from_recorder(info: DataFrame, at: Column) -> DataFrame:
    """Recorder reports as view arrivals: seen from the start, at normal speed."""
    files = info.filter(F.length("rec_file_path") > 0)
    return files.select(
        _recorder_program().alias("program"), F.col("start_time_epg").alias("viewed_time"),
        F.lit(DEFAULT_SPEED).alias("speed"), at.alias("created_at"), F.col("id").alias("seq"))


def _recorder_program() -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.col("eid").alias("event_id"), F.col("sid").alias("service_id"), F.col("title").alias("name"),
        F.col("start_time_epg").alias("start_time"), F.col("duration_sec").alias("duration"),
        nothing.alias("text"), nothing.alias("ext_text"), text.genre_of(F.col("program_info")).alias("genre"))
