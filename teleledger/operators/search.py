"""Searches over programs, views and recordings.

A search filters and pages its base table first; arrays are then built for the
page only, never for the whole table.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger.functions import clock, paths, text
from teleledger.operators.nesting import nested_by_program, with_nested
from teleledger.operators.paging import kept, only_keys, page_of

When = str | datetime | None
PROGRAM_COLUMNS = ["id", "event_id", "service_id", "name", "start_time", "duration", "text", "ext_text", "genre", "created_at"]
_DAY = timedelta(days=1)


def aired_between(df: DataFrame, from_: When, to: When) -> DataFrame:
    """Started at or after ``from_``; ended before the day after ``to``."""
    wall = clock.is_wall_clock(df, "start_time")
    if from_:
        df = df.filter(F.col("start_time") >= clock.moment(from_, wall))
    if to:
        limit = clock.moment(to, wall, _DAY)
        # The first condition follows from the second; it is the one a scan can prune by.
        df = df.filter((F.col("start_time") < limit) & (clock.end_time() < limit))
    return df


def filter_programs(programs: DataFrame, from_: When = None, to: When = None, name: str = "",
                    case_sensitive: bool = False) -> DataFrame:
    found = aired_between(programs, from_, to)
    return found.filter(text.contains(F.col("name"), name, case_sensitive)) if name else found


def _nest_programs(page: DataFrame, views: DataFrame, recordings: DataFrame, keys: DataFrame, bound: int | None,
                   live_only: bool) -> DataFrame:
    nested = nested_by_program(views, recordings, keys.select(F.col("id").alias("program_id")), bound, live_only)
    return with_nested(page, nested, "id").withColumn("end_time", clock.end_time())


def search_programs(programs: DataFrame, views: DataFrame, recordings: DataFrame, from_: When = None,
                    to: When = None, name: str = "", page: int = 1, size: int = 100,
                    case_sensitive: bool = False, live_only: bool = False) -> DataFrame:
    """Programs, newest first, one page, with all view times and recording ids."""
    found = filter_programs(programs, from_, to, name, case_sensitive).select(*PROGRAM_COLUMNS)
    rows = kept(page_of(found, [F.desc("start_time"), F.asc("id")], page, size, "start_time"))
    return _nest_programs(rows, views, recordings, rows, size, live_only).orderBy(
        F.desc("start_time"), "id", "part")


def recent_programs(programs: DataFrame, views: DataFrame, recordings: DataFrame) -> DataFrame:
    """The last hundred programs seen or recorded."""
    return search_programs(programs, views, recordings, size=100)


def programs_by_id(programs: DataFrame, views: DataFrame, recordings: DataFrame, keys: DataFrame,
                   bound: int | None = None, live_only: bool = True) -> DataFrame:
    """Programs whose ``id`` is in ``keys``; recordings not deleted only, unless asked otherwise."""
    rows = only_keys(programs.select(*PROGRAM_COLUMNS), keys, "id", bound)
    return _nest_programs(rows, views, recordings, keys, bound, live_only)


def search_views(views: DataFrame, page: int = 1, size: int = 500) -> DataFrame:
    """All views, newest entry first, one page."""
    columns = views.select("program_id", "viewed_time", "speed", "created_at")
    return page_of(columns, [F.desc("created_at"), F.asc("program_id"), F.asc("viewed_time"), F.asc("speed")],
                   page, size, "created_at")


def views_of_programs(views: DataFrame, keys: DataFrame, bound: int | None = None) -> DataFrame:
    """Every view of the programs in ``keys`` (column ``program_id``), unpaged, newest entry first."""
    rows = only_keys(views.select("program_id", "viewed_time", "speed", "created_at"), keys, "program_id", bound)
    return rows.orderBy("program_id", F.desc("created_at"))


def _recording_rows(recordings: DataFrame, programs: DataFrame) -> DataFrame:
    program = F.struct(*[F.col(c) for c in PROGRAM_COLUMNS])
    right = programs.select(F.col("id").alias("program_id"), program.alias("program"), "start_time", "duration")
    left = recordings.select("id", "program_id", "file_path", "file_size", "watched_at", "deleted_at", "created_at")
    return left.join(right, "program_id")


def _nest_recordings(rows: DataFrame, views: DataFrame, recordings: DataFrame, keys: DataFrame, bound: int | None,
                     live_only: bool) -> DataFrame:
    nested = nested_by_program(views, recordings, keys.select("program_id").distinct(), bound, live_only)
    full = with_nested(rows, nested, "program_id")
    program = F.col("program")
    for name, value in (
        ("end_time", clock.end_time()), ("viewed_times", F.col("viewed_times")), ("recordings", F.col("recordings")),
    ):
        program = program.withField(name, value)
    return full.select(
        "id", "program_id", "file_path", paths.folder_of(F.col("file_path")).alias("file_folder"), "file_size",
        "watched_at", "deleted_at", "created_at", program.alias("program"), "part", "parts")


def search_recordings(recordings: DataFrame, programs: DataFrame, views: DataFrame,
                      program_id: object | None = None, from_: When = None, to: When = None,
                      watched: bool | str = False, deleted: bool | str = False, file_folder: str = "",
                      page: int = 1, size: int = 100, live_only: bool = True) -> DataFrame:
    """Recordings with their program nested: latest program first, then oldest recording."""
    files = recordings
    if not watched:
        files = files.filter("watched_at IS NULL")
    if not deleted:
        files = files.filter("deleted_at IS NULL")
    if file_folder:
        files = files.filter(paths.in_folder(F.col("file_path"), file_folder))
    shows = aired_between(programs, from_, to)
    if program_id is not None:
        files = files.filter(F.col("program_id") == F.lit(program_id))
        shows = shows.filter(F.col("id") == F.lit(program_id))
    rows = kept(page_of(_recording_rows(files, shows),
                        [F.desc("start_time"), F.asc("created_at"), F.asc("id")], page, size, "start_time"))
    return _nest_recordings(rows, views, recordings, rows, size, live_only).orderBy(
        F.desc("program.start_time"), "created_at", "id", "part")


def recordings_by_id(recordings: DataFrame, programs: DataFrame, views: DataFrame, keys: DataFrame,
                     bound: int | None = None, live_only: bool = True) -> DataFrame:
    """Recordings whose ``id`` is in ``keys``, in the same shape."""
    files = only_keys(recordings, keys, "id", bound)
    return _nest_recordings(_recording_rows(files, programs), views, recordings, files, bound, live_only)


def program_timeline(found: DataFrame, millis: bool = False) -> DataFrame:
    """Start, end and every view time as epoch seconds, or milliseconds, for plotting."""
    wall = clock.is_wall_clock(found, "start_time")
    epoch = clock.epoch_millis if millis else clock.epoch_seconds
    suffix = "ms" if millis else "timestamp"

    def each(column: Column) -> Column:
        return F.transform(column, lambda t: epoch(t, wall))

    return found.select(
        "*",
        epoch(F.col("start_time"), wall).alias(f"start_time_{suffix}"),
        epoch(clock.end_time(), wall).alias(f"end_time_{suffix}"),
        each(F.col("viewed_times")).alias(f"viewed_times_{suffix}"),
    )


def recording_timeline(found: DataFrame) -> DataFrame:
    """The same in milliseconds for recordings with a nested program."""
    shown = found.select(
        F.col("id").alias("recording_id"), "file_path", "file_folder", "file_size", "part", "program.*")
    return program_timeline(shown, millis=True)
