"""Searches, listings and the backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleledger.functions import clock
from teleledger.operators import digest, search
from teleledger.operators.paging import page_of
from teleledger.plans.tables import Source, with_tables

_VIEWED = """va AS (SELECT program_id, count(*) AS view_count,
    string_agg(CAST(epoch_us(viewed_time) // 1000000 - 32400 AS VARCHAR), ',' ORDER BY viewed_time) AS viewed
    FROM views GROUP BY program_id)"""
_FILED = """ra AS (SELECT program_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS files
    FROM recordings GROUP BY program_id)"""
_FILED_LIVE = _FILED.replace("FROM recordings", "FROM recordings WHERE deleted_at IS NULL")
_PROGRAM = "p.id, p.event_id, p.service_id, p.name, p.start_time, p.duration, p.genre, p.created_at"
_END = "p.start_time + to_seconds(p.duration)"
_NESTED = "coalesce(va.view_count, 0) AS view_count, coalesce(va.viewed, '') AS viewed, coalesce(ra.files, '') AS files"
_JOINS = "LEFT JOIN va ON va.program_id = p.id LEFT JOIN ra ON ra.program_id = p.id"


def _epochs(times: str) -> F.Column:
    return F.array_join(F.transform(times, lambda t: clock.epoch_seconds(t, True).cast("string")), ",")


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that both engines can be compared value by value."""
    return df.select(
        *columns, F.size("viewed_times").cast("bigint").alias("view_count"), _epochs("viewed_times").alias("viewed"),
        F.array_join(F.transform("recordings", lambda r: r.cast("string")), ",").alias("files"))


_COLUMNS = ["id", "event_id", "service_id", "name", "start_time", "duration", "genre", "created_at", "end_time"]


def digestions(s: Source) -> DataFrame:
    found = digest.digestions(s.programs, s.recordings, s.views)
    return found.select(
        "id", "name", "service_id", "start_time", "duration", "end_time", "minutes", "watched_seconds",
        _epochs("viewed_times").alias("viewed"))


_UNFINISHED = """FROM programs p LEFT JOIN va ON va.program_id = p.id
    WHERE EXISTS (SELECT 1 FROM recordings r WHERE r.program_id = p.id AND r.watched_at IS NULL AND r.deleted_at IS NULL)
      AND coalesce(va.view_count, 0) * 300 < p.duration * 0.8::DOUBLE"""
DIGESTIONS = with_tables(f""", {_VIEWED}
SELECT p.id, p.name, p.service_id, p.start_time, p.duration, {_END} AS end_time, p.duration // 60 AS minutes,
    coalesce(va.view_count, 0) * 300 AS watched_seconds, coalesce(va.viewed, '') AS viewed
{_UNFINISHED} ORDER BY p.start_time DESC, p.id LIMIT 100""", "programs", "recordings", "views")


def digestions_oldest(s: Source) -> DataFrame:
    found = digest.digestions(s.programs, s.recordings, s.views, name="show 2", page=2, size=50, ascending=True)
    return found.select("id", "name", "start_time", "duration", "watched_seconds", _epochs("viewed_times").alias("viewed"))


DIGESTIONS_OLDEST = with_tables(f""", {_VIEWED}
SELECT p.id, p.name, p.start_time, p.duration, coalesce(va.view_count, 0) * 300 AS watched_seconds,
    coalesce(va.viewed, '') AS viewed
{_UNFINISHED} AND p.name ILIKE '%show 2%' ORDER BY p.start_time, p.id LIMIT 50 OFFSET 50""",
    "programs", "recordings", "views")


def backlog(s: Source) -> DataFrame:
    return digest.unfinished(s.programs, s.recordings, s.views)


BACKLOG = with_tables(f""", {_VIEWED}
SELECT p.id, p.name, p.service_id, p.start_time, p.duration, coalesce(va.view_count, 0) * 300 AS watched_seconds
{_UNFINISHED}""", "programs", "recordings", "views")


def watched_time(s: Source) -> DataFrame:
    return digest.watched_seconds(s.views)


WATCHED_TIME = with_tables(
    "SELECT program_id, count(viewed_time) * 300 AS watched_seconds FROM views GROUP BY program_id", "views")


def program_search(s: Source) -> DataFrame:
    return _flat(search.search_programs(s.programs, s.views, s.recordings, from_="1996-01-01", to="2000-12-31",
                                        name="SHOW 1", page=2, size=100), *_COLUMNS)


PROGRAM_SEARCH = with_tables(f""", {_VIEWED}, {_FILED}
SELECT {_PROGRAM}, {_END} AS end_time, {_NESTED} FROM programs p {_JOINS}
WHERE p.start_time >= TIMESTAMP '1996-01-01' AND {_END} < TIMESTAMP '2001-01-01' AND p.name ILIKE '%SHOW 1%'
ORDER BY p.start_time DESC, p.id LIMIT 100 OFFSET 100""", "programs", "views", "recordings")


def recent_programs(s: Source) -> DataFrame:
    return _flat(search.recent_programs(s.programs, s.views, s.recordings), *_COLUMNS)


RECENT_PROGRAMS = with_tables(f""", {_VIEWED}, {_FILED}
SELECT {_PROGRAM}, {_END} AS end_time, {_NESTED} FROM programs p {_JOINS}
ORDER BY p.start_time DESC, p.id LIMIT 100""", "programs", "views", "recordings")


def programs_by_id(s: Source) -> DataFrame:
    """Keys: every program with a watched recording."""
    keys = s.recordings.filter("watched_at IS NOT NULL").select(F.col("program_id").alias("id"))
    return _flat(search.programs_by_id(s.programs, s.views, s.recordings, keys), *_COLUMNS)


PROGRAMS_BY_ID = with_tables(f""", {_VIEWED}, {_FILED_LIVE}
SELECT {_PROGRAM}, {_END} AS end_time, {_NESTED} FROM programs p {_JOINS}
WHERE p.id IN (SELECT program_id FROM recordings WHERE watched_at IS NOT NULL)""", "programs", "views", "recordings")


def view_search(s: Source) -> DataFrame:
    return search.search_views(s.views)


VIEW_SEARCH = with_tables("""SELECT program_id, viewed_time, speed, created_at FROM views
ORDER BY created_at DESC, program_id, viewed_time, speed LIMIT 500""", "views")


def view_search_deep(s: Source) -> DataFrame:
    """A page far down, found by counting instead of sorting."""
    return page_of(s.views, [F.desc("created_at"), F.asc("program_id"), F.asc("viewed_time"), F.asc("speed")],
                   7, 1000, "created_at", deep_from=0)


VIEW_SEARCH_DEEP = with_tables("""SELECT program_id, viewed_time, speed, created_at FROM views
ORDER BY created_at DESC, program_id, viewed_time, speed LIMIT 1000 OFFSET 6000""", "views")


def views_of_programs(s: Source) -> DataFrame:
    """Keys: every program in the backlog."""
    keys = digest.unfinished(s.programs, s.recordings, s.views).select(F.col("id").alias("program_id"))
    return search.views_of_programs(s.views, keys)


VIEWS_OF_PROGRAMS = with_tables(f""", {_VIEWED}
SELECT v.program_id, v.viewed_time, v.speed, v.created_at FROM views v
WHERE v.program_id IN (SELECT p.id {_UNFINISHED})""", "programs", "views", "recordings")


def _flat_recordings(found: DataFrame) -> DataFrame:
    shown = found.select(
        F.col("id").alias("recording_id"), "file_path", "file_folder", "file_size", "watched_at", "deleted_at",
        F.col("created_at").alias("recorded_at"), "program.*")
    return _flat(shown, "recording_id", "file_path", "file_folder", "file_size", "watched_at", "deleted_at",
                 "recorded_at", *_COLUMNS)


_RECORDING = """r.id AS recording_id, r.file_path, CASE WHEN r.file_path <> '' THEN split_part(r.file_path, '/', 4) END AS file_folder,
    r.file_size, r.watched_at, r.deleted_at, r.created_at AS recorded_at"""


def recording_search(s: Source) -> DataFrame:
    return _flat_recordings(search.search_recordings(
        s.recordings, s.programs, s.views, from_="1996-06-01", to="2001-06-30", watched="on",
        file_folder="rec.*", size=200))


RECORDING_SEARCH = with_tables(f""", {_VIEWED}, {_FILED_LIVE}
SELECT {_RECORDING}, {_PROGRAM}, {_END} AS end_time, {_NESTED}
FROM recordings r JOIN programs p ON p.id = r.program_id {_JOINS}
WHERE p.start_time >= TIMESTAMP '1996-06-01' AND {_END} < TIMESTAMP '2001-07-01' AND r.deleted_at IS NULL
  AND regexp_matches(r.file_path, '^//[^/]+/rec.*/.*$')
ORDER BY p.start_time DESC, r.created_at, r.id LIMIT 200""", "programs", "views", "recordings")


def recordings_by_id(s: Source) -> DataFrame:
    """Keys: every recording of a program with views, deleted ones included."""
    keys = s.recordings.join(s.views.select("program_id").distinct(), "program_id", "left_semi").select("id")
    return _flat_recordings(search.recordings_by_id(s.recordings, s.programs, s.views, keys))


RECORDINGS_BY_ID = with_tables(f""", {_VIEWED}, {_FILED_LIVE}
SELECT {_RECORDING}, {_PROGRAM}, {_END} AS end_time, {_NESTED}
FROM recordings r JOIN programs p ON p.id = r.program_id {_JOINS}
WHERE r.program_id IN (SELECT program_id FROM views)""", "programs", "views", "recordings")


def program_timeline(s: Source) -> DataFrame:
    found = search.program_timeline(search.search_programs(s.programs, s.views, s.recordings, name="#7", size=300))
    return found.select(
        "id", "start_time_timestamp", "end_time_timestamp",
        F.array_join(F.transform("viewed_times_timestamp", lambda t: t.cast("string")), ",").alias("viewed"))


PROGRAM_TIMELINE = with_tables(f""", {_VIEWED}
SELECT p.id, CAST(epoch(p.start_time) AS BIGINT) - 32400 AS start_time_timestamp,
    CAST(epoch(p.start_time) AS BIGINT) - 32400 + p.duration AS end_time_timestamp, coalesce(va.viewed, '') AS viewed
FROM programs p LEFT JOIN va ON va.program_id = p.id WHERE p.name LIKE '%#7%'
ORDER BY p.start_time DESC, p.id LIMIT 300""", "programs", "views")


def recording_timeline(s: Source) -> DataFrame:
    found = search.recording_timeline(search.search_recordings(s.recordings, s.programs, s.views))
    return found.select(
        "recording_id", "start_time_ms", "end_time_ms",
        F.array_join(F.transform("viewed_times_ms", lambda t: t.cast("string")), ",").alias("viewed"))


RECORDING_TIMELINE = with_tables(""", vm AS (SELECT program_id,
    string_agg(CAST(epoch_us(viewed_time) // 1000 - 32400000 AS VARCHAR), ',' ORDER BY viewed_time) AS viewed
    FROM views GROUP BY program_id)
SELECT r.id AS recording_id, epoch_ms(p.start_time) - 32400000 AS start_time_ms,
    epoch_ms(p.start_time) - 32400000 + p.duration * 1000 AS end_time_ms, coalesce(vm.viewed, '') AS viewed
FROM recordings r JOIN programs p ON p.id = r.program_id LEFT JOIN vm ON vm.program_id = p.id
WHERE r.watched_at IS NULL AND r.deleted_at IS NULL
ORDER BY p.start_time DESC, r.created_at, r.id LIMIT 100""", "programs", "views", "recordings")


def view_positions(s: Source) -> DataFrame:
    return digest.view_positions(s.programs, s.views)


VIEW_POSITIONS = with_tables("""SELECT v.program_id, v.viewed_time,
    (epoch_us(v.viewed_time) // 1000000 - epoch_us(p.start_time) // 1000000)::DOUBLE / p.duration AS position,
    600::DOUBLE / p.duration AS marker_width
FROM views v JOIN programs p ON p.id = v.program_id WHERE p.duration > 0""", "programs", "views")


def program_listing(s: Source) -> DataFrame:
    """Every program as the listing prints it."""
    return s.programs.select(
        "id", "name", clock.listing_span(F.col("start_time"), clock.end_time()).alias("aired"),
        F.expr("duration div 60").alias("minutes"))


PROGRAM_LISTING = with_tables(f"""SELECT p.id, p.name, strftime(p.start_time, '%Y/%m/%d(%a) %H:%M') || '-' ||
    strftime({_END}, '%H:%M') AS aired, p.duration // 60 AS minutes FROM programs p""", "programs")

QUERIES = {
    "digestions": (digestions, DIGESTIONS),
    "digestions_oldest": (digestions_oldest, DIGESTIONS_OLDEST),
    "digestion_backlog": (backlog, BACKLOG),
    "watched_seconds": (watched_time, WATCHED_TIME),
    "program_search": (program_search, PROGRAM_SEARCH),
    "recent_programs": (recent_programs, RECENT_PROGRAMS),
    "programs_by_id": (programs_by_id, PROGRAMS_BY_ID),
    "view_search": (view_search, VIEW_SEARCH),
    "view_search_deep": (view_search_deep, VIEW_SEARCH_DEEP),
    "views_of_programs": (views_of_programs, VIEWS_OF_PROGRAMS),
    "recording_search": (recording_search, RECORDING_SEARCH),
    "recordings_by_id": (recordings_by_id, RECORDINGS_BY_ID),
    "program_timeline": (program_timeline, PROGRAM_TIMELINE),
    "recording_timeline": (recording_timeline, RECORDING_TIMELINE),
    "view_positions": (view_positions, VIEW_POSITIONS),
    "program_listing": (program_listing, PROGRAM_LISTING),
}
