"""Fixed schemas of the five tables and of the landing feeds; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_L, _S, _TS, _D, _I, _B = (
    T.LongType(), T.StringType(), T.TimestampType(), T.DoubleType(), T.IntegerType(), T.BooleanType(),
)


def programs(id_type: T.DataType = _L) -> T.StructType:
    return _struct(
        ("id", id_type, False), ("event_id", _L, False), ("service_id", _L, False),
        ("name", _S, False), ("start_time", _TS, False), ("duration", _L, False),
        ("text", _S, True), ("ext_text", _S, True), ("genre", _S, True), ("created_at", _TS, False),
    )


def recordings(id_type: T.DataType = _L) -> T.StructType:
    return _struct(
        ("id", id_type, False), ("program_id", id_type, False), ("file_path", _S, False),
        ("file_size", _L, True), ("watched_at", _TS, True), ("deleted_at", _TS, True),
        ("created_at", _TS, False),
    )


def views(id_type: T.DataType = _L) -> T.StructType:
    return _struct(
        ("program_id", id_type, False), ("viewed_time", _TS, False), ("speed", _D, True),
        ("created_at", _TS, False),
    )


def series(id_type: T.DataType = _L) -> T.StructType:
    return _struct(
        ("id", id_type, False), ("name", _S, False), ("created_at", _TS, False),
        ("modified_at", _TS, False),
    )


def program_series(id_type: T.DataType = _L) -> T.StructType:
    return _struct(("program_id", id_type, False), ("series_id", id_type, False))


TABLES = {
    "programs": programs, "recordings": recordings, "views": views,
    "series": series, "program_series": program_series,
}

# Time column whose date partitions each stored table.
PARTITION_TIME = {"programs": "start_time", "recordings": "created_at", "views": "viewed_time"}

# The program as the feeds carry it.
PROGRAM_FIELDS = ["event_id", "service_id", "name", "start_time", "duration", "text", "ext_text", "genre"]

PROGRAM_STRUCT = _struct(
    ("event_id", _L, True), ("service_id", _L, True), ("name", _S, True), ("start_time", _TS, True),
    ("duration", _L, True), ("text", _S, True), ("ext_text", _S, True), ("genre", _S, True),
)

VIEW_ARRIVAL = _struct(
    ("program", PROGRAM_STRUCT, True), ("viewed_time", _TS, True), ("speed", _D, True),
    ("created_at", _TS, True),
)

RECORDING_ARRIVAL = _struct(
    ("program", PROGRAM_STRUCT, True), ("file_path", _S, True), ("file_size", _L, True),
    ("watched_at", _TS, True), ("deleted_at", _TS, True), ("created_at", _TS, True),
)

# The player's own report; times stay text until parsed, so a bad one can be set aside.
PLAYER_STATUS = _struct(
    ("play_status", _S, True), ("current_event_id", _L, True), ("current_event_service_id", _L, True),
    ("current_event_name", _S, True), ("current_event_start_time", _S, True),
    ("current_event_duration", _L, True), ("current_content_nibble", _S, True),
    ("tot", _S, True), ("speed", _D, True),
)

RECORDER_INFO = _struct(
    ("id", _L, True), ("rec_file_path", _S, True), ("title", _S, True), ("start_time", _TS, True),
    ("duration_sec", _L, True), ("service_name", _S, True), ("onid", _L, True), ("tsid", _L, True),
    ("sid", _L, True), ("eid", _L, True), ("start_time_epg", _TS, True), ("comment", _S, True),
    ("program_info", _S, True),
)

EPG_EVENT = _struct(
    ("onid", _L, True), ("tsid", _L, True), ("sid", _L, True), ("eid", _L, True),
    ("start_time", _TS, True), ("duration_sec", _L, True),
    ("short_info", _struct(("event_name", _S, True), ("text_char", _S, True)), True),
)

EPG_FEED = _struct(
    ("service_info", _struct(
        ("onid", _L, True), ("tsid", _L, True), ("sid", _L, True), ("service_name", _S, True)), True),
    ("event_list", T.ArrayType(EPG_EVENT), True),
)

FILE_COMMAND = _struct(
    ("action", _S, True), ("file_path", _S, True), ("old_path", _S, True), ("new_path", _S, True),
)
