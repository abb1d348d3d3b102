"""Rows of the model tables, for tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T


def wall(fields: T.StructType) -> T.StructType:
    """The model schema with wall-clock times, all nullable, for hand-written rows."""
    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.TimestampType):
            return T.TimestampNTZType()
        return wall(t) if isinstance(t, T.StructType) else t

    return T.StructType([T.StructField(f.name, kind(f.dataType), True) for f in fields.fields])


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def program(id: int, start: str, seconds: int = 1800, **more) -> dict:
    begin = at(start)
    return {"id": id, "event_id": more.pop("event_id", 10 + id), "service_id": more.pop("service_id", 101),
            "name": more.pop("name", f"Program {id}"), "start_time": begin, "duration": seconds,
            "created_at": more.pop("created_at", begin), **more}
