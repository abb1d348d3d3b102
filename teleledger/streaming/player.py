"""Player reports to view arrivals. Works on a batch or a stream of text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger import schema
from teleledger.functions import clock
from teleledger.operators.digest import SAMPLE_SECONDS
from teleledger.operators.ingest import DEFAULT_SPEED

# The sampling rhythm, used as the trigger of the live stream.
SAMPLE_TRIGGER = "5 minutes"

# What a report must name; the genre may be null.
_REQUIRED = ["current_event_id", "current_event_service_id", "current_event_name",
             "current_event_start_time", "current_event_duration", "tot"]
_NULLABLE = ["current_content_nibble"]


def _reading(text: Column) -> Column:
    """Everything there is to know about one report, parsed once."""
    parsed = F.struct(
        F.from_json(text, schema.PLAYER_STATUS).alias("s"),
        F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")).alias("keys"))

    def read(r: Column) -> Column:
        s, keys = r["s"], r["keys"]
        complete = F.lit(True)
        for name in _REQUIRED:
            complete = complete & s[name].isNotNull()
        for name in _NULLABLE:
            complete = complete & F.array_contains(keys, name)
        start, seen = clock.to_instant(s["current_event_start_time"]), clock.to_instant(s["tot"])
        speed_named = F.array_contains(keys, "speed")
        sound = complete & start.isNotNull() & seen.isNotNull() & (~speed_named | s["speed"].isNotNull())
        verdict = (
            F.when(s["play_status"].eqNullSafe("finished"), "finished")
            .when(F.coalesce(sound, F.lit(False)), "view").otherwise("rejected"))
        nothing = F.lit(None).cast("string")
        program = F.struct(
            s["current_event_id"].alias("event_id"), s["current_event_service_id"].alias("service_id"),
            s["current_event_name"].alias("name"), start.alias("start_time"),
            s["current_event_duration"].alias("duration"), nothing.alias("text"), nothing.alias("ext_text"),
            s["current_content_nibble"].alias("genre"))
        return F.struct(
            verdict.alias("verdict"), program.alias("program"), seen.alias("viewed_time"),
            F.coalesce(s["speed"] / 100.0, F.lit(DEFAULT_SPEED)).alias("speed"))

    return F.transform(F.array(parsed), read)


def judge_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``reading`` with the ``verdict`` (view, finished or rejected) and the view arrival's fields.

    The one-element array is exploded so that later filters on the verdict do not parse the text again.
    """
    return lines.select("*", F.explode_outer(_reading(F.col(value).cast("string"))).alias("reading"))


def status_to_view(lines: DataFrame, value: str = "value") -> DataFrame:
    """View arrivals of all usable reports, other columns of the rows kept."""
    rows = judge_status(lines, value).filter("reading.verdict = 'view'")
    return rows.select(
        *[c for c in lines.columns if c != value], "reading.program", "reading.viewed_time", "reading.speed")


def rejected_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """Reports to set aside, as they came."""
    return judge_status(lines, value).filter("reading.verdict = 'rejected'").select(*lines.columns)


def watched_windows(views: DataFrame) -> DataFrame:
    """Seconds watched per program and five-minute window; each sample stands for five minutes.

    However late a sample comes, it counts: there is no watermark, so a stream keeps one number per program and window.
    """
    return (
        views.groupBy(F.window("viewed_time", SAMPLE_TRIGGER), "program_id")
        .agg((F.count("*") * SAMPLE_SECONDS).alias("watched_seconds"))
        .select("program_id", F.col("window.start").alias("window_start"), "watched_seconds"))
