"""Program guide: flattening, first occurrences, range and service selection, reservations."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger.functions import clock, ids

EVENT_KEY = ["onid", "tsid", "sid", "eid"]
_DAY = timedelta(days=1)

# The settings every reservation is made with.
RESERVATION_SETTINGS = {
    "rec_mode": 3,
    "priority": 1,
    "tuijyuu_flag": True,
    "service_mode": 0,
    "pittari_flag": True,
    "bat_file_path": "",
    "suspend_mode": 0,
    "reboot_flag": False,
    "continue_rec_flag": False,
    "partial_rec_flag": 0,
    "tuner_id": 0,
}


def flatten_feed(feed: DataFrame) -> DataFrame:
    """One row per event of a nested feed, with its place in it.

    The feed has ``svc_pos`` (the service's place) and ``event_list``; services without events give no rows.
    """
    events = feed.select("svc_pos", F.posexplode("event_list").alias("evt_pos", "event"))
    return events.select(
        F.col("svc_pos").cast("bigint").alias("svc_pos"), F.col("evt_pos").cast("bigint").alias("evt_pos"),
        *[F.col(f"event.{c}").alias(c) for c in EVENT_KEY],
        F.col("event.start_time").alias("start_time"), F.col("event.duration_sec").alias("duration"),
        F.coalesce("event.short_info.event_name", F.lit("")).alias("event_name"))


def timed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a known start and duration, and those without."""
    known = F.col("start_time").isNotNull() & F.col("duration").isNotNull()
    return events.filter(known), events.filter(~known)


def unique_events(events: DataFrame) -> DataFrame:
    """The first event in feed order of each name, start and duration.

    A grouped minimum, combined before the shuffle, so a title aired everywhere stays cheap.
    """
    known, _ = timed(events)
    # Feed order as one number: an array never has 2^31 entries.
    place = F.shiftleft(F.col("svc_pos"), 31).bitwiseOR(F.col("evt_pos"))
    grouped = known.withColumn("place", place).groupBy("event_name", "start_time", "duration").agg(
        *[F.min_by(c, "place").alias(c) for c in EVENT_KEY])
    return grouped.select(*EVENT_KEY, "start_time", "duration", "event_name")


def starting_within_a_day(events: DataFrame, now: str | datetime) -> DataFrame:
    """Start in [now, now + 1 day)."""
    wall = clock.is_wall_clock(events, "start_time")
    start = F.col("start_time")
    return events.filter((start >= clock.moment(now, wall)) & (start < clock.moment(now, wall, _DAY)))


def of_services(events: DataFrame, targets: list[tuple[int, int]]) -> DataFrame:
    """Events of the services asked for as (mask, packed service) pairs; bits in the mask do not count."""
    key = ids.service_key(F.col("onid"), F.col("tsid"), F.col("sid"))
    by_mask: dict[int, list[int]] = defaultdict(list)
    for mask, target in targets:
        by_mask[mask].append(target | mask)
    wanted: Column = F.lit(False)
    for mask, values in by_mask.items():
        wanted = wanted | key.bitwiseOR(F.lit(mask).cast("bigint")).isin(values)
    return events.filter(wanted)


def future_events(feed: DataFrame, now: str | datetime, targets: list[tuple[int, int]] | None = None) -> DataFrame:
    """A day of upcoming events, without repeats."""
    events = starting_within_a_day(flatten_feed(feed), now)
    return unique_events(events if targets is None else of_services(events, targets))


def reservation_rows(requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A reservation per request whose event starts within a day of ``requested_at``, and requests without one.

    Requests: ``request_id, onid, tsid, sid, eid, requested_at``. A request meets only airings of the two calendar days that
    the day after it lies in, so reruns of one event id over the years, or ids used again, add no pairs.
    """
    place = F.shiftleft(F.col("svc_pos"), 31).bitwiseOR(F.col("evt_pos"))
    known, _ = timed(events)
    guide = known.select(*EVENT_KEY, place.alias("place"), "start_time", "duration", "event_name", F.to_date("start_time").alias("_day"))
    start, asked = F.col("start_time"), F.to_date("requested_at")
    days = requests.withColumn("_day", F.explode(F.array(asked, F.date_add(asked, 1))))
    near = days.join(guide, [*EVENT_KEY, "_day"]).filter(
        (start >= F.col("requested_at")) & (start < F.timestamp_add("DAY", F.lit(1), F.col("requested_at"))))
    # By request alone: requests for one popular event are spread out again.
    first = near.groupBy("request_id").agg(
        F.min_by(F.struct(*EVENT_KEY, "start_time", "duration", "event_name"), "place").alias("e"))
    rows = first.select(
        "request_id", *[F.col(f"e.{c}").alias(c) for c in EVENT_KEY], F.col("e.event_name").alias("title"), F.col("e.start_time").alias("start_time"),
        F.col("e.start_time").alias("start_time_epg"), F.col("e.duration").alias("duration_second"),
        F.lit("").alias("station_name"), *[F.lit(v).alias(k) for k, v in RESERVATION_SETTINGS.items()],
        F.array().cast("array<string>").alias("rec_folder_list"),
        F.array().cast("array<string>").alias("partial_rec_folder"))
    missed = requests.join(first.select("request_id"), "request_id", "left_anti")
    return rows, missed


def channel_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tab-separated channel lines as rows; lines that are short or hold no numbers are left out."""
    parts = F.split(F.col(value), "\t")
    numbers = ["onid", "tsid", "sid", "service_type", "partial_flag", "epg_cap_flag", "search_flag"]
    parsed = lines.filter(F.size(parts) >= 9).select(
        parts[0].alias("service_name"), parts[1].alias("network_name"),
        *[F.trim(parts[i + 2]).try_cast("bigint").alias(n) for i, n in enumerate(numbers)])
    flags = numbers[4:]
    return parsed.dropna(subset=numbers).select(
        "service_name", "network_name", *numbers[:4], *[(F.col(f) != 0).alias(f) for f in flags])
