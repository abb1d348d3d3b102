"""Wall-clock rules: a time without a zone is Japan time, a time with one is an instant.

Every helper takes either timestamp kind. ``TIMESTAMP_NTZ`` columns hold Japan
wall-clock values, so results never depend on the session's time zone.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JST = timezone(timedelta(hours=9))
_JST_SECONDS = 9 * 3600


def is_wall_clock(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "timestamp_ntz"


def moment(value: str | datetime, wall_clock: bool, plus: timedelta = timedelta()) -> Column:
    """A literal comparable with a time column of the given kind."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    local = value.replace(tzinfo=JST) if value.tzinfo is None else value.astimezone(JST)
    text = (local + plus).strftime("%Y-%m-%d %H:%M:%S.%f")
    if wall_clock:
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "+09:00").cast("timestamp")


def to_instant(text: Column) -> Column:
    """Text to instant: an explicit offset (``Z``, ``+09:00``, ``+0900``, ``+09``) is kept, text without one is Japan time.

    A bare date is midnight in Japan; bad text is null.
    """
    full = F.regexp_replace(text, r"([T ].*[+-]\d{2})(\d{2})?$", "$1:$2")
    full = F.when(full.endswith(":"), F.concat(full, F.lit("00"))).otherwise(full)
    zoned = text.rlike(r"[T ].*(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    colon = text.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
    bare = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return (F.when(bare, F.concat(text, F.lit("T00:00:00+09:00")).try_cast("timestamp"))
            .when(zoned & colon, text.try_cast("timestamp")).when(zoned, full.try_cast("timestamp"))
            .otherwise(F.concat(text, F.lit("+09:00")).try_cast("timestamp")))


def end_time(start: Column | str = "start_time", seconds: Column | str = "duration") -> Column:
    column = F.col(start) if isinstance(start, str) else start
    return F.timestamp_add("SECOND", F.col(seconds) if isinstance(seconds, str) else seconds, column)


def epoch_micros(column: Column, wall_clock: bool) -> Column:
    """Microseconds since 1970-01-01 UTC."""
    if not wall_clock:
        return F.unix_micros(column)
    days = F.unix_date(column.cast("date")).cast("bigint")
    whole = days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 - _JST_SECONDS
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("bigint")


def from_micros(micros: Column, wall_clock: bool) -> Column:
    """The inverse of ``epoch_micros``."""
    if not wall_clock:
        return F.timestamp_micros(micros)
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 09:00:00").cast("timestamp_ntz"))


def jst_date(column: Column, wall_clock: bool) -> Column:
    """The Japan calendar day, whatever the session's time zone."""
    if wall_clock:
        return column.cast("date")
    micros = F.unix_micros(column) + _JST_SECONDS * 1_000_000
    return F.date_from_unix_date(F.floor(micros / 86_400_000_000).cast("int"))


def jst_day(value: str | datetime) -> date:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return (value if value.tzinfo is None else value.astimezone(JST)).date()


def epoch_seconds(column: Column, wall_clock: bool) -> Column:
    return F.floor(epoch_micros(column, wall_clock) / 1_000_000).cast("bigint")


def epoch_millis(column: Column, wall_clock: bool) -> Column:
    return F.floor(epoch_micros(column, wall_clock) / 1_000).cast("bigint")


def file_time(column: Column, wall_clock: bool, offset_hours: int = 0) -> Column:
    """100 ns ticks since 1601-01-01, as the recorder's range queries take them."""
    # Fixed value: ticks between 1601-01-01 and 1970-01-01.
    ticks_to_1970 = 116444736000000000
    return (epoch_micros(column, wall_clock) + offset_hours * 3_600_000_000) * 10 + ticks_to_1970


def json_times(column: Column) -> Column:
    """Times imported as JSON text: epoch integers or ISO text; anything else is left out."""
    raw = F.from_json(column, "array<string>")
    parsed = F.transform(raw, lambda x: F.coalesce(
        F.timestamp_seconds(x.try_cast("bigint")), to_instant(x)))
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array().cast("array<timestamp>"))


def listing_time(column: Column, seconds: bool = False, wall_clock: bool = True) -> Column:
    """``2025/05/12(Mon) 12:00`` as the listings print it, in Japan time whatever the session's time zone."""
    return F.date_format(_shown(column, wall_clock), "yyyy/MM/dd(EEE) HH:mm:ss" if seconds else "yyyy/MM/dd(EEE) HH:mm")


def listing_span(start: Column, end: Column, wall_clock: bool = True) -> Column:
    return F.concat(listing_time(start, wall_clock=wall_clock), F.lit("-"), F.date_format(_shown(end, wall_clock), "HH:mm"))


def _shown(column: Column, wall_clock: bool) -> Column:
    return column if wall_clock else from_micros(F.unix_micros(column), True)
