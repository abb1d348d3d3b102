"""Program guide queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleledger.functions import clock, ids, text
from teleledger.operators import epg
from teleledger.plans.tables import Source

# (mask, packed service): one service, all services of a stream, all of a network.
_TARGETS = [(0, (4 << 32) | (100 << 16) | 101), (0xFFFF, (5 << 32) | (101 << 16)), (0xFFFFFFFF, 6 << 32)]
_FROM = "1997-03-01 06:00:00"


def feed(s: Source) -> DataFrame:
    """A nested feed: every order is a service with a broadcast and its rerun a day later."""
    onid, tsid, sid = 4 + F.col("o_custkey") % 3, 100 + F.col("o_custkey") % 16, 101 + F.col("o_custkey") % 8
    name = F.concat(F.lit("Show "), F.col("o_orderpriority"))
    start = F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate"))

    def event(days: int) -> F.Column:
        return F.struct(
            onid.alias("onid"), tsid.alias("tsid"), sid.alias("sid"), (F.col("o_orderkey") % 65536).alias("eid"),
            F.when(F.col("o_totalprice") > 20000, F.timestamp_add("DAY", F.lit(days), start)).alias("start_time"),
            (1800 * (1 + F.col("o_orderkey") % 3)).alias("duration_sec"),
            F.when(F.col("o_orderstatus") != "P", F.struct(name.alias("event_name"))).alias("short_info"))

    return s.read("orders").select(F.col("o_orderkey").alias("svc_pos"), F.array(event(0), event(1)).alias("event_list"))


_FLAT = """flat AS (SELECT o_orderkey AS svc_pos, d.days AS evt_pos, 4 + o_custkey % 3 AS onid, 100 + o_custkey % 16 AS tsid,
    101 + o_custkey % 8 AS sid, o_orderkey % 65536 AS eid,
    CASE WHEN o_totalprice > 20000 THEN o_orderdate + to_hours(o_orderkey % 24) + to_days(d.days) END AS start_time,
    1800 * (1 + o_orderkey % 3) AS duration,
    CASE WHEN o_orderstatus <> 'P' THEN 'Show ' || o_orderpriority ELSE '' END AS event_name
    FROM orders, (VALUES (0), (1)) d(days))"""
_FIRST = """QUALIFY row_number() OVER (PARTITION BY event_name, start_time, duration ORDER BY svc_pos, evt_pos) = 1"""


def epg_flat(s: Source) -> DataFrame:
    return epg.flatten_feed(feed(s))


EPG_FLAT = f"WITH {_FLAT} SELECT * FROM flat"


def epg_unique(s: Source) -> DataFrame:
    return epg.unique_events(epg.flatten_feed(feed(s)))


EPG_UNIQUE = f"""WITH {_FLAT} SELECT onid, tsid, sid, eid, start_time, duration, event_name FROM flat
WHERE start_time IS NOT NULL {_FIRST}"""


def epg_window(s: Source) -> DataFrame:
    return epg.future_events(feed(s), _FROM, _TARGETS)


EPG_WINDOW = f"""WITH {_FLAT} SELECT onid, tsid, sid, eid, start_time, duration, event_name FROM flat
WHERE start_time >= TIMESTAMP '{_FROM}' AND start_time < TIMESTAMP '{_FROM}' + INTERVAL 1 DAY
  AND ((onid = 4 AND tsid = 100 AND sid = 101) OR (onid = 5 AND tsid = 101) OR onid = 6) {_FIRST}"""


def _requests(s: Source) -> DataFrame:
    """Every event is a request to record the guide entry of its order, early, in time or late."""
    asked = s.read("events").select(
        F.col("event_id").alias("request_id"), F.expr("event_id div 100 * 10 + user_id % 10").alias("o_orderkey"))
    start = F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate"))
    return asked.join(s.read("orders"), "o_orderkey").select(
        "request_id", (4 + F.col("o_custkey") % 3).alias("onid"), (100 + F.col("o_custkey") % 16).alias("tsid"),
        (101 + F.col("o_custkey") % 8).alias("sid"), (F.col("o_orderkey") % 65536).alias("eid"),
        F.timestamp_add("HOUR", 24 - F.col("request_id") % 72, start).alias("requested_at"))


_REQUESTS = """requests AS (SELECT e.event_id AS request_id, 4 + o_custkey % 3 AS onid, 100 + o_custkey % 16 AS tsid,
    101 + o_custkey % 8 AS sid, o_orderkey % 65536 AS eid,
    o_orderdate + to_hours(o_orderkey % 24) + to_hours(24 - e.event_id % 72) AS requested_at
    FROM events e JOIN orders ON o_orderkey = e.event_id // 100 * 10 + e.user_id % 10)"""


def reservation_rows(s: Source) -> DataFrame:
    rows, _ = epg.reservation_rows(_requests(s), epg.flatten_feed(feed(s)))
    return rows.drop("rec_folder_list", "partial_rec_folder")


_SETTINGS = ", ".join(
    (f"'{v}'" if isinstance(v, str) else str(v).lower()) + f" AS {k}" for k, v in epg.RESERVATION_SETTINGS.items())
RESERVATION_ROWS = f"""WITH {_FLAT}, {_REQUESTS}
SELECT r.request_id, r.onid, r.tsid, r.sid, r.eid, f.event_name AS title, f.start_time, f.start_time AS start_time_epg,
    f.duration AS duration_second, '' AS station_name, {_SETTINGS}
FROM requests r JOIN flat f ON f.onid = r.onid AND f.tsid = r.tsid AND f.sid = r.sid AND f.eid = r.eid
WHERE f.start_time >= r.requested_at AND f.start_time < r.requested_at + INTERVAL 1 DAY
QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY f.svc_pos, f.evt_pos) = 1"""


def reservations_missed(s: Source) -> DataFrame:
    _, missed = epg.reservation_rows(_requests(s), epg.flatten_feed(feed(s)))
    return missed.select("request_id", "requested_at")


RESERVATIONS_MISSED = f"""WITH {_FLAT}, {_REQUESTS} SELECT request_id, requested_at FROM requests r WHERE NOT EXISTS (
    SELECT 1 FROM flat f WHERE f.onid = r.onid AND f.tsid = r.tsid AND f.sid = r.sid AND f.eid = r.eid
      AND f.start_time >= r.requested_at AND f.start_time < r.requested_at + INTERVAL 1 DAY)"""


def service_keys(s: Source) -> DataFrame:
    """Packed services and recorder ticks of every order."""
    return s.read("orders").select(
        "o_orderkey",
        ids.service_key(4 + F.col("o_custkey") % 3, 100 + F.col("o_custkey") % 16, 101 + F.col("o_custkey") % 8).alias("service_key"),
        clock.file_time(F.col("o_orderdate"), True).alias("file_time"),
        clock.file_time(F.col("o_orderdate"), True, 9).alias("file_time_jst"))


SERVICE_KEYS = """SELECT o_orderkey, CAST((4 + o_custkey % 3) * 4294967296 + (100 + o_custkey % 16) * 65536 + 101 + o_custkey % 8 AS BIGINT) AS service_key,
    (epoch_us(o_orderdate) - 32400000000) * 10 + 116444736000000000 AS file_time,
    epoch_us(o_orderdate) * 10 + 116444736000000000 AS file_time_jst FROM orders"""


def channel_list(s: Source) -> DataFrame:
    """Channel lines made of the parts; some are short, some hold no numbers."""
    n = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    line = F.concat_ws("\t", "p_name", "p_brand", n, size, n, F.lit("1"), F.lit("0"), F.lit("1"))
    full = F.when(F.col("p_type") == "SMALL", line).when(F.col("p_size") > 40, F.concat(line, F.lit("\tx"))).otherwise(
        F.concat(line, F.lit("\t"), size, F.lit("\textra")))
    return epg.channel_list(s.read("part").select(full.alias("value")))


CHANNEL_LIST = """SELECT p_name AS service_name, p_brand AS network_name, p_partkey AS onid, CAST(p_size AS BIGINT) AS tsid, p_partkey AS sid,
    CAST(1 AS BIGINT) AS service_type, false AS partial_flag, true AS epg_cap_flag, p_size <> 0 AS search_flag
FROM part WHERE p_type <> 'SMALL' AND p_size <= 40"""


def _ext_text() -> F.Column:
    """Messages as extended text: every line but the first is a heading, commas end it."""
    return F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n- ")), F.lit(", "), F.lit("\n"))


def ext_headings(s: Source) -> DataFrame:
    found = s.read("conversations").select("conv_id", "turn", F.explode(text.headings(_ext_text())).alias("h"))
    return found.select("conv_id", "turn", "h.ordinal", "h.heading", "h.body")


EXT_HEADINGS = """WITH ext AS (SELECT conv_id, turn, string_split(chr(10) || replace(replace(text, chr(10), chr(10) || '- '), ', ', chr(10)), chr(10) || '- ') AS p
    FROM conversations),
pieces AS (SELECT conv_id, turn, i - 1 AS ordinal, CASE WHEN i = 1 THEN substr(p[1], 2) ELSE p[i] END
    || CASE WHEN i < len(p) AND NOT (i = 1 AND p[1] = '') THEN chr(10) ELSE '' END AS piece
    FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM ext))
SELECT conv_id, turn, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN ordinal = 0 THEN '' ELSE split_part(piece, chr(10), 1) END AS heading,
    CASE WHEN ordinal = 0 THEN piece WHEN contains(piece, chr(10)) THEN substr(piece, strpos(piece, chr(10)) + 1) ELSE '' END AS body
FROM pieces WHERE NOT (ordinal = 0 AND piece = '')"""


def imported_times(s: Source) -> DataFrame:
    """Times that come as JSON text: whole seconds, ISO text, and things that are no times."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.concat(
        F.lit("["), clock.epoch_seconds(F.col("ts"), True).cast("string"), F.lit(', "'), iso, F.lit('+09:00", "'), iso,
        F.lit('Z", '), F.when(F.col("event_type") == "error", '"no time", null').otherwise("1.5"), F.lit("]"))
    times = F.transform(clock.json_times(raw), lambda t: F.unix_micros(t).cast("string"))
    return s.read("events").select("event_id", F.array_join(times, ",").alias("micros"))


IMPORTED_TIMES = """SELECT event_id, concat_ws(',', (epoch_us(ts) // 1000000 - 32400) * 1000000,
    (epoch_us(ts) // 1000000 - 32400) * 1000000, epoch_us(ts) // 1000000 * 1000000) AS micros FROM events"""

QUERIES = {
    "epg_flat": (epg_flat, EPG_FLAT),
    "epg_unique": (epg_unique, EPG_UNIQUE),
    "epg_window": (epg_window, EPG_WINDOW),
    "reservation_rows": (reservation_rows, RESERVATION_ROWS),
    "reservations_missed": (reservations_missed, RESERVATIONS_MISSED),
    "service_keys": (service_keys, SERVICE_KEYS),
    "channel_list": (channel_list, CHANNEL_LIST),
    "ext_headings": (ext_headings, EXT_HEADINGS),
    "imported_times": (imported_times, IMPORTED_TIMES),
}
