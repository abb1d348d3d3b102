"""Program upserts, view and recording ingestion, and recorder reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger.functions import clock
from teleledger.operators import ingest, upsert
from teleledger.plans.tables import Source, with_tables

_SHOWN = ["id", "event_id", "service_id", "name", "start_time", "duration", "genre", "created_at"]


def _minutes(column: str, n: Column) -> Column:
    return F.timestamp_add("MINUTE", n, F.col(column))


# ---- sightings: every event is a sighting of a program keyed by its user ----

def sightings(s: Source, late: bool = False) -> DataFrame:
    """``late``: reports of some kinds reach us long after those of others."""
    kind = F.col("event_type")
    delay = F.when(kind == "error", 900).when(kind == "signup", 300).otherwise(0) if late else F.lit(0)
    return s.read("events").select(
        F.col("user_id").alias("event_id"), F.lit(1).cast("bigint").alias("service_id"), kind.alias("name"),
        F.col("ts").alias("start_time"), (F.lit(900) * (1 + F.col("event_id") % 8)).alias("duration"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("ext_text"),
        F.col("props").alias("genre"),
        _minutes("ts", F.lit(5)).alias("viewed_time"), _minutes("ts", F.lit(5)).alias("created_at"),
        ((F.col("event_id") + delay) * 4 + F.when(kind == "error", 1).when(kind == "signup", 2).otherwise(0)
         ).cast("bigint").alias("seq") if late else F.col("event_id").alias("seq"),
    )


def program_upsert(s: Source) -> DataFrame:
    return upsert.upsert_programs(s.programs, sightings(s)).apply(s.programs).select(*_SHOWN)


_MINTED = "sha256(concat_ws('|', {e}, {s}, epoch_us({start}) - 32400000000, {seq}))"
_TABLE = "SELECT CAST(id AS VARCHAR) AS id, event_id, service_id, name, start_time, duration, genre, created_at FROM programs"

PROGRAM_UPSERT = with_tables(f""", gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
grouped AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM gaps),
topped AS (SELECT *, max(ts) OVER (PARTITION BY user_id, grp) AS top,
    min(event_id) OVER (PARTITION BY user_id, grp) AS first_id,
    min(ts) OVER (PARTITION BY user_id, grp) AS first_ts FROM grouped)
{_TABLE} UNION ALL
SELECT {_MINTED.format(e='user_id', s='1', start='first_ts', seq='first_id')} AS id, user_id AS event_id, 1 AS service_id,
    arg_min(event_type, event_id) AS name, top AS start_time,
    coalesce(arg_max(900 * (1 + event_id % 8), event_id) FILTER (WHERE ts > first_ts), arg_min(900 * (1 + event_id % 8), event_id)) AS duration,
    arg_min(props, event_id) AS genre, first_ts + INTERVAL 5 MINUTE AS created_at
FROM topped WHERE ts = top GROUP BY user_id, grp, top, first_ts, first_id""", "programs")


def program_upsert_disordered(s: Source) -> DataFrame:
    return upsert.upsert_programs(s.programs, sightings(s, late=True)).apply(s.programs).select(*_SHOWN)


def _fold(arrivals: str, stored: str) -> str:
    """Arrival by arrival, all keys side by side: the rule as it reads."""
    made = _MINTED.format(e="j.event_id", s="j.service_id", start="j.start_time", seq="j.seq")
    return f"""arrivals AS ({arrivals}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id, service_id ORDER BY seq) AS k FROM arrivals),
stored AS ({stored}),
steps AS (
    SELECT a.event_id, a.service_id, 0 AS k, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS matched,
        coalesce((SELECT list({{'id': CAST(p.id AS VARCHAR), 'start': p.start_time, 'dur': CAST(p.duration AS BIGINT), 'name': p.name,
            'genre': p.genre, 'created': p.created_at}}) FROM stored p WHERE p.event_id = a.event_id AND p.service_id = a.service_id), []) AS rows
    FROM (SELECT DISTINCT event_id, service_id FROM arrivals) a
    UNION ALL
    SELECT j.event_id, j.service_id, j.k, j.seq,
        CASE WHEN j.cand IS NULL THEN {made} ELSE list_filter(j.rows, lambda x: x.start = j.cand)[1].id END,
        CASE WHEN j.cand IS NULL THEN list_append(j.rows, {{'id': {made}, 'start': j.start_time, 'dur': CAST(j.duration AS BIGINT),
                'name': j.name, 'genre': j.genre, 'created': j.created_at}})
             WHEN j.start_time > j.cand THEN list_transform(j.rows, lambda x: CASE WHEN x.start = j.cand THEN {{'id': x.id, 'start': j.start_time,
                'dur': CAST(j.duration AS BIGINT), 'name': j.name, 'genre': j.genre, 'created': x.created}} ELSE x END)
             WHEN j.start_time = j.cand THEN list_transform(j.rows, lambda x: CASE WHEN x.start = j.cand AND x.created < j.viewed_time
                THEN {{'id': x.id, 'start': x.start, 'dur': CAST(j.duration AS BIGINT), 'name': x.name, 'genre': x.genre, 'created': x.created}} ELSE x END)
             ELSE j.rows END
    FROM (SELECT s.rows, r.*, list_max(list_transform(list_filter(s.rows, lambda x: x.start >= r.start_time - INTERVAL 12 HOUR
            AND x.start <= r.start_time + INTERVAL 12 HOUR), lambda x: x.start)) AS cand
          FROM steps s JOIN ranked r ON r.event_id = s.event_id AND r.service_id = s.service_id AND r.k = s.k + 1) j),
final AS (SELECT event_id, service_id, unnest(rows) AS r FROM
    (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY event_id, service_id ORDER BY k DESC) = 1))"""


_FINAL = """SELECT CAST(id AS VARCHAR) AS id, event_id, service_id, name, start_time, duration, genre, created_at FROM programs p
    WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.r.id = CAST(p.id AS VARCHAR))
UNION ALL SELECT r.id, event_id, service_id, r.name, r.start, r.dur, r.genre, r.created FROM final"""

_LATE = """SELECT user_id AS event_id, 1 AS service_id, event_type AS name, ts AS start_time, 900 * (1 + event_id % 8) AS duration,
    props AS genre, ts + INTERVAL 5 MINUTE AS viewed_time, ts + INTERVAL 5 MINUTE AS created_at,
    (event_id + CASE event_type WHEN 'error' THEN 900 WHEN 'signup' THEN 300 ELSE 0 END) * 4
        + CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS seq FROM events"""
PROGRAM_UPSERT_DISORDERED = with_tables(f""", {_fold(_LATE, 'SELECT * FROM programs')} {_FINAL}""", "programs", recursive=True)


# ---- views of known programs, some delayed, some early, some repeated the next morning ----

def view_arrivals(s: Source) -> DataFrame:
    kind = F.col("event_type")
    shift = F.when(kind == "purchase", 10).when(kind == "error", -10).when(kind == "signup", 780).otherwise(0)
    seen = s.read("events").select(
        F.expr("event_id div 100 * 10 + user_id % 10").alias("id"), F.col("event_id").alias("seq"), "event_type")
    rows = seen.join(s.programs, "id").withColumn("start_time", _minutes("start_time", shift))
    program = F.struct(
        "event_id", "service_id", F.concat("name", F.lit(" "), "event_type").alias("name"), "start_time",
        (F.col("duration") + F.when(kind == "click", 60).otherwise(0)).alias("duration"), "text", "ext_text", "genre")
    return rows.select(
        program.alias("program"), _minutes("start_time", F.expr("seq % 6 * 5")).alias("viewed_time"),
        F.when(kind != "view", 1.25).alias("speed"), "seq")


_VIEW_ARRIVALS = """SELECT p.event_id, p.service_id, p.name || ' ' || e.event_type AS name, p.start_time + to_minutes(e.shift) AS start_time,
    p.duration + CASE WHEN e.event_type = 'click' THEN 60 ELSE 0 END AS duration, p.genre,
    p.start_time + to_minutes(e.shift + e.seq % 6 * 5) AS viewed_time, p.start_time + to_minutes(e.shift + e.seq % 6 * 5) AS created_at,
    CASE WHEN e.event_type <> 'view' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS speed, e.seq
    FROM (SELECT event_id // 100 * 10 + user_id % 10 AS id, event_id AS seq, event_type,
        CASE event_type WHEN 'purchase' THEN 10 WHEN 'error' THEN -10 WHEN 'signup' THEN 780 ELSE 0 END AS shift FROM events) e
    JOIN programs p ON p.id = e.id"""


def view_ingest(s: Source) -> DataFrame:
    """The view rows to append."""
    entered = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return ingest.ingest_views(s.programs, view_arrivals(s), as_of=entered).views


VIEW_INGEST = with_tables(f""", {_fold(_VIEW_ARRIVALS, 'SELECT * FROM programs')}
SELECT s.matched AS program_id, a.viewed_time, a.speed, TIMESTAMP '2024-02-01' AS created_at
FROM steps s JOIN arrivals a ON a.seq = s.seq WHERE s.k > 0""", "programs", recursive=True)


def view_ingest_programs(s: Source) -> DataFrame:
    """The programs after the same views."""
    return ingest.ingest_views(s.programs, view_arrivals(s)).upsert.apply(s.programs).select(*_SHOWN)


VIEW_INGEST_PROGRAMS = with_tables(f""", {_fold(_VIEW_ARRIVALS, 'SELECT * FROM programs')} {_FINAL}""", "programs", recursive=True)


# ---- genre ----

def program_genre_patch(s: Source) -> DataFrame:
    """Every event sets the genre of its program; errors clear it."""
    patches = s.read("events").select(
        F.expr("event_id div 100 * 10 + user_id % 10").alias("id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("genre"))
    return upsert.patch_genre(s.programs, patches).select("id", "name", "genre")


PROGRAM_GENRE_PATCH = with_tables(""", patches AS (SELECT event_id // 100 * 10 + user_id % 10 AS id,
    CASE WHEN event_type <> 'error' THEN event_type END AS genre FROM events
    QUALIFY row_number() OVER (PARTITION BY event_id // 100 * 10 + user_id % 10 ORDER BY event_id DESC) = 1)
SELECT p.id, p.name, CASE WHEN x.id IS NULL THEN p.genre ELSE x.genre END AS genre
FROM programs p LEFT JOIN patches x ON x.id = p.id""", "programs")


def genre_labels(s: Source) -> DataFrame:
    """Genre codes replaced by labels; the code table comes from the nations, some codes have none."""
    codes = s.read("nation").select(
        F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    coded = s.programs.withColumn("genre", (F.col("id") % 40).cast("string"))
    return upsert.label_genres(coded, codes).select("id", "genre")


GENRE_LABELS = with_tables("""SELECT p.id, coalesce(n.n_name, CAST(p.id % 40 AS VARCHAR)) AS genre
FROM programs p LEFT JOIN nation n ON n.n_nationkey = p.id % 40""", "programs")


# ---- recordings ----

def recording_arrivals(s: Source) -> DataFrame:
    """Every line item is a recording of its order's program; some paths are malformed."""
    # Dealt by order once, for the lines' aggregate and for the join with the programs.
    line = s.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate").repartition("l_orderkey")
    line = line.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.char(F.min(F.ascii("l_returnflag"))).alias("flag"), F.min("l_shipdate").alias("at"))
    rows = line.join(s.programs.drop("created_at"), F.col("l_orderkey") == F.col("id"))
    program = F.struct("event_id", "service_id", "name", "start_time", "duration", "text", "ext_text", "genre")
    path = F.concat(F.when(F.col("flag") == "R", "/").otherwise("//"), F.lit("nas/rec/"), F.col("part").cast("string"))
    return rows.select(
        program.alias("program"), path.alias("file_path"), F.col("part").alias("file_size"),
        F.when(F.col("flag") == "A", F.col("at")).alias("watched_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.col("at").alias("created_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


_RECORDING_ARRIVALS = """rec AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey, min(l_partkey) AS part,
    min(l_returnflag) AS flag, min(l_shipdate) AS made_at FROM lineitem GROUP BY l_orderkey, l_linenumber),
ok AS (SELECT r.*, '//nas/rec/' || CAST(part AS VARCHAR) AS file_path, p.name, CAST(p.id AS VARCHAR) AS program_id
    FROM rec r JOIN programs p ON p.id = r.l_orderkey WHERE flag <> 'R')"""


def recording_ingest(s: Source) -> DataFrame:
    """Stored recordings of the valid arrivals, with the series each one's program went into."""
    done = ingest.ingest_recordings(s.programs, s.series, s.program_series, recording_arrivals(s))
    return done.with_series()


_TITLE = "trim(regexp_replace(regexp_replace(name, '(?i)#\\s*\\d+', ' ', 'g'), '\\s*-.*$', ''))"
RECORDING_INGEST = with_tables(f""", {_RECORDING_ARRIVALS}, titled AS (SELECT *, {_TITLE} AS title FROM ok)
SELECT sha256(concat_ws('|', 'recording', program_id, file_path, seq)) AS id, program_id, file_path, part AS file_size,
    CASE WHEN flag = 'A' THEN made_at END AS watched_at, CAST(NULL AS TIMESTAMP) AS deleted_at, made_at AS created_at, title,
    sha256('series|' || title) AS series_id FROM titled""", "programs")


def recorder_reports(s: Source) -> DataFrame:
    """Recorder reports: one per line item; a part's type is the genre some reports carry."""
    part = s.read("part").select("p_partkey", "p_name", "p_type", "p_size")
    line = s.read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    info = F.when(F.col("p_size") > 20, F.concat(
        F.lit("title\n\nジャンル : "), F.col("p_type"), F.lit("\r\n映像 : x"))).otherwise("no genre here")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(
            F.concat(F.lit("\\rec\\"), F.col("l_partkey").cast("string"), F.lit(".ts"))).alias("rec_file_path"),
        F.col("p_name").alias("title"), F.col("l_shipdate").alias("start_time"),
        (F.col("l_quantity") * 60).cast("bigint").alias("duration_sec"),
        F.col("l_suppkey").alias("sid"), F.col("l_partkey").alias("eid"),
        F.col("l_shipdate").alias("start_time_epg"), info.alias("program_info"))


_REPORTS = """reports AS (SELECT l_orderkey * 10 + l_linenumber AS seq, '//nas/rec/' || CAST(l_partkey AS VARCHAR) || '.ts' AS file_path,
    p_name AS name, l_shipdate AS start_time, CAST(l_quantity * 60 AS BIGINT) AS duration, l_suppkey AS service_id,
    l_partkey AS event_id, CASE WHEN p_size > 20 THEN p_type END AS genre FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_returnflag <> 'A')"""
_AT = "2024-03-01 12:00:00"


def recinfo_to_recording(s: Source) -> DataFrame:
    """File sizes come from a listing that lacks the small parts."""
    listing = s.read("part").filter("p_size > 5").select(
        F.concat(F.lit("//nas/rec/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"),
        (F.col("p_size").cast("bigint") * 1_000_000).alias("length"))
    rows = ingest.from_recorder(recorder_reports(s), "\\\\nas", F.lit(_AT).cast("timestamp_ntz"), listing)
    return rows.select("program.*", "file_path", "file_size", "created_at", "seq").drop("text", "ext_text")


RECINFO_TO_RECORDING = f"""WITH {_REPORTS} SELECT event_id, service_id, name, start_time, duration, genre, file_path,
    CASE WHEN p_size > 5 THEN CAST(p_size AS BIGINT) * 1000000 END AS file_size, TIMESTAMP '{_AT}' AS created_at, seq
FROM reports JOIN part ON p_partkey = event_id"""


def recinfo_to_view(s: Source) -> DataFrame:
    rows = ingest.views_from_recorder(recorder_reports(s), F.lit(_AT).cast("timestamp_ntz"))
    return rows.select("program.*", "viewed_time", "speed", "created_at", "seq").drop("text", "ext_text")


RECINFO_TO_VIEW = f"""WITH {_REPORTS} SELECT event_id, service_id, name, start_time, duration, genre, start_time AS viewed_time,
    1.0::DOUBLE AS speed, TIMESTAMP '{_AT}' AS created_at, seq FROM reports"""

QUERIES = {
    "program_upsert": (program_upsert, PROGRAM_UPSERT),
    "program_upsert_disordered": (program_upsert_disordered, PROGRAM_UPSERT_DISORDERED),
    "view_ingest": (view_ingest, VIEW_INGEST),
    "view_ingest_programs": (view_ingest_programs, VIEW_INGEST_PROGRAMS),
    "program_genre_patch": (program_genre_patch, PROGRAM_GENRE_PATCH),
    "genre_labels": (genre_labels, GENRE_LABELS),
    "recording_ingest": (recording_ingest, RECORDING_INGEST),
    "recinfo_to_recording": (recinfo_to_recording, RECINFO_TO_RECORDING),
    "recinfo_to_view": (recinfo_to_view, RECINFO_TO_VIEW),
}
