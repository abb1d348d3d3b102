"""Player reports, and streams run to completion over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger import schema
from teleledger.functions import clock
from teleledger.plans.queries_ingest import _LATE, _VIEW_ARRIVALS, _fold, sightings, view_arrivals
from teleledger.plans.tables import Source, with_tables
from teleledger.session import checkpoint_root, cut
from teleledger.sources import commits, tables
from teleledger.streaming import jobs, player, programs


def status_lines(s: Source, events: DataFrame | None = None) -> DataFrame:
    """Every event is a player report; fields a kind of event lacks are absent from its JSON."""
    kind = F.col("event_type")
    events = s.read("events") if events is None else events
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    report = F.to_json(F.struct(
        F.when(kind == "purchase", "finished").when(kind == "view", "playing").alias("play_status"),
        F.col("user_id").alias("current_event_id"), (F.col("event_id") % 8 + 101).alias("current_event_service_id"),
        kind.alias("current_event_name"), F.concat(iso, F.lit("+09:00")).alias("current_event_start_time"),
        F.when(F.col("value") > 1, F.lit(1800)).alias("current_event_duration"),
        F.when(kind != "error", F.col("event_id") % 256).alias("current_content_nibble"),
        F.when(kind == "click", iso).otherwise(F.concat(iso, F.lit("Z"))).alias("tot"),
        F.when(kind != "view", F.col("event_id") % 200).alias("speed")))
    return events.select("event_id", report.alias("value"))


def status_to_view(s: Source) -> DataFrame:
    rows = player.status_to_view(status_lines(s))
    return rows.select(
        "event_id", F.col("program.event_id").alias("eid"), "program.service_id", "program.name", "program.duration",
        "program.genre", F.unix_micros("program.start_time").alias("start_us"),
        F.unix_micros("viewed_time").alias("viewed_us"), "speed")


STATUS_TO_VIEW = """SELECT event_id, user_id AS eid, event_id % 8 + 101 AS service_id, event_type AS name, CAST(1800 AS BIGINT) AS duration,
    CAST(event_id % 256 AS VARCHAR) AS genre, (epoch_us(ts) // 1000000 - 32400) * 1000000 AS start_us,
    (epoch_us(ts) // 1000000 - CASE WHEN event_type = 'click' THEN 32400 ELSE 0 END) * 1000000 AS viewed_us,
    CASE WHEN event_type <> 'view' THEN (event_id % 200) / 100.0::DOUBLE ELSE 1.0::DOUBLE END AS speed
FROM events WHERE event_type NOT IN ('purchase', 'error') AND value > 1"""


def status_rejected(s: Source) -> DataFrame:
    return player.rejected_status(status_lines(s)).select("event_id")


STATUS_REJECTED = "SELECT event_id FROM events WHERE event_type = 'error' OR (event_type <> 'purchase' AND value <= 1)"


# ---- streams ----

def _event_stream(s: Source) -> DataFrame:
    return (
        s.spark.readStream.schema(s.read("events").schema).option("pathGlobFilter", "events.parquet")
        .parquet(s.directory))


def _run(s: Source, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over everything there is; every micro-batch leaves its rows with its number."""
    root = f"{checkpoint_root(s.spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/n={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return s.spark.read.parquet(f"{root}/out").drop("n")


def stream_status_to_view(s: Source) -> DataFrame:
    """The same reports as a stream, counted per program and hour seen."""
    views = player.status_to_view(status_lines(s, _event_stream(s)))
    out = _run(s, views.select("program.name", F.unix_micros("viewed_time").alias("us"), "speed"), "append")
    return out.groupBy("name", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("speed") * 100)).cast("bigint").alias("speed"))


STREAM_STATUS_TO_VIEW = f"""SELECT name, viewed_us // 3600000000 AS hour, count(*) AS n,
    CAST(sum(round(speed * 100)) AS BIGINT) AS speed FROM ({STATUS_TO_VIEW}) GROUP BY 1, 2"""


def stream_watched_windows(s: Source) -> DataFrame:
    """Seconds watched per program and five-minute window; later batches replace earlier counts."""
    seen = _event_stream(s).select(
        F.expr("event_id div 100 * 10 + user_id % 10").alias("program_id"),
        F.timestamp_micros(clock.epoch_micros(F.col("ts"), True)).alias("viewed_time"))
    out = _run(s, player.watched_windows(seen), "update")
    last = out.groupBy("program_id", "window_start").agg(F.max_by("watched_seconds", "batch").alias("watched_seconds"))
    return last.select("program_id", F.unix_seconds("window_start").alias("window_start"), "watched_seconds")


STREAM_WATCHED_WINDOWS = """SELECT event_id // 100 * 10 + user_id % 10 AS program_id,
    (epoch_us(ts) // 1000000 - 32400) // 300 * 300 AS window_start, count(*) * 300 AS watched_seconds FROM events GROUP BY 1, 2"""


def stream_program_changes(s: Source) -> DataFrame:
    """Program get-or-create with state, over sightings that come late and out of order."""
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    wall = sightings(Streamed(s), late=True)
    instants = wall.select(
        "event_id", "service_id", "duration", "seq",
        *[F.timestamp_micros(clock.epoch_micros(F.col(c), True)).alias(c) for c in ("start_time", "viewed_time", "created_at")])
    out = _run(s, programs.program_changes(instants), "append")
    return out.select("event_id", "seq", "program_id")


#: Rows of a file of a feed, about: a task writes one.
_FEED_ROWS = 500_000


def _in_batches(s: Source, rows: DataFrame, batches: int = 3, share: int = _FEED_ROWS) -> DataFrame:
    """The rows as a stream of several micro-batches, in order of ``seq``; each has the same number of files, as many as its rows need."""
    folder = f"{checkpoint_root(s.spark)}/feed-{uuid.uuid4().hex}"
    rows = cut(rows)
    # Where batches end is of no consequence, so a summary of bounded size will do.
    ends = rows.approxQuantile("seq", [k / batches for k in range(1, batches)], 0.01)
    files = max(1, -(-rows.count() // (batches * share)))
    place = sum([(F.col("seq") > end).cast("int") for end in ends], F.lit(0))
    placed = rows.withColumn("place", place)
    for k in range(batches):
        batch = placed.filter(F.col("place") == k).drop("place")
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(folder)
        # A micro-batch is a number of files: tasks without a row leave none.
        for _ in range((k + 1) * files - sum(x.endswith(".parquet") for x in commits.names_in(s.spark, folder))):
            batch.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _instants(wall: DataFrame) -> DataFrame:
    times = [F.timestamp_micros(clock.epoch_micros(F.col(c), True)).alias(c) for c in ("start_time", "viewed_time", "created_at")]
    return wall.select("event_id", "service_id", "duration", F.col("seq").cast("long").alias("seq"), *times)


def stream_program_changes_seeded(s: Source) -> DataFrame:
    """The same in three micro-batches, the state begun with the stored programs: rows hours late, and starts far ahead."""
    s.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    feed = _in_batches(s, _instants(sightings(s, late=True)))
    out = _run(s, programs.program_changes(feed, s.programs), "append")
    return out.select("event_id", "seq", "program_id")


class Streamed(Source):
    """The same tables with the events as a stream."""

    def __init__(self, s: Source) -> None:
        super().__init__(s.spark, s.directory)

    def read(self, name: str) -> DataFrame:
        return _event_stream(Source(self.spark, self.directory)) if name == "events" else super().read(name)


STREAM_PROGRAM_CHANGES = with_tables(f""", {_fold(_LATE, 'SELECT * FROM programs WHERE false')}
SELECT event_id, seq, matched AS program_id FROM steps WHERE k > 0""", "programs", recursive=True)

# ---- stored tables, and streams that land in them ----

_DAYS = {"programs": ("1995-02-01", "1996-01-31"), "recordings": ("1995-02-01", "1996-01-31"), "views": ("2024-01-05", "2024-01-20")}


def _stored_form(df: DataFrame) -> DataFrame:
    """Wall-clock times as the instants that stored tables hold."""
    wall = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.timestamp_micros(clock.epoch_micros(F.col(c), True)) for c in wall})


def _shown(df: DataFrame) -> DataFrame:
    """Times as microseconds, which have no zone."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.unix_micros(c) for c in times})


def _scratch(s: Source, name: str) -> str:
    return f"{checkpoint_root(s.spark)}/{name}-{uuid.uuid4().hex}"


_KEPT = {"programs": ["id", "event_id", "service_id", "name", "start_time", "duration"],
         "recordings": ["id", "program_id", "file_path", "file_size", "created_at"], "views": ["program_id", "viewed_time", "speed"],
         "series": ["id", "name", "created_at"], "program_series": ["program_id", "series_id"]}


def _read_back(s: Source, root: str, name: str, id_type: T.DataType | None = None) -> DataFrame:
    days = dict(zip(("from_", "to"), _DAYS.get(name, ())))
    return _shown(tables.read_table(s.spark, root, name, id_type=id_type or T.LongType(), **days).select(*_KEPT[name]))


def _stored(name: str):
    def build(s: Source) -> DataFrame:
        root = _scratch(s, "tables")
        tables.write_snapshot(_stored_form(getattr(s, name)), root, name, 1)
        return _read_back(s, root, name)

    build.__name__, build.__doc__ = f"stored_{name}", f"The {name} table written and read back, the days of a year of it if it has days."
    return build


def _kept_sql(name: str) -> str:
    time = schema.PARTITION_TIME.get(name)
    shown = ", ".join(f"epoch_us({c}) - 32400000000 AS {c}" if c.endswith("_time") or c.endswith("_at") else c for c in _KEPT[name])
    days = f" WHERE CAST({time} AS DATE) BETWEEN DATE '{_DAYS[name][0]}' AND DATE '{_DAYS[name][1]}' + 1" if time else ""
    return with_tables(f"SELECT {shown} FROM {name}{days}", name)


def _landed(name: str, order: str, batches: int = 3):
    def build(s: Source) -> DataFrame:
        root = _scratch(s, "tables")
        rows = _stored_form(getattr(s, name))
        fields = schema.TABLES[name](rows.schema["program_id"].dataType)
        feed = _in_batches(s, rows.withColumn("seq", F.col(order).cast("long")), batches)
        jobs.append_to_table(feed.select(*fields.names), root, name, f"{root}/state", once=True).awaitTermination()
        return _read_back(s, root, name)

    build.__name__, build.__doc__ = f"stream_{name}_landed", f"The {name} appended by a stream of {batches} micro-batches, and read back from the table."
    return build


def _view_job(s: Source) -> str:
    """The view arrivals as a stream in three micro-batches; the tables begin with nothing."""
    root = _scratch(s, "tables")
    arrivals = view_arrivals(s)
    start = F.timestamp_micros(clock.epoch_micros(F.col("program.start_time"), True))
    arrivals = _stored_form(arrivals.withColumn("program", F.col("program").withField("start_time", start)))
    feed = _in_batches(s, arrivals.withColumn("seq", F.col("seq").cast("long")))
    jobs.ingest_views(feed, root, f"{root}/state", once=True).awaitTermination()
    return root


def stream_view_ingest(s: Source) -> DataFrame:
    """The views that the job appended."""
    views = tables.read_table(s.spark, _view_job(s), "views", id_type=T.StringType())
    return _shown(views.select("program_id", "viewed_time", "speed"))


STREAM_VIEW_INGEST = with_tables(f""", {_fold(_VIEW_ARRIVALS, 'SELECT * FROM programs WHERE false')}
SELECT s.matched AS program_id, epoch_us(a.viewed_time) - 32400000000 AS viewed_time, a.speed
FROM steps s JOIN arrivals a ON a.seq = s.seq WHERE s.k > 0""", "programs", recursive=True)


def stream_view_ingest_programs(s: Source) -> DataFrame:
    """The programs after the same job."""
    programs_ = tables.read_table(s.spark, _view_job(s), "programs", id_type=T.StringType())
    return _shown(programs_.select("id", "event_id", "service_id", "name", "start_time", "duration", "genre", "created_at"))


_NEW = """SELECT r.id AS id, event_id, service_id, r.name AS name, r.start AS start_time, r.dur AS duration, r.genre AS genre,
    r.created AS created_at FROM final"""

STREAM_VIEW_INGEST_PROGRAMS = with_tables(f""", {_fold(_VIEW_ARRIVALS, 'SELECT * FROM programs WHERE false')}
SELECT id, event_id, service_id, name, epoch_us(start_time) - 32400000000 AS start_time, duration, genre,
    epoch_us(created_at) - 32400000000 AS created_at FROM ({_NEW})""", "programs", recursive=True)

STREAM_PROGRAM_CHANGES_SEEDED = with_tables(f""", {_fold(_LATE, 'SELECT * FROM programs')}
SELECT event_id, seq, matched AS program_id FROM steps WHERE k > 0""", "programs", recursive=True)

QUERIES = {
    "status_to_view": (status_to_view, STATUS_TO_VIEW),
    "status_rejected": (status_rejected, STATUS_REJECTED),
    "stream_status_to_view": (stream_status_to_view, STREAM_STATUS_TO_VIEW),
    "stream_watched_windows": (stream_watched_windows, STREAM_WATCHED_WINDOWS),
    "stream_program_changes": (stream_program_changes, STREAM_PROGRAM_CHANGES),
    "stream_program_changes_seeded": (stream_program_changes_seeded, STREAM_PROGRAM_CHANGES_SEEDED),
    **{f"stored_{name}": (_stored(name), _kept_sql(name)) for name in _KEPT},
    "stream_views_landed": (_landed("views", "program_id"), _kept_sql("views")),
    "stream_recordings_landed": (_landed("recordings", "id", 2), _kept_sql("recordings")),
    "stream_view_ingest": (stream_view_ingest, STREAM_VIEW_INGEST),
    "stream_view_ingest_programs": (stream_view_ingest_programs, STREAM_VIEW_INGEST_PROGRAMS),
}
