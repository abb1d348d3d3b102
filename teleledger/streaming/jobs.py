"""Continuous jobs. Each micro-batch goes through the same operators as a batch job, and lands in the tables as one commit each.

A batch that runs again after a failure finds what it has committed. A job started with a new checkpoint folder goes on from
the tables as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from teleledger import schema
from teleledger.functions import clock
from teleledger.operators import commands, ingest, recordings
from teleledger.sources import commits, tables
from teleledger.streaming.player import SAMPLE_TRIGGER


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=SAMPLE_TRIGGER)).start()


def append_views(views: DataFrame, path: str, checkpoint: str, once: bool = False,
                 replay_window: str | None = None) -> StreamingQuery:
    """Append view rows to Parquet, exactly once. Equal rows are kept, as they are samples, unless
    ``replay_window`` asks to drop repeats of a program and time within it; rows later than that are then dropped too.
    The day is Japan's, as the readers prune by it."""
    if replay_window:
        views = views.withWatermark("viewed_time", replay_window).dropDuplicatesWithinWatermark(
            ["program_id", "viewed_time"])
    dated = views.withColumn("day", clock.jst_date(F.col("viewed_time"), clock.is_wall_clock(views, "viewed_time")))
    writer = dated.writeStream.format("parquet").outputMode("append").partitionBy("day").option(
        "path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=SAMPLE_TRIGGER)).start()


def rewrite(df: DataFrame, path: str) -> None:
    """Output of one micro-batch; the batch may run again, so it replaces what it wrote."""
    df.write.mode("overwrite").parquet(path)


def _transaction(batch: DataFrame, number: int) -> commits.Transaction:
    """Which stream (of which checkpoint folder), and which of its micro-batches."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number


def append_to_table(rows: DataFrame, root: str, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append view or recording rows to the stored table. Equal rows are kept, as they are samples."""
    id_type = rows.schema["program_id"].dataType
    columns = [f.name for f in schema.TABLES[name](id_type).fields]

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commits.append(batch.select(*columns), root, name, _transaction(batch, number), tables.base_of(spark, root, name))
        commits.compact(spark, root, name, id_type)

    return _start(rows, step, checkpoint, once)


def ingest_views(arrivals: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Resolve programs and append views per micro-batch. Programs are committed first: should the batch run again, its arrivals
    find them there and name the same ones."""
    text_ids = T.StringType()

    def step(batch: DataFrame, number: int) -> None:
        spark, txn = batch.sparkSession, _transaction(batch, number)
        base = tables.base_of(spark, root, "programs")
        programs = commits.read(spark, root, "programs", base or commits.Commit(-1), text_ids)
        done = ingest.ingest_views(programs, batch)
        commits.merge(done.upsert.updated, done.upsert.inserted, root, "programs", txn, base)
        commits.append(done.views, root, "views", txn, tables.base_of(spark, root, "views"))
        for name in ("programs", "views"):
            commits.compact(spark, root, name, text_ids)

    return _start(arrivals, step, checkpoint, once)


def patches_to_commands(patches: DataFrame, root: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply patches per micro-batch and emit the file commands that follow, with refused patches beside them."""

    def step(batch: DataFrame, number: int) -> None:
        spark, (stream, _) = batch.sparkSession, _transaction(batch, number)
        base = tables.base_of(spark, root, "recordings")
        if base is not None and base.holds((stream, number)):
            return
        current = tables.read_table(spark, root, "recordings")
        after, judged = recordings.patch_recordings(current, batch)
        asked = judged.filter("status = 200").select("id").distinct()
        # The commands first: a batch that fails before its commit judges the same rows again.
        rewrite(commands.file_commands(judged).select("value"), f"{out}/commands/stream={stream}/batch={number:010d}")
        rewrite(judged.filter("status <> 200").select("id", "seq", "status"), f"{out}/refused/stream={stream}/batch={number:010d}")
        commits.merge(after.join(asked, "id", "left_semi").select(*current.columns), current.limit(0), root, "recordings", (stream, number), base)

    return _start(patches, step, checkpoint, once)


def take_commands(messages: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Route queued commands by action; text that is no command goes to the dead letters."""
    routed = commands.route_commands(commands.parse_commands(messages))
    writer = routed.writeStream.format("parquet").outputMode("append").partitionBy("route").option(
        "path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
