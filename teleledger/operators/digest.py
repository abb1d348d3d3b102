"""The backlog: recordings kept but not yet watched enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleledger.functions import clock, text
from teleledger.operators.nesting import nested_by_program, with_nested
from teleledger.operators.paging import kept, page_of

# One view stands for five minutes; watched below this share is unfinished.
SAMPLE_SECONDS = 300
FINISHED_SHARE = 0.8
# Fixed value: a marker covers two samples.
MARKER_SECONDS = 2 * SAMPLE_SECONDS


def watched_seconds(views: DataFrame) -> DataFrame:
    """``program_id, watched_seconds``, pre-aggregated before the shuffle."""
    return views.groupBy("program_id").agg(
        (F.count("viewed_time") * SAMPLE_SECONDS).alias("watched_seconds"))


def unfinished(programs: DataFrame, recordings: DataFrame, views: DataFrame, name: str = "",
               case_sensitive: bool = False) -> DataFrame:
    """Every program with an open recording and too few views, with its watched seconds."""
    open_files = (
        recordings.filter("watched_at IS NULL AND deleted_at IS NULL").select("program_id").distinct())
    shows = programs.select(F.col("id").alias("program_id"), "name", "service_id", "start_time", "duration")
    if name:
        shows = shows.filter(text.contains(F.col("name"), name, case_sensitive))
    # All three sides end up hashed by program_id, so the joins add no further shuffle.
    return (
        shows.join(open_files, "program_id", "left_semi")
        .join(watched_seconds(views), "program_id", "left")
        .withColumn("watched_seconds", F.coalesce("watched_seconds", F.lit(0).cast("bigint")))
        .filter(F.col("watched_seconds") < F.col("duration") * F.lit(FINISHED_SHARE))
        .withColumnRenamed("program_id", "id")
    )


def digestions(programs: DataFrame, recordings: DataFrame, views: DataFrame, name: str = "", page: int = 1,
               size: int = 100, ascending: bool = False, case_sensitive: bool = False) -> DataFrame:
    """One page of the backlog, newest first unless ``ascending``, with view times."""
    order = F.asc("start_time") if ascending else F.desc("start_time")
    rows = kept(page_of(unfinished(programs, recordings, views, name, case_sensitive),
                        [order, F.asc("id")], page, size, "start_time", not ascending))
    nested = nested_by_program(views, None, rows.select(F.col("id").alias("program_id")), size)
    return (
        with_nested(rows, nested, "id").drop("recordings")
        .withColumn("end_time", clock.end_time())
        .withColumn("minutes", F.expr("duration div 60"))
        .orderBy(order, "id", "part")
    )


def view_positions(shows: DataFrame, views: DataFrame) -> DataFrame:
    """Where each view falls within its program: 0 at the start, 1 at the end, one row per view.

    Takes the programs' ``id``, ``start_time`` and ``duration``. A program without
    length has no positions.
    """
    wall = clock.is_wall_clock(shows, "start_time")
    # Text columns of the programs are not carried through the join.
    spans = shows.select(F.col("id").alias("program_id"), "start_time", "duration").filter("duration > 0")
    after = (clock.epoch_seconds(F.col("viewed_time"), wall) - clock.epoch_seconds(F.col("start_time"), wall))
    return (
        views.filter(F.col("viewed_time").isNotNull()).select("program_id", "viewed_time")
        .join(spans, "program_id")
        .select(
            "program_id", "viewed_time",
            (after / F.col("duration")).alias("position"),
            (F.lit(MARKER_SECONDS) / F.col("duration")).alias("marker_width"))
    )
