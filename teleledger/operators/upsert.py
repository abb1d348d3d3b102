"""Program get-or-create: which program an arrival belongs to, and what it changes.

An arrival matches the latest program of the same event and service that starts
within twelve hours either way. A later start moves the program and takes over
its details; an equal start may correct the duration; an earlier start changes
nothing; without a match a new program is made. Arrivals apply in ``seq`` order.

Rows never reach each other across a gap of more than twelve hours, so a key's
history falls into segments of starts. Per key only one summary row per half day
is ordered. A segment that spans at most twelve hours, or whose arrivals come in
order of start, has a closed form made of plain aggregates. The rest is replayed,
after dropping in blocks every arrival that provably changes nothing.

Keys do not touch each other: a large batch is written by shares of the keys and taken
a few shares at a time, so the shuffles on disk are those of one round.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger.functions import clock, ids
from teleledger.operators.scan import BLOCK
from teleledger.session import new_folder, remove, written

# Fixed value: how far apart two starts of one program may be, both ends included.
REACH = 12 * 3600 * 1_000_000
# Sorts before every arrival: the place of a program already stored.
STORED = -(2**62)

# Arrivals replayed by one Python call, about.
SHARE = 200_000
# Arrivals of one round, about, and the shares of keys that rounds are made of.
ROUND, SHARES = 4_000_000, 8

KEY = ["event_id", "service_id"]
DETAILS = ["name", "duration", "text", "ext_text", "genre"]
_PROGRAM = ["id", *KEY, "name", "start_time", "duration", "text", "ext_text", "genre", "created_at"]
# What an arrival learns about its program: the arrival (or stored row) that made
# it, the one that last moved it, and its final start and creation time.
_ROW = ["program_id", "head", "peak", "row_start", "row_created"]
_FOUND = T.StructType([T.StructField(n, T.StringType() if n == "program_id" else T.LongType()) for n in _ROW])


@dataclass(frozen=True)
class Upsert:
    """``resolved``: arrivals with ``program_id``; ``inserted`` and ``updated``: program rows."""

    resolved: DataFrame
    inserted: DataFrame
    updated: DataFrame

    def apply(self, programs: DataFrame) -> DataFrame:
        """The programs table afterwards; ids become text, as minted ids are."""
        rest = programs.withColumn("id", F.col("id").cast("string")).select(*_PROGRAM)
        # Updated ids are unique, and touch a small share of the table.
        rest = rest.join(self.updated.select("id"), "id", "left_anti")
        return rest.unionByName(self.updated).unionByName(self.inserted)


def _half_day_stats(entries: DataFrame) -> DataFrame:
    """One row per key and half day, through two partial aggregations on plain longs."""
    per_start = entries.groupBy(*KEY, "start_us").agg(
        F.min("ord").alias("first_ord"),
        F.max(F.when(F.col("ord") != STORED, F.col("ord"))).alias("last_seq"),
        F.min(F.when(F.col("ord") != STORED, F.col("ord"))).alias("first_seq"),
        F.min_by("created_us", "ord").alias("created_us"),
        F.sum(F.when(F.col("ord") == STORED, 1).otherwise(0)).alias("stored"),
        F.count("*").alias("n"),
    )
    return per_start.groupBy(*KEY, F.floor(F.col("start_us") / REACH).cast("bigint").alias("bucket")).agg(
        F.min("start_us").alias("lo"),
        F.max("start_us").alias("hi"),
        F.min("first_ord").alias("head"),
        F.min_by("start_us", "first_ord").alias("head_start"),
        F.min_by("created_us", "first_ord").alias("head_created"),
        F.max_by("first_ord", "start_us").alias("peak"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.sum("stored").alias("stored"),
        F.sum("n").alias("n"),
    )


def _placed(stats: DataFrame) -> DataFrame:
    """Half days with their segment, whether it has a closed form, and the program within it."""
    by_key = Window.partitionBy(*KEY).orderBy("bucket")
    gap = F.col("lo") - F.lag("hi").over(by_key) > REACH
    cut = stats.withColumn("segment", F.sum(F.when(gap, 1).otherwise(0)).over(by_key))

    within = Window.partitionBy(*KEY, "segment").orderBy("bucket")
    whole = Window.partitionBy(*KEY, "segment")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select(
        "*",
        F.coalesce(F.col("first_seq") <= F.max("last_seq").over(before), F.lit(False)).alias("late"),
        ((F.col("stored") > 0) & F.lag("hi").over(within).isNotNull()).alias("stored_late"),
        F.coalesce(F.col("head_start") - F.lag("hi").over(within) > REACH, F.lit(True)).alias("opens"),
    )
    ordered = ~F.max(F.col("late") | F.col("stored_late")).over(whole)
    short = F.max("hi").over(whole) - F.min("lo").over(whole) <= REACH
    cut = cut.select(
        "*",
        ((F.sum("stored").over(whole) <= 1) & (short | ordered)).alias("closed"),
        F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(within).alias("nth"),
        (F.max("last_seq").over(whole).isNotNull()).alias("touched"),
    )
    row = Window.partitionBy(*KEY, "segment", "nth")
    first = F.min("head").over(row)
    return cut.filter("touched").select(
        *KEY, "bucket", "segment", "closed", "n", F.sum("n").over(whole).alias("size"), first.alias("head"),
        F.min_by("head_start", "head").over(row).alias("head_start"),
        F.min_by("head_created", "head").over(row).alias("row_created"),
        F.max("hi").over(row).alias("row_start"),
        F.max_by("peak", "hi").over(row).alias("peak"),
    )


_KEPT = T.StructType([T.StructField(n, T.LongType()) for n in ("seq", "rep")])


def _thin(block: pd.DataFrame) -> pd.DataFrame:
    """Each arrival's stand-in: an earlier arrival of the same start with nothing in between
    that could move the program both match. It comes out as itself if there is none."""
    block = block.sort_values("seq")
    standing: dict[int, int] = {}
    starts: list[int] = []
    reps = []
    for seq, start in zip(block["seq"].tolist(), block["start_us"].tolist()):
        rep = standing.get(start)
        if rep is None:
            lo, hi = bisect_left(starts, start - 2 * REACH), bisect_left(starts, start)
            for gone in starts[lo:hi]:
                del standing[gone]
            starts[lo:hi] = [start]
            standing[start] = rep = seq
        reps.append(rep)
    return pd.DataFrame({"seq": block["seq"].to_numpy(), "rep": reps})


_REPLAYED = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("stored_id", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("head", "head_start", "peak", "row_start", "row_created")])


def _replay(segments: pd.DataFrame) -> pd.DataFrame:
    """Apply the arrivals of some segments in order; one line per arrival with its program's end state."""
    segments = segments.sort_values([*KEY, "segment", "ord", "start_us", "stored_id"])
    owners: list[tuple[int, dict]] = []
    here = None
    starts: list[int] = []
    rows: list[dict] = []
    columns = (segments[c].tolist() for c in (*KEY, "segment", "ord", "start_us", "created_us", "stored_id"))
    for event, service, segment, ord_, start, created, stored_id in zip(*columns):
        if here != (event, service, segment):
            here, starts, rows = (event, service, segment), [], []
        if ord_ == STORED:
            # Stored rows come first, by start; of equal starts the smallest id is met last.
            at = bisect_left(starts, start)
        else:
            at = bisect_right(starts, start + REACH) - 1
            if at >= 0 and starts[at] >= start - REACH:
                row = rows[at]
                if start > starts[at]:
                    starts[at] = row["row_start"] = start
                    row["peak"] = ord_
                owners.append((ord_, row))
                continue
            at += 1
        row = {"stored_id": stored_id, "head": ord_, "head_start": start, "peak": ord_, "row_start": start,
               "row_created": created}
        starts.insert(at, start)
        rows.insert(at, row)
        if ord_ != STORED:
            owners.append((ord_, row))
    matched = [{"seq": seq, **row} for seq, row in owners]
    return pd.DataFrame(matched, columns=_REPLAYED.names)


def _program_id(stored_id: str = "stored_id") -> F.Column:
    return F.coalesce(F.col(stored_id), ids.minted(*[F.col(k) for k in KEY], F.col("head_start"), F.col("head")))


def upsert_programs(programs: DataFrame, arrivals: DataFrame) -> Upsert:
    """Resolve a batch of arrivals against the stored programs.

    Arrivals: the program fields, ``viewed_time``, ``created_at`` (what a new program
    would get) and ``seq``, a whole number unique in the batch.
    """
    spark, wall = arrivals.sparkSession, clock.is_wall_clock(arrivals, "start_time")
    arrivals = arrivals.select(*[
        F.col(f.name).cast("string").alias(f.name) if f.dataType == T.NullType() else F.col(f.name) for f in arrivals.schema])
    # Each round reads its arrivals several times; they are worked out once. Keys are dealt as the programs have them.
    dealt = _share(*[F.col(k).try_cast(programs.schema[k].dataType) for k in KEY])
    arrived, told, replayed = (new_folder(spark, f"upsert-{name}") for name in ("arrived", "told", "replayed"))
    incoming = written(arrivals.withColumn("in_share", dealt), arrived, "in_share")
    rounds = min(incoming.count() // ROUND + 1, SHARES)
    any_replayed = False
    for number in range(rounds):
        lo, hi = number * SHARES // rounds, (number + 1) * SHARES // rounds - 1
        any_replayed |= _resolve(programs.filter(_share(*KEY).between(lo, hi)), incoming.filter(F.col("in_share").between(lo, hi)).drop("in_share"),
                                 wall, *(f"{path}/in_round={number}" for path in (told, replayed)))
        for share in range(lo, hi + 1):
            remove(spark, f"{arrived}/in_share={share}")
    remove(spark, arrived)

    # Ids and all table changes follow from these two tables.
    found = T.StructType([*arrivals.schema.fields, *_FOUND.fields])
    resolved = spark.read.schema(found).parquet(told).select(*found.names)
    if any_replayed:
        resolved = resolved.unionByName(spark.read.schema(found).parquet(replayed).select(*found.names))
    return Upsert(resolved.select(*arrivals.columns, "program_id"), *_changes(resolved, _touched(programs, resolved, wall), wall))


def _share(*keys: F.Column | str) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SHARES)).cast("int")


def _touched(programs: DataFrame, arrivals: DataFrame, wall: bool) -> DataFrame:
    """Only programs that share a key with some arrival take part."""
    return programs.join(arrivals.select(*KEY).distinct(), KEY, "left_semi").select(
        F.col("id").cast("string").alias("id"), *_PROGRAM[1:], clock.epoch_micros(F.col("start_time"), wall).alias("start_us"))


def _resolve(programs: DataFrame, incoming: DataFrame, wall: bool, told_path: str, replayed_path: str) -> bool:
    """Write the arrivals of some keys, each with its program; whether some had to be replayed."""
    spark = incoming.sparkSession
    start, created = (clock.epoch_micros(F.col(name), wall) for name in ("start_time", "created_at"))
    bucket = F.floor(F.col("start_us") / REACH).cast("bigint")
    slim_old = _touched(programs, incoming, wall).select(
        *KEY, "start_us", F.lit(STORED).cast("bigint").alias("ord"), created.alias("created_us"), F.col("id").alias("stored_id"))
    slim_new = incoming.select(
        *KEY, start.alias("start_us"), F.col("seq").alias("ord"), created.alias("created_us"),
        F.lit(None).cast("string").alias("stored_id"))

    # One row per key and half day, read by every branch below.
    placed_path = new_folder(spark, "upsert-placed")
    placed = written(_placed(_half_day_stats(slim_old.unionByName(slim_new))), placed_path)
    # The stored row of a closed program lies where that program starts.
    stored_ids = slim_old.select(*KEY, F.col("start_us").alias("head_start"), F.col("ord").alias("head"), "stored_id")
    closed = (
        placed.filter("closed").join(stored_ids, [*KEY, "head_start", "head"], "left")
        .select(*KEY, "bucket", F.lit(True).alias("is_closed"), _program_id().alias("program_id"), *_ROW[1:]))
    where = placed.filter("NOT closed").select(*KEY, "bucket", F.lit(False).alias("is_closed"), "segment", "size")

    # All arrivals look up their place in one pass; those to replay are set aside.
    places = closed.unionByName(where, allowMissingColumns=True)
    told = incoming.withColumn("start_us", start).withColumn("bucket", bucket).join(places, [*KEY, "bucket"])
    told = written(told.drop("start_us", "bucket"), told_path, "is_closed")
    to_replay, largest = placed.filter("NOT closed").agg(F.sum("n"), F.max("size")).first()
    if to_replay:
        late = told.filter("NOT is_closed").select(*incoming.columns, "segment", "size", start.alias("start_us"))
        old = slim_old.withColumn("bucket", bucket).join(where, [*KEY, "bucket"])
        _write_replayed(late, old, created, to_replay, largest, incoming.columns, replayed_path)
        remove(spark, f"{told_path}/is_closed=false")
    remove(spark, placed_path)
    return bool(to_replay)


def _write_replayed(late: DataFrame, slim_old: DataFrame, created: F.Column, total: int, largest: int, kept: list[str],
                    path: str) -> None:
    """Arrivals of segments without a closed form, each with its program."""
    columns = [*KEY, "segment", "start_us", "ord", "created_us", "stored_id"]
    slim_new = late.select(*KEY, "segment", "size", "start_us", F.col("seq").alias("ord"), created.alias("created_us"),
                           F.lit(None).cast("string").alias("stored_id"))
    entries = slim_new.filter(F.col("size") <= BLOCK).select(*columns).unionByName(slim_old.select(*columns))

    thinned, thinned_path = None, new_folder(late.sparkSession, "upsert-thinned")
    if largest > BLOCK:
        large = slim_new.filter(F.col("size") > BLOCK)
        # Blocks hold at most ``BLOCK`` arrivals, whatever the segment's size.
        thinned = written(
            large.select(*KEY, "segment", "start_us", F.col("ord").alias("seq"))
            .groupBy(*KEY, "segment", F.floor(F.col("seq") / BLOCK).alias("block")).applyInPandas(_thin, _KEPT), thinned_path)
        kept_rows = large.join(thinned.filter("seq = rep").select(F.col("seq").alias("ord")), "ord", "left_semi")
        entries = entries.unionByName(kept_rows.select(*columns))

    # Many small segments share one Python call.
    share = F.pmod(F.xxhash64(*KEY, "segment"), F.lit(total // SHARE + 1))
    replayed = entries.groupBy(share.alias("share")).applyInPandas(_replay, _REPLAYED)
    late = late.select(*kept, "start_us")
    if thinned is None:
        found = late.join(replayed, "seq")
    else:
        stand_ins = late.join(thinned, "seq", "left").withColumn("rep", F.coalesce("rep", "seq"))
        found = stand_ins.join(replayed.withColumnRenamed("seq", "rep"), "rep")
    written(found.withColumn("program_id", _program_id()).select(*kept, *_ROW), path)
    remove(late.sparkSession, thinned_path)


def _changes(resolved: DataFrame, old: DataFrame, wall: bool) -> tuple[DataFrame, DataFrame]:
    # The last arrival at the final start that is newer than the program sets the duration.
    corrected = resolved.filter(
        (clock.epoch_micros(F.col("start_time"), wall) == F.col("row_start")) & (F.col("seq") > F.col("peak"))
        & (clock.epoch_micros(F.col("viewed_time"), wall) > F.col("row_created"))
    ).groupBy("program_id").agg(F.max_by("duration", "seq").alias("late_duration"))

    moved = resolved.filter(F.col("seq") == F.col("peak")).select(
        "program_id", *KEY, *DETAILS, "start_time", "head", "row_created")
    moved = moved.join(corrected, "program_id", "left")
    inserted = moved.filter(F.col("head") != STORED).select(
        F.col("program_id").alias("id"), *KEY, "name", "start_time",
        F.coalesce("late_duration", "duration").alias("duration"), "text", "ext_text", "genre",
        clock.from_micros(F.col("row_created"), wall).alias("created_at"))

    taken = moved.filter(F.col("head") == STORED).select(
        F.col("program_id").alias("id"), F.struct("start_time", *DETAILS).alias("taken"))
    lengths = corrected.withColumnRenamed("program_id", "id")
    updated = (
        old.join(taken, "id", "left").join(lengths, "id", "left")
        .filter(F.col("taken").isNotNull() | F.col("late_duration").isNotNull()))

    def value(name: str) -> F.Column:
        return F.when(F.col("taken").isNotNull(), F.col(f"taken.{name}")).otherwise(F.col(name))

    updated = updated.select(
        "id", *KEY, value("name").alias("name"), value("start_time").alias("start_time"),
        F.coalesce("late_duration", value("duration")).alias("duration"),
        *[value(c).alias(c) for c in ("text", "ext_text", "genre")], "created_at")
    return inserted, updated


def patch_genre(programs: DataFrame, patches: DataFrame) -> DataFrame:
    """Set ``genre`` by program id; null is a value. The last patch by ``seq`` wins."""
    last = patches.groupBy("id").agg(F.max_by(F.struct("genre"), "seq").alias("patch"))
    columns = [
        F.when(F.col("patch").isNotNull(), F.col("patch.genre")).otherwise(F.col("genre")).alias("genre")
        if c == "genre" else F.col(c) for c in programs.columns]
    return programs.join(last, "id", "left").select(*columns)


def label_genres(programs: DataFrame, codes: DataFrame) -> DataFrame:
    """Replace genre codes by the labels of a caller's ``code, label`` table where it has them; the least of several."""
    labels = codes.select(F.col("code").cast("string").alias("genre"), "label").groupBy("genre").agg(
        F.min("label").alias("label"))
    return programs.join(labels, "genre", "left").withColumn("genre", F.coalesce("label", "genre")).select(
        *programs.columns)

