"""Program get-or-create on an unbounded stream, with the open programs of a key as its state."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from teleledger.functions import clock, ids
from teleledger.operators.upsert import REACH

_L, _S = T.LongType(), T.StringType()

STATE = T.StructType([
    T.StructField("head", _L), T.StructField("head_start", _L), T.StructField("start", _L),
    T.StructField("duration", _L), T.StructField("created", _L), T.StructField("stored_id", _S)])

CHANGE = T.StructType([
    T.StructField("event_id", _L), T.StructField("service_id", _L), T.StructField("seq", _L),
    T.StructField("head", _L), T.StructField("head_start", _L), T.StructField("action", _S),
    T.StructField("duration", _L), T.StructField("stored_id", _S)])


def _sorted(rows: pd.DataFrame, *columns: str, by: int = 2) -> list[tuple]:
    """The columns' values in order of the first ``by`` of them, missing ones last. Most keys have few rows: a frame's own sort
    costs more than all else."""
    def place(row: tuple) -> list:
        return [(False, x) if x is not None and x == x else (True,) for x in row[:by]]

    return sorted(zip(*(rows[c].tolist() for c in columns)), key=place)


class OpenPrograms(StatefulProcessor):
    """Keeps per key all its programs, so a row that comes however late finds the one it belongs to, and a start that lies far
    ahead displaces none. As two programs of a key lie over twelve hours apart, their number is bounded by the calendar,
    not by the arrivals; it is that of the key's rows in the programs table, which the state begins with.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timer_values) -> None:
        # Of stored programs with one start the smallest id is met.
        rows = _sorted(initialState, "start_us", "stored_id", "duration", "created_us")
        self.open.appendList([(None, None, start, duration, created, stored) for start, stored, duration, created in rows])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # In order of start, equal ones as stored, so an arrival looks at those near it only.
        programs = sorted(([*r] for r in self.open.get()), key=lambda p: p[2]) if self.open.exists() else []
        starts, nowhere = [p[2] for p in programs], []
        # Rows of one micro-batch come in no order; the arrival number restores it.
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        out = []
        for seq, start, duration, viewed, created in _sorted(batch, "seq", "start_us", "duration", "viewed_us", "created_us", by=1):
            at, match = bisect_right(starts, start + REACH) - 1, None
            if at >= 0 and starts[at] >= start - REACH:
                at = bisect_left(starts, starts[at])
                match = programs[at]
            if match is None:
                match, action = [seq, start, start, duration, created, None], "insert"
                if start == start:
                    at = bisect_right(starts, start)
                    starts.insert(at, start)
                    programs.insert(at, match)
                else:  # without a time it is near none
                    nowhere.append(match)
            elif start > match[2]:
                match[2:4], action = [start, duration], "move"
                del starts[at], programs[at]
                at = bisect_right(starts, start)
                starts.insert(at, start)
                programs.insert(at, match)
            elif start == match[2] and duration != match[3] and match[4] < viewed:
                match[3], action = duration, "duration"
            else:
                action = "none"
            out.append((key[0], key[1], seq, match[0], match[1], action, match[3], match[5]))
        if any(row[5] != "none" for row in out):
            self.open.put([tuple(p) for p in programs + nowhere])
        # Programs that were stored have no first arrival.
        made = dict(zip(CHANGE.names, zip(*out)))
        yield pd.DataFrame({c: pd.array(x, dtype="Int64") if c in ("head", "head_start") else [*x] for c, x in made.items()})

    def close(self) -> None:
        pass


def program_changes(arrivals: DataFrame, programs: DataFrame | None = None) -> DataFrame:
    """What each arrival does: ``program_id``, ``action`` (insert, move, duration, none) and the duration after it.

    Arrivals: ``event_id, service_id, start_time, duration, viewed_time, created_at, seq``, times as
    instants, each micro-batch later in ``seq`` than the one before. ``programs``: the stored table, which the state begins with when
    the stream is started for the first time. State lives in the RocksDB store, keyed by event and service.
    """
    slim = arrivals.select(
        "event_id", "service_id", "seq", "duration", F.unix_micros("start_time").alias("start_us"),
        F.unix_micros("viewed_time").alias("viewed_us"), F.unix_micros("created_at").alias("created_us"))
    stored = None
    if programs is not None:
        micros = lambda name: clock.epoch_micros(F.col(name), clock.is_wall_clock(programs, name))
        stored = programs.select(
            "event_id", "service_id", micros("start_time").alias("start_us"), "duration", micros("created_at").alias("created_us"),
            F.col("id").cast("string").alias("stored_id")).groupBy("event_id", "service_id")
    changes = slim.groupBy("event_id", "service_id").transformWithStateInPandas(
        statefulProcessor=OpenPrograms(), outputStructType=CHANGE, outputMode="append", timeMode="none", initialState=stored)
    return changes.withColumn("program_id", F.coalesce("stored_id", ids.minted(
        F.col("event_id"), F.col("service_id"), F.col("head_start"), F.col("head")))).drop("stored_id")
