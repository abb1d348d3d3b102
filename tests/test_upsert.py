from __future__ import annotations

import os
import random
import tempfile
import time
from datetime import datetime, timedelta

import pytest
from rows import at, program
from pyspark.sql import functions as F

from teleledger.operators import ingest, upsert

ARRIVAL = ("event_id long, service_id long, name string, start_time timestamp_ntz, duration long, text string, ext_text string, "
           "genre string, viewed_time timestamp_ntz, created_at timestamp_ntz, seq long")
DAY = "2025-05-12 "
REACH = timedelta(hours=12)


def arrival(seq: int, start: datetime, seconds: int = 1800, viewed: datetime | None = None, event_id: int = 11, **more):
    viewed = viewed or start + timedelta(minutes=5)
    return (event_id, 101, more.get("name", f"n{seq}"), start, seconds, more.get("text"), None, more.get("genre"), viewed,
            more.get("created", viewed), seq)


def one_by_one(programs: list[dict], arrivals: list[tuple]) -> tuple[dict, list]:
    """The rule, one arrival at a time; programs are known by the arrival that made them."""
    rows = [dict(p, key=p["id"]) for p in programs]
    owners = []
    for e, s, name, start, seconds, text, ext, genre, viewed, created, seq in sorted(arrivals, key=lambda a: a[-1]):
        near = [r for r in rows if (r["event_id"], r["service_id"]) == (e, s) and abs(r["start_time"] - start) <= REACH]
        row = max(near, key=lambda r: r["start_time"], default=None)
        if row is None:
            row = {"key": f"new{seq}", "event_id": e, "service_id": s, "created_at": created, "start_time": start,
                   "duration": seconds, "name": name, "genre": genre}
            rows.append(row)
        elif start > row["start_time"]:
            row.update(start_time=start, duration=seconds, name=name, genre=genre)
        elif start == row["start_time"] and seconds != row["duration"] and row["created_at"] < viewed:
            row["duration"] = seconds
        owners.append((seq, row["key"]))
    return {r["key"]: (r["start_time"], r["duration"], r["name"], r.get("genre"), r["created_at"]) for r in rows}, owners


def check(spark, make, programs: list[dict], arrivals: list[tuple]):
    table = make("programs", programs)
    done = upsert.upsert_programs(table, spark.createDataFrame(arrivals, ARRIVAL))
    got = {r.id: (r.start_time, r.duration, r.name, r.genre, r.created_at) for r in done.apply(table).collect()}
    owners = {r.seq: r.program_id for r in done.resolved.collect()}
    want, by_seq = one_by_one(programs, arrivals)
    assert len(owners) == len(arrivals)
    # New ids differ in form: match each to the arrival that made it.
    names = {str(p["id"]): str(p["id"]) for p in programs}
    for seq, key in by_seq:
        names.setdefault(str(key), owners[seq])
        assert owners[seq] == names[str(key)], (seq, key)
    assert got == {names[str(k)]: v for k, v in want.items()}


ROW = program(1, DAY + "12:00", 1800, event_id=11, created_at=at(DAY + "12:01"))


def test_single_arrivals(spark, make):
    """Each case under a key of its own."""
    cases = [(False, "12:00", 1800, "12:05"), (True, "12:00", 1860, "12:05"), (True, "12:00", 1740, "12:05"),
             (True, "12:00", 1860, "12:00"), (True, "11:50", 1800, "12:05"), (True, "12:10", 1800, "12:05"),
             (True, "12:00", 1800, "12:05")]
    stored = [dict(ROW, id=i, event_id=i) for i, case in enumerate(cases) if case[0]]
    arrivals = [arrival(i, at(DAY + start), seconds, at(DAY + viewed), event_id=i)
                for i, (_, start, seconds, viewed) in enumerate(cases)]
    base = at(DAY + "00:00")
    # Twelve hours apart is one program, a second more is two.
    arrivals += [arrival(20, base, event_id=20), arrival(21, base + REACH, event_id=20)]
    arrivals += [arrival(22, base, event_id=22), arrival(23, base + REACH + timedelta(seconds=1), event_id=22)]
    # The last one no longer finds the first program, which has moved on.
    arrivals += [arrival(30 + i, base + timedelta(hours=h), event_id=30) for i, h in enumerate([0, 10, 20, 0])]
    check(spark, make, stored, arrivals)


@pytest.mark.parametrize("seed", range(6))
def test_random_arrivals(spark, make, seed, monkeypatch):
    """Short and long, ordered and disordered histories, several keys at once, with stored programs."""
    monkeypatch.setattr(upsert, "BLOCK", 16)
    rng = random.Random(seed)
    base = at("2025-01-01 00:00")
    programs, arrivals, seq = [], [], 0
    for key in range(8):
        spread = rng.choice([6, 11, 30, 60, 200])
        grid = rng.choice([1, 3, 6])
        for _ in range(rng.choice([0, 0, 1, 2])):
            programs.append(program(len(programs) + 1, str(base + timedelta(hours=rng.randrange(0, spread, grid))), event_id=key,
                                    created_at=base + timedelta(hours=rng.randrange(spread))))
        starts = [rng.randrange(0, spread, grid) for _ in range(rng.choice([3, 20, 60]))]
        if rng.random() < 0.4:
            starts.sort()
        for hours in starts:
            start = base + timedelta(hours=hours)
            arrivals.append(arrival(seq, start, rng.choice([600, 1200]), start + timedelta(hours=rng.randrange(-5, 9)),
                                    event_id=key, genre=rng.choice([None, "g"])))
            seq += rng.randrange(1, 4)
    # Rows of one key never start within reach of each other, as the rule itself guarantees.
    kept = []
    for p in programs:
        if all(q["event_id"] != p["event_id"] or abs(q["start_time"] - p["start_time"]) > REACH for q in kept):
            kept.append(p)
    check(spark, make, kept, arrivals)


def test_repeated_sightings_are_thinned():
    import pandas as pd

    hour = 3_600_000_000
    starts = [0, 5 * hour] * 50 + [15 * hour] + [0] * 20
    out = upsert._thin(pd.DataFrame({"seq": range(len(starts)), "start_us": starts}))
    assert (out.seq == out.rep).sum() <= 6


def test_genres(spark, make):
    table = make("programs", [program(1, DAY + "12:00", genre="a"), program(2, DAY + "12:00", genre="b"), program(3, DAY + "12:00", genre="c")])
    patches = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 5, "y"), (9, 1, "z")], "id long, seq long, genre string")
    assert {r.id: r.genre for r in upsert.patch_genre(table, patches).collect()} == {1: None, 2: "y", 3: "c"}
    codes = spark.createDataFrame([(112, "アニメ／特撮 - 国内アニメ")], "code int, label string")
    coded = make("programs", [program(1, DAY + "12:00", genre="112"), program(2, DAY + "12:00", genre="7"), program(3, DAY + "12:00")])
    assert {r.id: r.genre for r in upsert.label_genres(coded, codes).collect()} == {1: "アニメ／特撮 - 国内アニメ", 2: "7", 3: None}


def test_recording_end_to_end(spark, make):
    table = make("programs", [ROW])
    one = ("struct<event_id:long,service_id:long,name:string,start_time:timestamp_ntz,duration:long,text:string,ext_text:string,genre:string>")
    rows = [((11, 101, "雨と君と　＃１０", at(DAY + "12:10"), 1800, None, None, None), "//s/f/a", 5, None, None, at(DAY + "12:30"), 1),
            ((12, 101, "雨と君と　＃１１", at(DAY + "13:10"), 1800, None, None, None), "//s/f/b", None, None, None, at(DAY + "13:30"), 2),
            ((13, 101, "x", at(DAY + "13:10"), 1800, None, None, None), "/bad", None, None, None, at(DAY + "13:30"), 3)]
    arrivals = spark.createDataFrame(rows, f"program {one}, file_path string, file_size long, watched_at timestamp_ntz, "
                                           "deleted_at timestamp_ntz, created_at timestamp_ntz, seq long")
    series = make("series", [{"id": 7, "name": "雨と君と", "created_at": at("2025-01-01"), "modified_at": at("2025-01-01")}])
    done = ingest.ingest_recordings(table, series, make("program_series", []), arrivals)
    assert sorted(r.file_path for r in done.recordings.collect()) == ["//s/f/a", "//s/f/b"]
    assert [r.file_path for r in done.rejected.collect()] == ["/bad"]
    moved = {r.id: r.start_time for r in done.upsert.apply(table).collect()}
    assert len(moved) == 2 and moved["1"] == at(DAY + "12:10")
    assert {r.series_id for r in done.assigned.links.collect()} == {"7"} and done.assigned.links.count() == 2
    assert [(r.id, r.modified_at) for r in done.assigned.series.collect()] == [("7", at(DAY + "13:30"))]


def test_recorder_reports(spark):
    schema = ("id long, rec_file_path string, title string, duration_sec long, sid long, eid long, start_time_epg timestamp_ntz, program_info string")
    info = spark.createDataFrame([(1, "\\rec\\a.ts", "A", 1800, 101, 11, at(DAY + "12:00"), "ジャンル : ドラマ\n"),
                                  (2, "", "B", 1800, 101, 12, at(DAY + "12:00"), None)], schema)
    listing = spark.createDataFrame([("//nas/rec/a.ts", 77)], "path string, length long")
    rec = ingest.from_recorder(info, "\\\\nas", F.lit(at(DAY + "13:00")), listing).collect()
    assert [(r.file_path, r.file_size, r.program.genre) for r in rec] == [("//nas/rec/a.ts", 77, "ドラマ")]
    view = ingest.views_from_recorder(info, F.lit(at(DAY + "13:00"))).collect()
    assert [(v.seq, v.viewed_time, v.speed) for v in view] == [(1, at(DAY + "12:00"), 1.0)]


def test_rounds(spark, make, monkeypatch):
    """A batch beyond a round is taken by shares of its keys, and leaves its two tables only."""
    monkeypatch.setattr(upsert, "ROUND", 30)
    rng = random.Random(7)
    base = at("2025-01-01 00:00")
    stored = [program(k + 1, str(base + timedelta(hours=k)), event_id=k, created_at=base) for k in range(0, 40, 3)]
    arrivals = [arrival(seq, base + timedelta(hours=rng.randrange(0, 90, 5)), rng.choice([600, 1200]), event_id=rng.randrange(40))
                for seq in range(200)]
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rounds-"))
    check(spark, make, stored, arrivals)
    assert sorted(x.rsplit("-", 1)[0] for x in os.listdir(_checkpoints(spark))) == ["upsert-replayed", "upsert-told"]


def _checkpoints(spark) -> str:
    return spark.sparkContext.getCheckpointDir().removeprefix("file:")


def _bytes(folders) -> int:
    return sum(os.path.getsize(os.path.join(at_, f)) for x in folders for at_, _, files in os.walk(x) for f in files)


def test_ingest_keeps_little_on_disk(spark, make):
    """Shuffles of the steps are given up, and what is kept of an arrival is small."""
    n = 40_000
    start = F.timestamp_add("MINUTE", F.col("id") % 50_000, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    told = F.struct((F.col("id") % 5000).alias("event_id"), F.lit(1).cast("long").alias("service_id"), F.concat(F.lit("Show "), F.col("id") % 7).alias("name"),
                    start.alias("start_time"), F.lit(900).cast("long").alias("duration"), F.lit(None).cast("string").alias("text"),
                    F.lit(None).cast("string").alias("ext_text"), F.lit("g").alias("genre"))
    arrivals = spark.range(n).select(
        told.alias("program"), F.concat(F.lit("//nas/rec/"), F.col("id").cast("string")).alias("file_path"), F.col("id").alias("file_size"),
        F.lit(None).cast("timestamp_ntz").alias("watched_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        start.alias("created_at"), F.col("id").alias("seq"))
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ingest-"))
    dirs = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    spark._jvm.java.lang.System.gc()
    time.sleep(2)
    before = _bytes(dirs)
    done = ingest.ingest_recordings(make("programs", []), make("series", []), make("program_series", []), arrivals)
    for _ in range(20):
        time.sleep(0.5)
        left = _bytes(dirs) - before
        if left < 10 * n:
            break
    assert left < 10 * n
    assert _bytes([_checkpoints(spark)]) < 100 * n
    full = done.with_series()
    assert full.count() == done.recordings.count() == n
    assert full.select("id").exceptAll(done.recordings.select("id")).isEmpty()
    assert {r.title for r in full.select("title").distinct().collect()} == {f"Show {i}" for i in range(7)}
