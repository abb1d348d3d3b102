from __future__ import annotations

import glob
import json
import os
import tempfile

import pytest
from rows import at, program
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger.operators import ingest, upsert
from teleledger.plans import queries_stream
from teleledger.plans.tables import Source
from teleledger.session import checkpoint_root
from teleledger.sources import commits, feeds, tables
from teleledger.streaming import jobs, player, programs

DAY = "2025-05-12 "
STATUS = {"current_event_id": 123, "current_event_service_id": 456, "current_event_name": "Example Show",
          "current_event_start_time": "2025-05-13T12:00:00+09:00", "current_event_duration": 1800,
          "tot": "2025-05-13T12:05:00+09:00", "current_content_nibble": 112}


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="teleledger-test-")


def put(folder: str, name: str, rows: list) -> str:
    import os
    path = f"{folder}/{name}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{len(os.listdir(path))}.json", "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return path


def test_status(spark, folder):
    less = {k: v for k, v in STATUS.items() if k != "current_content_nibble"}
    path = put(folder, "status", [
        {"play_status": "finished"}, STATUS, less, {**STATUS, "speed": 150}, {**STATUS, "speed": None}, "broken {",
        {**STATUS, "tot": "never"}, {**STATUS, "current_content_nibble": None, "play_status": "playing"}])
    lines = feeds.status_lines(spark, path)
    rows = player.status_to_view(lines).select("program.*", F.unix_seconds("viewed_time").alias("seen"), "speed").collect()
    assert [(r.speed, r.genre) for r in rows] == [(1.0, "112"), (1.5, "112"), (1.0, None)]
    assert rows[0].seen == 1747105500 and rows[0].event_id == 123 and rows[0].duration == 1800
    assert player.rejected_status(lines).count() == 4


def instants(start: list[tuple]):
    return [{"program": {"event_id": e, "service_id": 1, "name": n, "start_time": f"2025-05-12T{t}:00+09:00", "duration": d},
             "viewed_time": f"2025-05-12T{v}:00+09:00", "speed": 1.0, "seq": s} for s, e, n, t, d, v in start]


def test_view_stream_equals_batch(spark, folder):
    first = [(1, 11, "a", "12:00", 1800, "12:05"), (2, 11, "a", "12:00", 1860, "12:10"), (3, 12, "b", "12:00", 600, "12:05")]
    second = [(4, 11, "a2", "12:10", 1800, "12:15"), (5, 12, "b", "11:50", 600, "12:20"), (6, 11, "a3", "12:10", 1900, "12:20")]
    path = put(folder, "arrivals", instants(first))
    empty = spark.createDataFrame([], tables.schema.programs(T.StringType()))
    tables.write_snapshot(empty, folder, "programs", 0)
    for rows in (None, second):
        if rows:
            put(folder, "arrivals", instants(rows))
        jobs.ingest_views(feeds.view_arrivals(spark, path, stream=True), folder, f"{folder}/ck", once=True).awaitTermination()
    assert tables.latest_version(spark, folder, "programs") == 2
    streamed = tables.read_table(spark, folder, "programs", id_type=T.StringType())
    batch = ingest.ingest_views(empty, feeds.view_arrivals(spark, path)).upsert.apply(empty)
    columns = ["event_id", "name", "start_time", "duration", "created_at", "id"]
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert tables.read_table(spark, folder, "views", id_type=T.StringType()).count() == 6
    # A new checkpoint folder: all arrivals come again, nothing is lost, and programs are found, not made again.
    jobs.ingest_views(feeds.view_arrivals(spark, path, stream=True), folder, f"{folder}/ck-new", once=True).awaitTermination()
    seen = tables.read_table(spark, folder, "views", id_type=T.StringType())
    assert seen.count() == 12
    known = {r.id for r in tables.read_table(spark, folder, "programs", id_type=T.StringType()).collect()}
    assert {r.program_id for r in seen.collect()} <= known


def test_state_equals_batch(spark, folder):
    rows = [(s, 11 + s % 2, "a", f"{h:02d}:00", 600 + s % 3, f"{h:02d}:30") for s, h in enumerate([0, 10, 20, 0, 10, 21, 9, 23, 23, 1])]
    path = put(folder, "arrivals", instants(rows))
    flat = lambda df: df.select("program.*", "viewed_time", F.col("viewed_time").alias("created_at"), "seq")
    stream = programs.program_changes(flat(feeds.view_arrivals(spark, path, stream=True)))
    out = f"{folder}/changes"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/ck2").trigger(
        availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], tables.schema.programs())
    batch = upsert.upsert_programs(empty, flat(feeds.view_arrivals(spark, path))).resolved
    want = {r.seq: r.program_id for r in batch.collect()}
    got = spark.read.parquet(out).collect()
    assert {r.seq: r.program_id for r in got} == want and len(got) == len(rows)
    assert {r.action for r in got} >= {"insert", "move"}


def test_seeded_state_equals_batch(spark, folder, make):
    """Three micro-batches over stored programs: a start a year ahead, then rows of days before; each finds its program."""
    stored = make("programs", [program(7, "2025-05-12 00:30", event_id=11, service_id=1), program(5, "2025-05-12 00:30", event_id=11, service_id=1),
                               program(8, "2025-05-10 06:00", event_id=12, service_id=1)])
    for c in ("start_time", "created_at"):
        stored = stored.withColumn(c, F.to_timestamp(F.concat(F.col(c).cast("string"), F.lit("+09:00"))))
    sent = lambda s, e, start, d: {"event_id": e, "service_id": 1, "start_time": start, "duration": d, "viewed_time": start, "created_at": start, "seq": s}
    days = [[sent(1, 11, "2025-05-12T01:00:00+09:00", 1800), sent(2, 11, "2026-05-12T01:00:00+09:00", 1800), sent(3, 12, "2025-05-20T01:00:00+09:00", 60)],
            [sent(4, 11, "2025-05-09T01:00:00+09:00", 600), sent(5, 12, "2025-05-10T05:00:00+09:00", 60)],
            [sent(6, 11, "2025-05-09T02:00:00+09:00", 600), sent(7, 11, "2025-05-12T02:00:00+09:00", 900), sent(8, 12, "2025-05-20T01:00:00+09:00", 90)]]
    path = ""
    fields = "event_id long, service_id long, start_time timestamp, duration long, viewed_time timestamp, created_at timestamp, seq long"
    out = f"{folder}/changes"
    for rows in days:
        path = put(folder, "seeded", rows)
        stream = spark.readStream.schema(fields).json(path)
        programs.program_changes(stream, stored).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{folder}/ck9").trigger(availableNow=True).start().awaitTermination()
    batch = upsert.upsert_programs(stored, spark.read.schema(fields).json(path).withColumns({
        c: F.lit("x") for c in ("name", "text", "ext_text", "genre")})).resolved
    got = {r.seq: r.program_id for r in spark.read.parquet(out).collect()}
    assert got == {r.seq: r.program_id for r in batch.collect()} and len(got) == 8
    assert got[1] == got[7] == "5" and got[4] == got[6] and got[5] == "8" and got[3] == got[8]


def test_patch_stream(spark, folder, make):
    tables.write_snapshot(make("recordings", [
        {"id": 1, "program_id": 1, "file_path": "//s/rec/a", "file_size": 1, "created_at": at(DAY + "12:00")},
        {"id": 2, "program_id": 1, "file_path": "//s/rec/b", "file_size": 1, "created_at": at(DAY + "12:00")}])
        .withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("watched_at", F.col("watched_at").cast("timestamp"))
        .withColumn("deleted_at", F.col("deleted_at").cast("timestamp")), folder, "recordings", 0)
    path = put(folder, "patches", [
        {"id": 1, "seq": 1, "file_folder": "keep", "file_folder_set": True}, {"id": 1, "seq": 2, "deleted_at": "2025-05-12T13:00:00Z", "deleted_at_set": True},
        {"id": 2, "seq": 3, "file_path": "/bad", "file_path_set": True}])
    fields = ("id long, seq long, file_path string, file_path_set boolean, file_folder string, file_folder_set boolean, watched_at timestamp, "
              "watched_at_set boolean, deleted_at timestamp, deleted_at_set boolean")
    stream = spark.readStream.schema(fields).json(path)
    jobs.patches_to_commands(stream, folder, f"{folder}/out", f"{folder}/ck3", once=True).awaitTermination()
    sent = sorted(r.value for r in spark.read.parquet(f"{folder}/out/commands").collect())
    assert [json.loads(x)["action"] for x in sent] == ["delete", "rename"]
    assert json.loads(sent[0])["file_path"] == "//s/keep/a"
    assert [(r.id, r.status) for r in spark.read.parquet(f"{folder}/out/refused").collect()] == [(2, 400)]
    after = {r.id: r.file_path for r in tables.read_table(spark, folder, "recordings").collect()}
    assert after == {1: "", 2: "//s/rec/b"}

    lines = put(folder, "queue", sent + ["junk"])
    jobs.take_commands(spark.readStream.schema("value string").text(lines), f"{folder}/in", f"{folder}/ck4", once=True).awaitTermination()
    assert sorted(r.route for r in spark.read.parquet(f"{folder}/in").collect()) == ["dead_letter", "delete", "rename"]


def test_append_views_and_windows(spark, folder):
    fields = "program_id long, viewed_time timestamp, speed double, created_at timestamp"
    row = {"program_id": 1, "viewed_time": "2025-05-12T03:05:00Z", "speed": 1.0, "created_at": "2025-05-12T03:05:00Z"}
    path = put(folder, "v", [row, row, {**row, "viewed_time": "2025-05-12T03:11:00Z"}])
    stream = lambda: spark.readStream.schema(fields).json(path)
    jobs.append_views(stream(), f"{folder}/all", f"{folder}/c1", once=True).awaitTermination()
    jobs.append_views(stream(), f"{folder}/once", f"{folder}/c2", once=True, replay_window="1 day").awaitTermination()
    assert spark.read.parquet(f"{folder}/all").count() == 3 and spark.read.parquet(f"{folder}/once").count() == 2
    windows = player.watched_windows(spark.read.schema(fields).json(path)).collect()
    assert sorted(w.watched_seconds for w in windows) == [300, 600]


def test_tables(spark, folder, make):
    rows = make("programs", [program(1, "2025-05-12 00:30"), program(2, "2025-05-13 00:30"), program(3, "2025-05-14 12:00")])
    for c in ("start_time", "created_at"):
        rows = rows.withColumn(c, F.to_timestamp(F.concat(F.col(c).cast("string"), F.lit("+09:00"))))
    assert tables.latest_version(spark, folder, "programs") is None
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, folder, "programs")
    tables.write_snapshot(rows, folder, "programs", 1)
    tables.append_rows(rows.filter("id = 3").withColumn("id", F.lit(4).cast("long")), folder, "programs", 1)
    read = tables.read_table(spark, folder, "programs", from_="2025-05-13", to="2025-05-13")
    # Whole days at both ends; the search itself cuts to the moment.
    assert sorted(r.id for r in read.collect()) == [2, 3, 4]
    assert "PartitionFilters: [isnotnull(day" in read._jdf.queryExecution().executedPlan().toString()
    assert tables.latest_version(spark, folder, "programs") == 1
    links = make("program_series", [{"program_id": 1, "series_id": 2}])
    tables.write_snapshot(links, folder, "program_series", 3)
    assert tables.read_table(spark, folder, "program_series").collect() == links.collect()


def test_commits(spark, folder, make):
    fields = "program_id long, viewed_time timestamp, speed double, created_at timestamp"
    row = lambda t: {"program_id": 1, "viewed_time": t, "speed": 1.0, "created_at": t}
    path = put(folder, "v", [row("2025-05-12T03:05:00Z"), row("2025-05-12T03:05:00Z"), row("2025-05-12T16:00:00Z")])
    run = lambda ck: jobs.append_to_table(spark.readStream.schema(fields).json(path), folder, "views", f"{folder}/{ck}", once=True).awaitTermination()
    run("a")
    put(folder, "v", [row("2025-05-14T03:05:00Z"), row(None)])
    run("a")
    assert tables.latest_version(spark, folder, "views") == 1 and tables.read_table(spark, folder, "views").count() == 5
    assert tables.read_table(spark, folder, "views", version=0).count() == 3
    # Whole days of Japan: 16:00Z is the next day there.
    assert tables.read_table(spark, folder, "views", from_="2025-05-13").count() == 2
    assert tables.read_table(spark, folder, "views", to="2025-05-12").count() == 3
    assert len(tables.read_table(spark, folder, "views", from_="2025-05-14").inputFiles()) == 1
    rows = spark.read.schema(fields).json(path)
    before = commits.load(spark, folder, "views")
    txn = (next(iter(before.done)), before.done[next(iter(before.done))])
    assert commits.append(rows, folder, "views", txn) == before
    run("b")
    assert tables.read_table(spark, folder, "views").count() == 10
    done = commits.compact(spark, folder, "views", T.LongType(), most=1)
    assert all(len(x) == 1 for x in done.days.values()) and tables.read_table(spark, folder, "views").count() == 10


def test_merge_writes_touched_days_only(spark, folder, make):
    rows = make("programs", [program(i, f"2025-05-{12 + i} 00:30") for i in range(1, 4)])
    for c in ("start_time", "created_at"):
        rows = rows.withColumn(c, F.to_timestamp(F.concat(F.col(c).cast("string"), F.lit("+09:00"))))
    tables.write_snapshot(rows, folder, "programs", 4)
    moved = rows.filter("id = 2").withColumn("start_time", F.timestamp_add("DAY", F.lit(7), "start_time"))
    made = rows.filter("id = 3").withColumn("id", F.lit(9).cast("long"))
    done = commits.merge(moved, made, folder, "programs", None, tables.base_of(spark, folder, "programs"))
    assert done.version == 5 and "2025-05-14" not in done.days and len(done.days["2025-05-15"]) == 2
    assert done.days["2025-05-13"] == ["version=0000000004"]
    read = tables.read_table(spark, folder, "programs")
    assert sorted((r.id, r.name) for r in read.collect()) == [(1, "Program 1"), (2, "Program 2"), (3, "Program 3"), (9, "Program 3")]
    assert tables.read_table(spark, folder, "programs", version=4).count() == 3
    with pytest.raises(RuntimeError):
        commits._publish(spark, folder, "programs", commits.Commit(5))


def test_other_feeds(spark, folder):
    path = put(folder, "rec", [{"id": 1, "rec_file_path": "\\a.ts", "title": "t", "eid": 3, "sid": 4, "start_time_epg": "2025-05-12T12:00:00+09:00"}])
    assert feeds.recorder_info(spark, path).first().eid == 3
    path = put(folder, "epg", [{"svc_pos": 0, "service_info": {"onid": 4}, "event_list": [{"onid": 4, "eid": 9, "short_info": {"event_name": "x"}}]}])
    assert feeds.epg_feed(spark, path).first().event_list[0].short_info.event_name == "x"
    path = put(folder, "ch", ["A\tB\t1\t2\t3\t4\t1\t0\t0"])
    assert feeds.channels(spark, path).first().sid == 3
    path = put(folder, "nas", ["12345"])
    found = feeds.file_listing(spark, path, mount=path, server_prefix="//nas/rec").first()
    assert (found.path, found.length) == ("//nas/rec/0.json", 6)
    sent = spark.createDataFrame([('{"action":"delete"}',)], "value string")
    assert feeds.publish_commands(sent, None, {}) is False
    assert feeds.publish_commands(sent, "text", {"path": f"{folder}/q"}) is True
    assert spark.read.text(f"{folder}/q").first().value == '{"action":"delete"}'


@pytest.mark.parametrize("n, share", [(100, 10), (5, 1), (7, 100)])
def test_feeds_in_batches(spark, folder, n, share):
    """A micro-batch is several files where it has many rows, and still one micro-batch, later in order than the one before (F2, F3)."""
    rows = spark.createDataFrame([(k,) for k in range(n)], "seq long")
    feed = queries_stream._in_batches(Source(spark, folder), rows, 2, share)
    found = {}

    def keep(batch, number):
        found[number] = sorted(r.seq for r in batch.collect())

    feed.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    first, second = found[0], found[1]
    assert len(found) == 2 and first + second == list(range(n)) and abs(len(first) - len(second)) <= n // 10 + 1
    made = max(glob.glob(f"{checkpoint_root(spark)}/feed-*"), key=os.path.getmtime)
    assert len(glob.glob(f"{made}/*.parquet")) == 2 * max(1, -(-n // (2 * share)))


class _Listed:
    """List state of one key, that counts how often it is written."""

    def __init__(self):
        self.rows, self.writes = [], 0

    def getListState(self, name, fields):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.writes = list(rows), self.writes + 1

    appendList = put


def test_state_of_many_programs():
    """An arrival meets the latest of the programs near it, as found by a look at all; what changes nothing writes nothing (F2)."""
    import random

    import pandas as pd

    rng, hour = random.Random(5), 3_600_000_000
    stored = [(rng.randrange(300) * hour, 1800, 0, f"s{k:02d}") for k in range(40)]
    state, processor = _Listed(), programs.OpenPrograms()
    processor.init(state)
    columns = ["start_us", "duration", "created_us", "stored_id"]
    processor.handleInitialState((1, 1), pd.DataFrame(stored, columns=columns), None)
    assert [(r[2], r[5]) for r in state.rows] == sorted((r[0], r[3]) for r in stored)
    known, want = [[None, None, s, d, c, i] for s, d, c, i in sorted(stored, key=lambda r: (r[0], r[3]))], []
    rows = [(seq, rng.randrange(400) * hour, rng.choice([1800, 900]), 5, 1) for seq in range(300)]
    for seq, start, duration, viewed, created in rows:
        near = [p for p in known if abs(p[2] - start) <= programs.REACH]
        match, action = max(near, key=lambda p: p[2], default=None), "none"
        if match is None:
            match, action = [seq, start, start, duration, created, None], "insert"
            known.append(match)
        elif start > match[2]:
            match[2:4], action = [start, duration], "move"
        elif start == match[2] and duration != match[3] and match[4] < viewed:
            match[3], action = duration, "duration"
        want.append((seq, match[0], match[5], action, match[3]))
    names = ["seq", "start_us", "duration", "viewed_us", "created_us"]
    halves = [pd.DataFrame(rows[a:b][::-1], columns=names) for a, b in ((0, 150), (150, 300))]
    got = [r for half in halves for out in processor.handleInputRows((1, 1), iter([half[:70], half[70:]]), None)
           for r in out[["seq", "head", "stored_id", "action", "duration"]].itertuples(index=False)]
    assert [(r[0], None if pd.isna(r[1]) else r[1], r[2], r[3], r[4]) for r in got] == want
    assert sorted(map(str, state.rows)) == sorted(str(tuple(p)) for p in known)
    writes, again = state.writes, pd.DataFrame([(301, max(p[2] for p in known) - 1, 1800, 0, 0)], columns=names)
    assert [x.action.tolist() for x in processor.handleInputRows((1, 1), iter([again]), None)] == [["none"]] and state.writes == writes
