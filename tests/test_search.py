from __future__ import annotations

import pytest
from rows import at, program
from pyspark.sql import functions as F

from teleledger.operators import digest, search
from teleledger.operators.nesting import nested_by_program
from teleledger.operators.paging import page_of

DAY = "2025-05-12 "


@pytest.fixture(scope="module")
def tables(make):
    programs = make("programs", [
        program(1, DAY + "12:00", name="Test Program", event_id=11),
        program(2, DAY + "12:30", name="テスト番組2", event_id=12),
        program(3, DAY + "23:31", event_id=13),
    ])
    views = make("views", [
        {"program_id": 1, "viewed_time": at(DAY + "12:10"), "speed": 1.0, "created_at": at(DAY + "12:11")},
        {"program_id": 1, "viewed_time": at(DAY + "12:05"), "speed": 1.0, "created_at": at(DAY + "12:06")},
        {"program_id": 1, "viewed_time": at(DAY + "12:05"), "speed": 1.0, "created_at": at(DAY + "12:07")},
        {"program_id": 2, "viewed_time": at(DAY + "12:35"), "speed": 1.5, "created_at": at(DAY + "12:36")},
    ])
    recordings = make("recordings", [
        {"id": 1, "program_id": 1, "file_path": "//server/recorded/a", "file_size": 5, "created_at": at(DAY + "12:30")},
        {"id": 2, "program_id": 1, "file_path": "//server/archives/b", "created_at": at(DAY + "12:32"),
         "watched_at": at(DAY + "13:00")},
        {"id": 3, "program_id": 1, "file_path": "", "created_at": at(DAY + "12:31"),
         "watched_at": at(DAY + "13:00"), "deleted_at": at(DAY + "13:01")},
        {"id": 4, "program_id": 2, "file_path": "//server/recorded/c", "created_at": at(DAY + "13:02")},
    ])
    return programs, views, recordings


def ids(df):
    return [r.id for r in df.collect()]


def test_program_search(tables):
    p, v, r = tables
    rows = search.search_programs(p, v, r).collect()
    assert [x.id for x in rows] == [3, 2, 1]
    one = rows[2]
    assert one.viewed_times == [at(DAY + "12:05"), at(DAY + "12:05"), at(DAY + "12:10")]
    assert one.recordings == [1, 2, 3] and one.end_time == at(DAY + "12:30") and (one.part, one.parts) == (0, 1)
    assert rows[0].viewed_times == [] and rows[0].recordings == []


def test_program_filters(tables):
    p, v, r = tables
    assert ids(search.search_programs(p, v, r, size=1, page=2)) == [2]
    assert ids(search.search_programs(p, v, r, size=2, page=3)) == []
    assert ids(search.search_programs(p, v, r, from_=DAY + "12:30")) == [3, 2]
    # The third ends on the 13th at 00:01, after the whole 12th.
    assert ids(search.search_programs(p, v, r, to="2025-05-12")) == [2, 1]
    assert ids(search.search_programs(p, v, r, to="2025-05-13")) == [3, 2, 1]
    assert ids(search.search_programs(p, v, r, name="test")) == [1]
    assert ids(search.search_programs(p, v, r, name="テスト")) == [2]
    with pytest.raises(ValueError):
        search.search_programs(p, v, r, page=0)


def test_programs_by_id(spark, tables):
    p, v, r = tables
    keys = spark.createDataFrame([(1,), (3,), (99,), (1,)], "id long")
    rows = {x.id: x for x in search.programs_by_id(p, v, r, keys).collect()}
    assert sorted(rows) == [1, 3] and rows[1].recordings == [1, 2]
    bounded = {x.id: x.recordings for x in search.programs_by_id(p, v, r, keys, bound=4, live_only=False).collect()}
    assert bounded == {1: [1, 2, 3], 3: []}


def test_arrays_in_parts(spark, tables):
    p, v, r = tables
    many = spark.range(100).select(
        F.lit(2).cast("bigint").alias("program_id"),
        F.timestamp_add("SECOND", F.col("id") % 7, F.lit(DAY + "12:00").cast("timestamp_ntz")).alias("viewed_time"))
    rec = spark.range(25).select(F.col("id"), F.lit(2).cast("bigint").alias("program_id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    keys = p.select(F.col("id").alias("program_id"))
    rows = nested_by_program(many, rec, keys, part_rows=4).collect()
    assert {x.parts for x in rows} == {32} and len({x.part for x in rows}) == len(rows) > 10
    times = sorted(t for x in rows for t in x.viewed_times)
    assert times == sorted(x.viewed_time for x in many.collect())
    assert sorted(i for x in rows for i in x.recordings) == list(range(25))
    whole = nested_by_program(many, rec, keys, bound=3).collect()
    assert len(whole) == 1 and whole[0].viewed_times == times and whole[0].recordings == list(range(25))


def test_views(spark, tables):
    _, v, _ = tables
    assert [r.created_at.minute for r in search.search_views(v, size=2).collect()] == [36, 11]
    assert [r.created_at.minute for r in search.search_views(v, size=2, page=2).collect()] == [7, 6]
    keys = spark.createDataFrame([(1,)], "program_id long")
    assert [r.created_at.minute for r in search.views_of_programs(v, keys).collect()] == [11, 7, 6]


def test_recordings(tables):
    p, v, r = tables
    find = lambda **k: ids(search.search_recordings(r, p, v, **k))
    assert find() == [4, 1]
    assert find(watched="on") == [4, 1, 2]
    assert find(watched=True, deleted=True) == [4, 1, 3, 2]
    assert find(program_id=1) == [1]
    assert find(from_=DAY + "12:30") == [4]
    assert find(file_folder="recorded") == [4, 1]
    assert find(file_folder="arch.*", watched=True) == [2]
    assert find(to="2025-05-11") == []
    row = search.search_recordings(r, p, v, program_id=1).first()
    assert row.file_folder == "recorded" and row.program.name == "Test Program"
    assert row.program.recordings == [1, 2] and len(row.program.viewed_times) == 3
    assert row.program.end_time == at(DAY + "12:30")


def test_timeline(tables):
    p, v, r = tables
    row = search.program_timeline(search.search_programs(p, v, r, name="test")).first()
    # 2025-05-12 12:00 in Japan
    assert row.start_time_timestamp == 1747018800 and row.end_time_timestamp == 1747020600
    assert row.viewed_times_timestamp == [1747019100, 1747019100, 1747019400]
    ms = search.recording_timeline(search.search_recordings(r, p, v, program_id=1)).first()
    assert ms.start_time_ms == 1747018800000 and ms.recording_id == 1


def test_digestion_threshold(make):
    cases = {1: (1800, 1, True), 2: (1800, 4, True), 3: (1800, 5, False), 4: (375, 1, False), 5: (1, 0, True)}
    p = make("programs", [program(i, DAY + "12:00", seconds) for i, (seconds, _, _) in cases.items()])
    v = make("views", [{"program_id": i, "viewed_time": at(DAY + "12:05"), "created_at": at(DAY + "12:05")}
                       for i, (_, samples, _) in cases.items() for _ in range(samples)])
    r = make("recordings", [{"id": 2 * i + k, "program_id": i, "file_path": "x", "created_at": at(DAY + "12:30"),
                             "watched_at": at(DAY + "12:31") if k else None} for i in cases for k in (0, 1)])
    rows = {x.id: x for x in digest.digestions(p, r, v).collect()}
    assert set(rows) == {i for i, (_, _, listed) in cases.items() if listed}
    for i, row in rows.items():
        assert row.watched_seconds == 300 * cases[i][1] and len(row.viewed_times) == cases[i][1]


def test_digestions(tables):
    p, v, r = tables
    assert ids(digest.digestions(p, r, v)) == [2, 1]
    assert ids(digest.digestions(p, r, v, ascending=True)) == [1, 2]
    assert ids(digest.digestions(p, r, v, name="test")) == [1]
    positions = {(x.program_id, round(x.position, 4)) for x in digest.view_positions(p, v).collect()}
    assert positions == {(1, 0.1667), (1, 0.3333), (2, 0.1667)}


def test_deep_pages_equal_near_ones(spark):
    rows = spark.range(3000).select(
        "id", F.timestamp_add("SECOND", (F.col("id") * 7919) % 5000, F.lit(DAY + "00:00").cast("timestamp_ntz")).alias("t"))
    for descending in (True, False):
        order = [F.desc("t") if descending else F.asc("t"), F.asc("id")]
        for page, size in ((1, 100), (4, 333), (3, 1000), (9, 400)):
            near = page_of(rows, order, page, size, "t", descending).collect()
            assert page_of(rows, order, page, size, "t", descending, deep_from=0).collect() == near


def test_hot_program_is_spread(spark, tables):
    p, v, r = tables
    plan = nested_by_program(v, r, p.select(F.col("id").alias("program_id")))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(program_id" in plan and ", part#" in plan.split("REPARTITION_BY_COL")[0].rsplit("Exchange", 1)[1]
