from __future__ import annotations

from rows import at

from teleledger.operators import epg

FEED = ("svc_pos long, event_list array<struct<onid:long,tsid:long,sid:long,eid:long,start_time:timestamp_ntz,"
        "duration_sec:long,short_info:struct<event_name:string,text_char:string>>>")
DAY = "2025-05-12 "


def event(sid, eid, start, seconds, name):
    return (4, 100, sid, eid, start and at(start), seconds, name and (name, ""))


def feed(spark):
    return spark.createDataFrame([
        (0, [event(101, 1, DAY + "12:00", 1800, "A"), event(101, 2, None, None, "C"), event(101, 3, DAY + "13:00", 60, None)]),
        (1, [event(102, 1, DAY + "12:00", 1800, "A"), event(102, 2, DAY + "12:00", 1900, "A")]),
        (2, None), (3, []),
        (4, [event(103, 7, DAY + "13:00", 60, None), event(101, 1, "2025-05-13 12:00", 1800, "A2")]),
    ], FEED)


def test_unique(spark):
    flat = epg.flatten_feed(feed(spark))
    assert flat.count() == 7 and epg.timed(flat)[1].count() == 1
    got = sorted((r.sid, r.eid, r.event_name) for r in epg.unique_events(flat).collect())
    assert got == [(101, 1, "A"), (101, 1, "A2"), (101, 3, ""), (102, 2, "A")]


def test_window(spark):
    key = (4 << 32) | (100 << 16)
    find = lambda now, targets: sorted((r.sid, r.eid) for r in epg.future_events(feed(spark), now, targets).collect())
    assert find(DAY + "12:00", None) == [(101, 1), (101, 3), (102, 2)]
    assert find(DAY + "12:01", None) == [(101, 1), (101, 3)]
    assert find(DAY + "12:00", [(0, key | 102)]) == [(102, 1), (102, 2)]
    assert find(DAY + "12:00", [(0xFFFF, key)]) == [(101, 1), (101, 3), (102, 2)]
    assert find(DAY + "12:00", [(0xFFFF, key + (1 << 16))]) == []


def test_reservations(spark):
    asked = spark.createDataFrame([
        (1, 4, 100, 101, 1, at(DAY + "10:00")), (2, 4, 100, 101, 1, at("2025-05-13 10:00")), (3, 4, 100, 101, 2, at(DAY + "10:00")),
        (4, 4, 100, 101, 1, at(DAY + "12:01"))],
        "request_id long, onid long, tsid long, sid long, eid long, requested_at timestamp_ntz")
    rows, missed = epg.reservation_rows(asked, epg.flatten_feed(feed(spark)))
    got = {r.request_id: r for r in rows.collect()}
    assert {k: v.title for k, v in got.items()} == {1: "A", 2: "A2", 4: "A2"}
    assert got[1].rec_mode == 3 and got[1].pittari_flag is True and got[1].rec_folder_list == []
    assert [r.request_id for r in missed.collect()] == [3]


def test_reservations_of_many_airings(spark):
    """Each request takes the first airing in feed order within its day, whichever side of midnight."""
    from datetime import timedelta

    first, hours = at("2025-05-12 00:00"), [0, 1, 23, 24, 25, 47, 48, 71, 72, 100]
    airings = [(0, [
        (4, 100, 101, 1, first + timedelta(hours=h), 60, (f"at {h}", "")) for h in reversed(hours)])]
    asked = [(i, 4, 100, 101, 1, first + timedelta(minutes=30 * i)) for i in range(220)]
    requests = spark.createDataFrame(asked, "request_id long, onid long, tsid long, sid long, eid long, requested_at timestamp_ntz")
    rows, missed = epg.reservation_rows(requests, epg.flatten_feed(spark.createDataFrame(airings, FEED)))
    want = {}
    for i, *_, when in asked:
        near = [h for h in hours if timedelta() <= first + timedelta(hours=h) - when < timedelta(days=1)]
        want[i] = f"at {max(near)}" if near else None
    got = {r.request_id: r.title for r in rows.collect()} | {r.request_id: None for r in missed.collect()}
    assert got == want and None in want.values()
