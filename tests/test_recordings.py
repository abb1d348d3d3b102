from __future__ import annotations

import json
import random
import re
from datetime import datetime, timedelta

from rows import at
from pyspark.sql import functions as F

from teleledger.operators import commands, recordings, scan

PATCH = ("id long, seq long, file_path string, file_path_set boolean, file_folder string, file_folder_set boolean, "
         "watched_at timestamp_ntz, watched_at_set boolean, deleted_at timestamp_ntz, deleted_at_set boolean")
FIELDS = ["file_path", "file_folder", "watched_at", "deleted_at"]
T1 = at("2025-05-12 13:00")


def patch_rows(spark, patches: list[tuple[int, int, dict]]):
    rows = []
    for id, seq, given in patches:
        row = [id, seq]
        for f in FIELDS:
            row += [given.get(f), f in given]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, PATCH)


def stored(make, path: str, **more):
    return make("recordings", [{"id": 1, "program_id": 1, "file_path": path, "file_size": 9, "created_at": T1, **more}])


CASES = [
    ("//server/recorded/test1", {}, {"watched_at": T1, "file_folder": "archives"}, 200,
     {"file_path": "//server/archives/test1", "file_size": 9, "watched_at": T1},
     {"action": "rename", "old_path": "//server/recorded/test1", "new_path": "//server/archives/test1"}),
    ("//server/recorded/test1", {"watched_at": T1}, {"watched_at": None}, 200, {"watched_at": None}, None),
    ("//server/archives/test1", {}, {"deleted_at": T1}, 200, {"file_path": "", "file_size": None, "deleted_at": T1},
     {"action": "delete", "file_path": "//server/archives/test1"}),
    ("", {"deleted_at": T1}, {"deleted_at": None}, 200, {"file_path": "", "deleted_at": None}, None),
    ("", {}, {"deleted_at": T1}, 200, {"file_path": "", "deleted_at": T1}, None),
    ("//server/recorded/test1", {}, {"file_path": "//server/recorded2/test"}, 200, {"file_path": "//server/recorded2/test"}, None),
    ("//server/recorded/test1", {}, {"file_folder": "recorded"}, 200, {"file_path": "//server/recorded/test1"}, None),
    ("//server/recorded/test1", {}, {"file_path": "//onlyserver", "watched_at": T1}, 400, {"watched_at": None}, None),
    ("//server/recorded/test1", {}, {"file_path": None}, 400, {}, None),
    ("//server/recorded/test1", {}, {"file_folder": "x", "file_path": "//a/b/c"}, 400, {}, None),
    ("//server/recorded/test1", {}, {"file_folder": None}, 400, {}, None),
    ("//server/recorded/test1", {}, {"deleted_at": T1, "file_path": "//a/b/c"}, 400, {"deleted_at": None}, None),
    ("//server/recorded/test1", {}, {"deleted_at": T1, "file_path": "", "file_folder": "z"}, 200, {"file_path": ""},
     {"action": "delete", "file_path": "//server/recorded/test1"}),
    ("", {}, {"file_folder": "x", "watched_at": T1}, 404, {"watched_at": None}, None),
    ("a/b", {}, {"file_folder": "x"}, 500, {"file_path": "a/b"}, None),
    ("//server/recorded/test1", {}, {}, 200, {"file_path": "//server/recorded/test1"}, None),
]


def test_patches(spark, make):
    table = make("recordings", [{"id": i, "program_id": 1, "file_path": path, "file_size": 9, "created_at": T1, **before}
                                for i, (path, before, *_) in enumerate(CASES)])
    patches = patch_rows(spark, [(i, i, case[2]) for i, case in enumerate(CASES)])
    new, judged = recordings.patch_recordings(table, patches)
    outcome = {r.id: r.status for r in judged.collect()}
    rows = {r.id: r.asDict() for r in new.collect()}
    sent = {r.id: json.loads(r.value) for r in commands.file_commands(judged).collect()}
    for i, (_, _, given, status, after, command) in enumerate(CASES):
        assert outcome[i] == status, given
        assert {k: rows[i][k] for k in after} == after, given
        assert sent.get(i) == command, given


def test_unknown_recording(spark, make):
    new, judged = recordings.patch_recordings(stored(make, "//a/b/c"), patch_rows(spark, [(7, 1, {"watched_at": T1})]))
    assert judged.first().status == 404 and new.count() == 1


def apply_one(row: dict, given: dict) -> int:
    """The rules, one patch at a time."""
    path = None
    if given.get("deleted_at") is not None:
        if "file_path" in given and given["file_path"] != "":
            return 400
        path = ""
    elif "file_folder" in given:
        if "file_path" in given or given["file_folder"] is None:
            return 400
        if row["file_path"] == "":
            return 404
        parts = row["file_path"].split("/")
        path = "/".join(parts[:3] + [given["file_folder"]] + parts[4:])
    elif "file_path" in given:
        if given["file_path"] is None or not re.fullmatch("//[^/]+/[^/]+/.*", given["file_path"]):
            return 400
        path = given["file_path"]
    if path is not None:
        row["file_path"] = path
        if path == "":
            row["file_size"] = None
    for f in ("watched_at", "deleted_at"):
        if f in given:
            row[f] = given[f]
    return 200


def test_many_patches_in_order(spark, make):
    rng = random.Random(5)
    rows = {i: {"id": i, "program_id": i, "file_path": "" if i == 3 else f"//s/f/{i}", "file_size": 9,
                "watched_at": None, "deleted_at": None, "created_at": T1} for i in range(5)}
    table = make("recordings", [dict(r) for r in rows.values()])
    choices = {"file_path": ["//n/g/x", "//n/h/y", "/bad", "", None], "file_folder": ["a", "b", None],
               "watched_at": [T1, None], "deleted_at": [T1, None, None]}
    patches, want = [], {}
    for seq in range(400):
        i = rng.choice([0, 0, 0, 1, 2, 3, 4])
        given = {f: rng.choice(choices[f]) for f in FIELDS if rng.random() < 0.3}
        patches.append((i, seq, given))
        old = rows[i]["file_path"]
        want[seq] = (apply_one(rows[i], given), old, rows[i]["file_path"])
    new, judged = recordings.patch_recordings(table, patch_rows(spark, patches))
    assert {r.seq: (r.status, r.old_path, r.new_path) for r in judged.collect()} == want
    assert {r.id: r.asDict() for r in new.collect()} == rows


def test_scan_across_blocks(spark):
    rng = random.Random(1)
    rows = [(k, s, rng.choice([None, None, None, s])) for k in (1, 2) for s in sorted(rng.sample(range(1000), 200))]
    df = spark.createDataFrame(rows, "k int, s long, v long")
    got = {(r.k, r.s): r.prev_v for r in scan.last_before(df, "k", "s", ["v"], block=7).collect()}
    for key in (1, 2):
        last = None
        for k, s, v in rows:
            if k == key:
                assert got[k, s] == last
                last = v if v is not None else last


def test_intake(spark):
    messages = ['{"action":"delete","file_path":"//a/b/c"}', '{"action":"rename","old_path":"//a/b/c","new_path":"//a/d/c"}',
                '{"action":"copy","file_path":"x"}', 'nonsense', None, '{"action":"delete"}', '[1]', '{"action":"rename","old_path":"x"}']
    df = spark.createDataFrame([(m,) for m in messages], "value string")
    rows = commands.route_commands(commands.parse_commands(df)).collect()
    assert [r.route for r in rows] == ["delete", "rename", "ignore", "dead_letter", "dead_letter", "dead_letter", "dead_letter", "dead_letter"]
    assert rows[1].make_folder == "//a/d" and rows[1].about_path == "//a/b/c" and rows[0].about_path == "//a/b/c"
    tried = spark.createDataFrame([(1, False, None), (2, True, 0xC0000034), (3, True, 5), (4, True, None)], commands.OUTCOME_SCHEMA)
    assert [r.ack for r in commands.acknowledge(tried).orderBy("seq").collect()] == [True, True, False, False]


def test_append_split(spark):
    df = spark.createDataFrame([("//a/b/c",), ("/a",), (None,)], "file_path string")
    good, bad = recordings.split_valid(df)
    assert [r.file_path for r in good.collect()] == ["//a/b/c"] and bad.count() == 2
