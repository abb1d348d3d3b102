from __future__ import annotations

import random

import pytest
from rows import at, program

from teleledger.operators import series

NOW = at("2025-06-01 00:00")
OLD = at("2025-01-01 00:00")
DAY = "2025-05-12 "
EDIT = "series_id long, name string, at timestamp_ntz, seq long"


def rows(names: dict[int, str]):
    return [{"id": i, "name": n, "created_at": OLD, "modified_at": OLD} for i, n in names.items()]


def pairs(links: list[tuple[int, int]]):
    return [{"program_id": p, "series_id": s} for p, s in links]


def test_search(make):
    table = make("series", [dict(r, modified_at=at(f"2025-01-0{r['id']}")) for r in rows({1: "series1", 2: "Series2", 3: "x"})])
    assert [r.id for r in series.search_series(table).collect()] == [3, 2, 1]
    assert [r.id for r in series.search_series(table, name="series").collect()] == [2, 1]
    assert [r.id for r in series.search_series(table, name="series", size=1, page=2).collect()] == [1]
    assert series.search_series(table, name="series3").collect() == []


def test_programs(spark, make):
    programs = make("programs", [program(i, f"{DAY}{10 + i}:00") for i in range(1, 6)])
    views = make("views", [{"program_id": 2, "viewed_time": at(DAY + t), "created_at": OLD} for t in ("12:10", "12:05")])
    recordings = make("recordings", [{"id": 9, "program_id": 2, "file_path": "", "created_at": OLD, "deleted_at": OLD}])
    table = make("series", rows({1: "a", 2: "b"}))
    links = make("program_series", pairs([(1, 1), (2, 1), (3, 1), (2, 2)]))
    got = series.series_programs(table, links, programs, views, recordings, size=2).collect()
    assert sorted((r.series_id, r.place, r.id) for r in got) == [(1, 1, 3), (1, 2, 2), (2, 1, 2)]
    two = [r for r in got if r.id == 2]
    assert all(r.viewed_times == [at(DAY + "12:05"), at(DAY + "12:10")] and r.recordings == [9] for r in two)
    keys = spark.createDataFrame([(1,)], "series_id long")
    assert [r.id for r in series.series_programs(table, links, programs, views, recordings, keys, page=2, size=2).collect()] == [1]


def test_heads(spark, make):
    """Series without programs have a header; unknown keys are reported, repeated and null ones are not."""
    programs = make("programs", [program(i, f"{DAY}{10 + i}:00") for i in range(1, 4)])
    table = make("series", rows({1: "a", 2: "b", 3: "c"}))
    links = make("program_series", pairs([(1, 1), (2, 1), (99, 1), (99, 2), (1, 8)]))
    got = lambda *keys: sorted((r.series_id, r.series_name, r.n_programs, r.known) for r in series.series_heads(
        table, links, programs, *keys).collect())
    assert got() == [(1, "a", 2, True), (2, "b", 0, True), (3, "c", 0, True)]
    keys = spark.createDataFrame([(1,), (3,), (3,), (8,), (None,)], "series_id long")
    assert got(keys) == [(1, "a", 2, True), (3, "c", 0, True), (8, None, 0, False)]


def test_get_or_create(spark, make):
    table = make("series", rows({4: "a", 2: "a", 3: "b"}))
    wanted = spark.createDataFrame([("a", OLD, 1), ("c", NOW, 3), ("c", OLD, 2), ("", OLD, 4)], "name string, created_at timestamp_ntz, seq long")
    after, by_name = series.get_or_create(table, wanted)
    found = {r.name: r.series_id for r in by_name.collect()}
    assert found["a"] == "2" and set(found) == {"a", "c"}
    assert [(r.created_at, r.modified_at) for r in after.filter("name = 'c'").collect()] == [(OLD, OLD)] and after.count() == 4
    again, same = series.get_or_create(after, wanted)
    assert again.count() == 4 and {r.name: r.series_id for r in same.collect()} == found


def test_link(spark, make):
    table, programs = make("series", rows({1: "a", 2: "b"})), make("programs", [program(1, DAY + "12:00"), program(2, DAY + "12:00")])
    links = make("program_series", pairs([(1, 1)]))
    asked = spark.createDataFrame([(1, 1, NOW), (1, 2, OLD), (1, 2, OLD), (9, 1, NOW), (2, 9, NOW), (8, 8, NOW)],
                                  "series_id long, program_id long, at timestamp_ntz")
    after, linked, refused = series.link_programs(table, links, programs, asked)
    assert sorted(tuple(r) for r in linked.collect()) == [(1, 1), (2, 1)]
    assert {r.id: r.modified_at for r in after.collect()} == {1: NOW, 2: OLD}
    assert {(r.series_id, r.program_id): r.reason for r in refused.collect()} == {
        (9, 1): "Not found: series", (2, 9): "Not found: program", (8, 8): "Not found: series program"}


def edit_one(names: dict[int, str], links: set, id: int, name: str) -> None:
    holders = [i for i, n in names.items() if n == name]
    if not holders:
        if id in names:
            names[id] = name
        return
    target = min(holders)
    if target == id:
        return
    for p, s in list(links):
        if s == id:
            links.discard((p, s))
            links.add((p, target))
    names.pop(id, None)


@pytest.mark.parametrize("seed", range(4))
def test_edits_equal_one_by_one(spark, make, seed):
    """A whole batch, names released and taken again, merges into merged series, equal names at the start."""
    rng = random.Random(seed)
    names = {i: f"n{i % 9}" for i in range(1, 13)}
    links = {(rng.randrange(6), s) for s in names for _ in range(2)}
    edits = [(rng.choice([*names, 99]), rng.choice(["n1", "n2", "n3", "n7", "x", "y", "z"]), NOW, 10 * seq) for seq in range(30)]
    done = series.rename_or_merge(make("series", rows(names)), make("program_series", pairs(sorted(links))),
                                  spark.createDataFrame(edits[::-1], EDIT))
    outcome = {r.seq: r for r in done.outcome.collect()}
    assert len(outcome) == len(edits)
    for id, name, _, seq in edits:
        holder = min((i for i, n in names.items() if n == name), default=None)
        want = ("not_found", None) if id not in names else ("renamed", id) if holder is None else (
            ("unchanged", id) if holder == id else ("merged", holder))
        assert (outcome[seq].status, outcome[seq].target) == want, seq
        edit_one(names, links, id, name)
    assert {r.id: r.name for r in done.series.collect()} == names
    got = [tuple(r) for r in done.links.collect()]
    assert len(got) == len(set(got)) and set(got) == links


def test_edits_of_nothing(spark, make):
    table, links = make("series", rows({1: "a"})), make("program_series", pairs([(1, 1)]))
    done = series.rename_or_merge(table, links, spark.createDataFrame([], EDIT))
    assert [r.name for r in done.series.collect()] == ["a"] and done.links.count() == 1 and done.outcome.count() == 0


def test_long_chain_of_renames_needs_few_turns(spark, make, monkeypatch):
    """One series takes a hundred names, each of which another then asks for."""
    turns = []
    judged = series._judged
    monkeypatch.setattr(series, "_judged", lambda *x: turns.append(1) or judged(*x))
    edits = [(1, f"x{k}", NOW, 2 * k) for k in range(100)] + [(2, f"x{k}", NOW, 2 * k + 3) for k in range(99)] + [(3, "x99", NOW, 1000)]
    done = series.rename_or_merge(make("series", rows({1: "a", 2: "b", 3: "c"})), make("program_series", pairs([(7, 3)])),
                                  spark.createDataFrame(edits, EDIT))
    assert {r.id: r.name for r in done.series.collect()} == {1: "x99", 2: "x98"}
    assert [tuple(r) for r in done.links.collect()] == [(7, 1)] and len(turns) <= 4


def test_move(spark, make):
    table = make("series", rows({1: "a", 2: "b"}))
    links = make("program_series", pairs([(1, 1), (1, 2), (2, 1), (3, 1)]))
    asked = spark.createDataFrame(
        [(1, 1, "b", NOW, 1), (1, 2, "c", NOW, 2), (2, 1, "new", NOW, 3), (3, 1, "a", NOW, 4), (3, 2, "", NOW, 0)],
        "program_id long, series_id long, name string, at timestamp_ntz, seq long")
    done = series.move_programs(table, links, asked)
    assert {r.seq: r.status for r in done.outcome.collect()} == {0: "refused", 1: "moved", 2: "moved", 3: "moved", 4: "unchanged"}
    made = {r.name: r.id for r in done.series.collect()}
    assert sorted(tuple(r) for r in done.links.collect()) == sorted([("1", made["c"]), ("2", made["new"]), ("3", "1")])
    assert len(made) == 4


@pytest.mark.parametrize("seed", range(3))
def test_moves_equal_one_by_one(spark, make, seed):
    rng = random.Random(seed)
    names = {i: f"n{i}" for i in range(1, 6)}
    links = {(rng.randrange(4), rng.choice([*names])) for _ in range(9)}
    table, linked = make("series", rows(names)), make("program_series", pairs(sorted(links)))
    edits = [(rng.randrange(4), rng.choice([*names]), rng.choice([*names.values(), ""]), NOW, seq) for seq in range(40)]
    done = series.move_programs(table, linked, spark.createDataFrame(
        edits[::-1], "program_id long, series_id long, name string, at timestamp_ntz, seq long"))
    ids = {n: i for i, n in names.items()}
    for program_id, series_id, name, _, _ in edits:
        if name and (program_id, series_id) in links:
            links = links - {(program_id, series_id)} | {(program_id, ids[name])}
    got = sorted((int(r.program_id), int(r.series_id)) for r in done.links.collect())
    assert got == sorted(links)


def test_titles(spark, make):
    names = make("programs", [program(1, DAY + "12:00", name="雨と君と　＃１０"), program(2, DAY + "12:00", name="雨と君と　＃１１"),
                              program(3, DAY + "12:00", name="[字]"), program(4, DAY + "12:00", name="X / y")])
    told = spark.createDataFrame([("X / y", '{"title": "XY"}'), ("[字]", "no idea")], "name string, reply string")
    got = {r.name: r.title for r in series.titles_of(names, told).collect()}
    assert got == {"雨と君と　＃１０": "雨と君と", "雨と君と　＃１１": "雨と君と", "[字]": "[字]", "X / y": "XY"}
    assert series.titles_of(names).filter("name = 'X / y'").first().title == "X"


def test_moves_lie_in_even_parts(spark, make, monkeypatch):
    """All moves go to one name and most lead nowhere on: neither brings them together in one task (F1)."""
    shares, cut = [], series.cut

    def counted(df):
        done = cut(df)
        sizes = done.rdd.glom().map(len).collect()
        if sum(sizes) > 1000:
            shares.append(max(sizes) / sum(sizes))
        return done

    monkeypatch.setattr(series, "cut", counted)
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        moves = [(p, 1, "b", NOW, 3 * p) for p in range(3000)] + [(p, 2, "c", NOW, 3 * p + 1) for p in range(0, 3000, 100)]
        links = make("program_series", pairs([(p, 1) for p in range(3000)])).repartition(8)
        asked = spark.createDataFrame(moves, "program_id long, series_id long, name string, at timestamp_ntz, seq long").repartition(8)
        done = series.move_programs(make("series", rows({1: "a", 2: "b", 3: "c"})), links, asked)
        got = {r.series_id: r.n for r in done.links.groupBy("series_id").count().withColumnRenamed("count", "n").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {"2": 2970, "3": 30} and len(shares) >= 3 and max(shares) < 0.4


def test_repointed_links_that_repeat(spark):
    """Links that stay keep their number; those that move onto a pair add one only where there is none, and null is no program."""
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 1), (None, 1), (None, 2), (3, None)], "program_id long, series_id long")
    moves = spark.createDataFrame([(1, 2)], "series_id long, target long")
    got = sorted(((r.program_id, r.series_id) for r in series._repoint(links, moves).collect()), key=repr)
    assert got == sorted([(1, 2), (1, 2), (2, 2), (None, 2), (None, 2), (3, None)], key=repr)


def test_edits_of_merged_series_leave_the_turns(spark, make, monkeypatch):
    """Once a merge is sure, the later edits of its series are judged no more (F4)."""
    sizes, judged = [], series._judged
    monkeypatch.setattr(series, "_judged", lambda named, edits, *x: sizes.append(edits.count()) or judged(named, edits, *x))
    names = {i: f"a{i}" for i in range(1, 8)}
    edits = [(2, "a1", NOW, 10)] + [(2, f"p{k}", NOW, 11 + k) for k in range(100)] + [
        (3, "p5", NOW, 200), (4, "p5", NOW, 201), (4, "q", NOW, 202), (5, "q", NOW, 203), (6, "q", NOW, 204), (6, "r", NOW, 205), (7, "r", NOW, 206)]
    done = series.rename_or_merge(make("series", rows(names)), make("program_series", pairs([(1, i) for i in names])),
                                  spark.createDataFrame(edits, EDIT))
    assert {r.id: r.name for r in done.series.collect()} == {1: "a1", 3: "p5", 5: "q", 7: "r"}
    assert sorted(r.series_id for r in done.links.collect()) == [1, 3, 5, 7]
    outcome = {r.seq: r.status for r in done.outcome.collect()}
    assert len(outcome) == len(edits) and all(outcome[11 + k] == "not_found" for k in range(100))
    assert sizes[0] == len(edits) and sizes[-1] <= len(edits) - 100
