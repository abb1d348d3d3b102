"""Series: searching, making, linking, renaming, merging and moving.

Series names need not be unique; a lookup by name takes the smallest id. Links are
unique pairs. A batch of edits has the effect of applying it one by one in ``seq``
order, however the edits depend on each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleledger.functions import clock, ids, text
from teleledger.functions.titles import series_title
from teleledger.operators.nesting import nested_by_program, with_nested
from teleledger.operators.paging import group_pages, only_keys, page_of
from teleledger.operators.search import PROGRAM_COLUMNS
from teleledger.session import cut


def search_series(series: DataFrame, name: str = "", page: int = 1, size: int = 100,
                  case_sensitive: bool = False) -> DataFrame:
    found = series.select("id", "name", "created_at", "modified_at")
    if name:
        found = found.filter(text.contains(F.col("name"), name, case_sensitive))
    return page_of(found, [F.desc("modified_at"), F.asc("id")], page, size, "modified_at")


def series_programs(series: DataFrame, links: DataFrame, programs: DataFrame, views: DataFrame,
                    recordings: DataFrame, keys: DataFrame | None = None, page: int = 1, size: int = 100) -> DataFrame:
    """One page of programs for each series (of ``keys``, column ``series_id``), newest first, with arrays."""
    if page < 1 or size < 1:
        raise ValueError("page and size must be at least 1")
    heads = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"), "modified_at")
    if keys is not None:
        heads = only_keys(heads, keys, "series_id")
    # Rank on the two columns that order a page.
    times = programs.select(F.col("id").alias("program_id"), "start_time")
    wanted = links.select("series_id", "program_id")
    if keys is not None:
        wanted = only_keys(wanted, keys, "series_id")
    paged = group_pages(wanted.join(times, "program_id"), "series_id", "start_time",
                        [F.desc("start_time"), F.asc("program_id")], page, size)
    # Ids and places only; the details, and both arrays, look them up again.
    paged = cut(paged.select("series_id", F.col("program_id").alias("id"), "place").join(heads, "series_id"))

    shown = paged.join(programs.select(*PROGRAM_COLUMNS), "id")
    nested = nested_by_program(views, recordings, paged.select(F.col("id").alias("program_id")))
    return with_nested(shown, nested, "id").withColumn("end_time", clock.end_time())


def series_heads(series: DataFrame, links: DataFrame, programs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A header per series (per distinct key of ``keys``, column ``series_id``), those without a program included:
    series_id, series_name, created_at, modified_at, n_programs, known. A key that is no series is not ``known``.

    Links are counted before they meet the series; a link to a program that is gone counts for nothing. A null key is left out.
    """
    heads = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"), "created_at", "modified_at", F.lit(True).alias("known"))
    wanted = links.select("series_id", "program_id")
    if keys is not None:
        asked = keys.select("series_id").dropna().distinct()
        heads, wanted = asked.join(heads, "series_id", "left"), only_keys(wanted, asked, "series_id")
    present = wanted.distinct().join(programs.select(F.col("id").alias("program_id")), "program_id", "left_semi")
    counts = present.groupBy("series_id").agg(F.count("*").alias("n_programs"))
    known = F.coalesce("known", F.lit(False))
    return heads.join(counts, "series_id", "left").select(
        "series_id", "series_name", "created_at", "modified_at",
        F.when(known, F.coalesce("n_programs", F.lit(0))).otherwise(F.lit(0)).alias("n_programs"), known.alias("known"))


def _by_name(series: DataFrame) -> DataFrame:
    return series.groupBy("name").agg(F.min("id").alias("series_id"))


def get_or_create(series: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All series afterwards, and ``name, series_id`` for every wanted name.

    Wanted: ``name, created_at, seq``; the first request for a new name dates it. Empty names are refused.
    """
    names = wanted.filter("name <> ''").groupBy("name").agg(F.min_by("created_at", "seq").alias("created_at"))
    known = _by_name(series).withColumn("series_id", F.col("series_id").cast("string"))
    found = names.join(known, "name", "left").withColumn("is_new", F.col("series_id").isNull())
    found = found.withColumn("series_id", F.coalesce("series_id", ids.minted(F.lit("series"), F.col("name"))))
    made = found.filter("is_new").select(
        F.col("series_id").alias("id"), "name", "created_at", F.col("created_at").alias("modified_at"))
    old = series.select(F.col("id").cast("string").alias("id"), "name", "created_at", "modified_at")
    return old.unionByName(made), found.select("name", "series_id")


def link_programs(series: DataFrame, links: DataFrame, programs: DataFrame,
                  requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series with ``modified_at`` raised, links with the new ones, and the refused requests.

    Requests: ``series_id, program_id, at``; both ids must exist.
    """
    series_ids = series.select(F.col("id").alias("series_id"), F.lit(True).alias("has_series"))
    program_ids = programs.select(F.col("id").alias("program_id"), F.lit(True).alias("has_program"))
    # One row per link asked for: partial aggregation before any join.
    asked = requests.groupBy("series_id", "program_id").agg(F.max("at").alias("at"))
    checked = asked.join(series_ids, "series_id", "left").join(program_ids, "program_id", "left")
    sound = F.col("has_series").isNotNull() & F.col("has_program").isNotNull()
    fine = checked.filter(sound).select("series_id", "program_id", "at")
    refused = checked.filter(~sound).select(
        "series_id", "program_id", "at",
        F.concat_ws(" ", F.lit("Not found:"), F.when(F.col("has_series").isNull(), "series"),
                    F.when(F.col("has_program").isNull(), "program")).alias("reason"))

    pairs = fine.select("series_id", "program_id")
    fresh = pairs.join(links, ["series_id", "program_id"], "left_anti")
    touched = fine.groupBy(F.col("series_id").alias("id")).agg(F.max("at").alias("at"))
    bumped = series.join(touched, "id", "left").select(
        "id", "name", "created_at", F.greatest("modified_at", "at").alias("modified_at"))
    return bumped, links.select("program_id", "series_id").unionByName(fresh.select("program_id", "series_id")), refused


@dataclass(frozen=True)
class Edited:
    """Tables after a batch of edits, and each edit with its ``status``."""

    series: DataFrame
    links: DataFrame
    outcome: DataFrame


_NEVER, _ALWAYS = 2**63 - 1, -(2**63)
#: Rows of a written frame up to which it is broadcast: counted, not estimated.
_FEW = 20_000


def _beside(written: DataFrame) -> DataFrame:
    """A frame from ``cut`` for the small side of a join. Spark does not know its size, and few keys dealt by hash make few,
    ever larger tasks; few rows are broadcast instead, so the large side stays where it is."""
    return F.broadcast(written) if written.limit(_FEW + 1).count() <= _FEW else written


def rename_or_merge(series: DataFrame, links: DataFrame, requests: DataFrame) -> Edited:
    """Give series new names; a name that another series holds merges into that one.

    Requests: ``series_id, name, at, seq``, with ``seq`` unique. Status: ``renamed``, ``merged`` (into ``target``), ``unchanged``, or
    ``not_found`` for a series that does not exist, or no longer does.

    What an edit does follows from who holds its name just then, which follows from the edits before it. All are judged
    at once, at first as if every one were a rename, then again with what that makes of them, until nothing
    changes. Each turn settles at least the next edit in order, and then stays; a chain of renames needs no turns of
    its own, only a merge that changes what a later edit meets does.
    """
    known = series.select(F.col("id").alias("series_id"), F.lit(True).alias("known"))
    asked = requests.select("series_id", "name", "at", "seq").join(known, "series_id", "left")
    live = asked.filter("known").select("seq", "series_id", "name", "at")
    judged = cut(live.withColumn("status", F.lit("renamed")).withColumn("target", F.col("series_id")))
    named = cut(series.select("id", "name").join(judged.select("name").distinct(), "name", "left_semi"))
    settled, past = _ALWAYS, []
    while True:
        again = cut(_judged(named, judged, settled))
        changed = F.col("changed")
        found = again.agg(F.count_if(changed).alias("n"), F.count(F.when(changed, F.col("seq"))).alias("placed"),
                          F.min(F.when(changed, F.col("seq"))).alias("first"), F.count_if("over").alias("over")).first()
        # An edit of a series that is gone for good stays as it is and changes nothing for others.
        judged = again.filter("not over").drop("changed", "over")
        if found["over"]:
            past.append(again.filter("over").drop("changed", "over"))
        if not found["n"]:
            break
        # What comes before the first change has been judged by what is final itself.
        if found["placed"] == found["n"]:
            settled = max(settled, found["first"])

    merged = _followed(judged.filter("status = 'merged'").select("series_id", "target"))
    renamed = judged.filter("status = 'renamed'").groupBy(F.col("series_id").alias("id")).agg(
        F.max_by("name", "seq").alias("new_name"), F.max_by("at", "seq").alias("at"))
    kept = series.join(merged.select(F.col("series_id").alias("id")), "id", "left_anti").join(renamed, "id", "left")
    kept = kept.select(
        "id", F.coalesce("new_name", "name").alias("name"), "created_at",
        F.when(F.col("at").isNotNull(), F.col("at")).otherwise(F.col("modified_at")).alias("modified_at"))
    lost = asked.filter("known IS NULL").select(
        "series_id", "name", "at", "seq", F.lit("not_found").alias("status"),
        F.lit(None).cast(judged.schema["target"].dataType).alias("target"))
    for part in past:
        judged = judged.unionByName(part)
    return Edited(kept, _repoint(links, merged), judged.unionByName(lost))


def _judged(named: DataFrame, judged: DataFrame, settled: int) -> DataFrame:
    """The edits judged by the holders of names that their statuses so far lead to; ``changed`` where that differs, and ``over``
    where the series was merged away by an edit before ``settled``: those before it will not change."""
    order = Window.partitionBy("series_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("series_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max(F.col("status") == "merged").over(before), F.lit(False))
    sure = F.max((F.col("status") == "merged") & (F.col("seq") < settled)).over(before)
    edits = judged.withColumn("gone", gone).withColumn("over", F.coalesce(sure, F.lit(False)))
    takes = ~F.col("gone") & F.col("status").isin("renamed", "merged")
    # A name is held until the series' next edit that renames it or merges it away.
    edits = edits.withColumn("takes", takes).withColumn(
        "until", F.coalesce(F.last(F.when(F.col("takes"), F.col("seq")), ignorenulls=True).over(after), F.lit(_NEVER)))

    # Who has a name from the start: of several series the least, then the least of those that still have it.
    left = edits.filter("takes").groupBy(F.col("series_id").alias("id")).agg(F.min("seq").alias("until"))
    first = named.join(left, "id", "left").withColumn("until", F.coalesce("until", F.lit(_NEVER)))
    smaller = Window.partitionBy("name").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("since", F.coalesce(F.max("until").over(smaller), F.lit(_ALWAYS))).filter("until > since")

    held = F.struct(F.col("holder"), F.col("until"))
    holders = first.select("name", "since", F.col("id").alias("holder"), "until").unionByName(
        edits.filter("takes and status = 'renamed'").select("name", F.col("seq").alias("since"), F.col("series_id").alias("holder"), "until"))
    events = holders.select("name", F.col("since").alias("time"), F.lit(1).alias("kind"), held.alias("held")).unionByName(
        edits.select("name", F.col("seq").alias("time"), F.lit(0).alias("kind"), "seq", "series_id", "at", "status", "target", "gone", "over"),
        allowMissingColumns=True)
    # An edit sees what began before it.
    past = Window.partitionBy("name").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("met", F.last("held", ignorenulls=True).over(past)).filter("kind = 0")
    holder = F.when(F.col("met.until") >= F.col("seq"), F.col("met.holder"))
    met = met.withColumn("holder", holder).withColumn(
        "new", F.when(F.col("gone"), "not_found").when(F.col("holder").isNull(), "renamed")
        .when(F.col("holder") == F.col("series_id"), "unchanged").otherwise("merged"))
    met = met.withColumn("new_target", F.when(~F.col("gone"), F.coalesce("holder", "series_id")))
    return met.select(
        "seq", "series_id", "name", "at", F.col("new").alias("status"), F.col("new_target").alias("target"),
        (~F.col("new").eqNullSafe(F.col("status")) | ~F.col("new_target").eqNullSafe(F.col("target"))).alias("changed"), "over")


def _followed(moves: DataFrame) -> DataFrame:
    """``series_id, target`` with the target followed to its end; every turn doubles the steps taken."""
    moves = cut(moves)
    while True:
        on = moves.select(F.col("series_id").alias("target"), F.col("target").alias("further"))
        if moves.join(on, "target", "left_semi").isEmpty():
            return moves
        moves = cut(moves.join(on, "target", "left").select("series_id", F.coalesce("further", "target").alias("target")))


def _repoint(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links with ``series_id`` replaced by ``target``; a pair that links are moved to comes once."""
    links = links.select("program_id", "series_id")
    if "program_id" in moves.columns:
        found = links.join(moves, ["program_id", "series_id"], "left")
    else:
        found = links.join(_beside(moves), "series_id", "left")
    # One pass: a pair counts its links that stay; the ones that move onto it add a link where there is none.
    pairs = found.groupBy("program_id", F.coalesce("target", "series_id").alias("series_id")).agg(
        F.count_if(F.col("target").isNull()).alias("stay"), F.max(F.col("target").isNotNull().cast("int")).alias("moved"))
    # Null is no program, and so never the same one.
    n = F.when(F.col("program_id").isNull(), F.col("stay") + F.col("moved")).otherwise(F.greatest("stay", F.lit(1)))
    single = pairs.withColumn("n", n)
    return single.select("program_id", "series_id", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("col")


def move_programs(series: DataFrame, links: DataFrame, requests: DataFrame) -> Edited:
    """Re-point single links to the series of a name, made if new.

    Requests: ``program_id, series_id, name, at, seq``, with ``seq`` unique. Status: ``moved`` (also when the link was
    not there), ``unchanged``, or ``refused`` for an empty name.

    Where a link ends is found by following the moves: each one leads on to the next of its program that leaves the
    series it went to.
    """
    text_links = links.select(
        F.col("program_id").cast("string").alias("program_id"), F.col("series_id").cast("string").alias("series_id"))
    asked = requests.select(
        F.col("program_id").cast("string").alias("program_id"), F.col("series_id").cast("string").alias("series_id"),
        F.coalesce("name", F.lit("")).alias("name"), "at", "seq")
    after, targets = get_or_create(series, asked.select("name", F.col("at").alias("created_at"), "seq"))
    targets = cut(targets.withColumnRenamed("series_id", "target"))
    judged = asked.join(_beside(targets), "name", "left").withColumn(
        "status", F.when(F.col("name") == "", "refused").when(F.col("target") == F.col("series_id"), "unchanged").otherwise("moved"))
    judged = cut(judged)
    moves = judged.filter("status = 'moved'")
    return Edited(after, _repoint(text_links, _chained(moves)), judged)


def _chained(moves: DataFrame) -> DataFrame:
    """``program_id, series_id, target``: where each link that some move takes from its place ends."""
    none = F.lit(None).cast("long")
    leave = moves.select("program_id", F.col("series_id").alias("place"), F.col("seq").alias("time"), F.col("seq").alias("leaves"), none.alias("came"))
    arrive = moves.select("program_id", F.col("target").alias("place"), F.col("seq").alias("time"), none.alias("leaves"), F.col("seq").alias("came"))
    later = Window.partitionBy("program_id", "place").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, -1)
    onward = leave.unionByName(arrive).withColumn("next", F.last("leaves", ignorenulls=True).over(later)).filter("came is not null")
    steps = cut(moves.select("seq", "target").join(onward.select(F.col("came").alias("seq"), "next"), "seq"))
    while not steps.filter("next is not null").isEmpty():
        ahead = steps.select(F.col("seq").alias("next"), F.col("target").alias("further"), F.col("next").alias("then"))
        # Moves that lead nowhere on have no key: in the join they would all meet in one task.
        onward = steps.filter("next is not null").join(ahead, "next", "left").select(
            "seq", F.coalesce("further", "target").alias("target"), F.col("then").alias("next"))
        steps = cut(steps.filter("next is null").select("seq", "target", "next").unionByName(onward))
    first = leave.groupBy("program_id", "place").agg(F.min("leaves").alias("seq"))
    ended = first.join(steps, "seq").select("program_id", F.col("place").alias("series_id"), "target")
    return ended.filter("series_id <> target")


def titles_of(names: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``name, title`` for each distinct name: stored model title, then the rules, then the name itself.

    Overrides: ``name, reply`` where ``reply`` is a model's stored answer.
    """
    distinct = names.select("name").distinct()
    # One Python pass per distinct name; names are spread evenly by the shuffle before it.
    ruled = distinct.withColumn("ruled", series_title(F.col("name")))
    if overrides is None:
        return ruled.select("name", text.first_title(F.col("ruled"), F.col("name")).alias("title"))
    answers = overrides.groupBy("name").agg(F.max(text.title_from_reply(F.col("reply"))).alias("told"))
    return ruled.join(answers, "name", "left").select(
        "name", text.first_title(F.col("told"), F.col("ruled"), F.col("name")).alias("title"))


@dataclass(frozen=True)
class Assigned:
    series: DataFrame
    links: DataFrame
    assigned: DataFrame


def assign_series(programs: DataFrame, series: DataFrame, links: DataFrame, rows: DataFrame,
                  overrides: DataFrame | None = None) -> Assigned:
    """Title, get-or-create and link for every row of ``program_id, name, created_at, seq``."""
    # One row per distinct name, with its first request; written, so that Python runs once for all three results.
    firsts = cut(rows.groupBy("name").agg(F.min_by("created_at", "seq").alias("created_at"), F.min("seq").alias("seq")))
    titled = cut(firsts.join(titles_of(firsts, overrides), "name"))
    after, by_name = get_or_create(series, titled.select(F.col("title").alias("name"), "created_at", "seq"))
    places = cut(titled.select("name", "title").join(by_name.withColumnRenamed("name", "title"), "title"))
    assigned = rows.join(_beside(places), "name").select(
        F.col("program_id").cast("string").alias("program_id"), "series_id", "title", "created_at", "seq")
    text_programs = programs.select(F.col("id").cast("string").alias("id"))
    text_links = links.select(
        F.col("program_id").cast("string").alias("program_id"), F.col("series_id").cast("string").alias("series_id"))
    requests = assigned.select("series_id", "program_id", F.col("created_at").alias("at"))
    bumped, linked, _ = link_programs(after, text_links, text_programs, requests)
    return Assigned(bumped, linked, assigned)
