"""Ordered pages and joins against key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from teleledger.session import cut

# Key sets up to this many rows are sent to every task; larger ones are shuffled.
BROADCAST_ROWS = 100_000
# Up to this place Spark limits the rows of a ranked group before the shuffle.
GROUP_LIMIT = 1_000


def page_of(df: DataFrame, order: list[Column], page: int, size: int, by: str, descending: bool = True,
            deep_from: int = BROADCAST_ROWS) -> DataFrame:
    """One page of a total order that starts with the time column ``by``.

    Near pages are a top-k per task and a merge. Pages that end beyond ``deep_from`` rows
    are found by counting, see ``_deep_page``.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size must be at least 1")
    offset = (page - 1) * size
    if offset + size > deep_from:
        return _deep_page(df, order, offset, size, by, descending)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(size)


def _deep_page(df: DataFrame, order: list[Column], offset: int, size: int, by: str, descending: bool) -> DataFrame:
    """Count rows per minute, run up the counts, and place only rows of the minutes the page falls in.

    The running count is over one row per minute of the calendar, whatever the table's size. The minutes found follow each
    other, so their rows are dealt by ranges of the whole order, counted per range, and ranked in the ranges of the page alone:
    a minute that holds most of the table is spread over the tasks like any other rows.
    """
    dated = df.withColumn("_minute", F.date_trunc("MINUTE", F.col(by)))
    upto = Window.orderBy(F.desc("_minute") if descending else F.asc("_minute")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hit = _holding(dated.groupBy("_minute").agg(F.count("*").alias("_n")), upto, offset, size)
    # Every minute hit holds a row of the page, so there are at most ``size`` of them.
    # Rows without a time are a minute of their own.
    hit = hit.select(F.col("_minute").alias("_hit"), F.min("_start").over(Window.partitionBy()).alias("_base"))
    near = dated.join(F.broadcast(hit) if size <= BROADCAST_ROWS else hit, F.col("_minute").eqNullSafe(F.col("_hit")))
    # Written, so that a row's range is the same wherever it is read.
    ranged = cut(near.repartitionByRange(*order).select(*df.columns, "_base", F.spark_partition_id().alias("_range")))
    first = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_base").alias("_base"))
    found = _holding(counts, first, offset, size, F.col("_base")).select("_range", "_start")
    # One row a range at most.
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.join(F.broadcast(found), "_range").withColumn("_place", place).filter(
        (F.col("_place") > offset) & (F.col("_place") <= offset + size))
    return ranked.select(*df.columns).orderBy(*order)


def _holding(counts: DataFrame, upto: WindowSpec, offset: int, size: int, base: Column | int = 0) -> DataFrame:
    """Of cells with ``_n`` rows each those that hold a row of the page, and how many rows come before (``_start``)."""
    spans = counts.withColumn("_end", base + F.sum("_n").over(upto)).withColumn("_start", F.col("_end") - F.col("_n"))
    return spans.filter((F.col("_end") > offset) & (F.col("_start") < offset + size))


def group_pages(df: DataFrame, group: str, by: str, order: list[Column], page: int, size: int,
                deep_from: int = GROUP_LIMIT) -> DataFrame:
    """One page of each group with ``place``, newest ``by`` first, as ``order`` says.

    Near pages rank with a limit that holds per task before the shuffle. Pages that end beyond ``deep_from`` rows count rows
    per group and day first, and rank only the days the page falls in, so no task sorts a group's whole history.
    """
    offset = (page - 1) * size
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    if offset + size > deep_from:
        df = cut(df.withColumn("_day", F.to_date(by)))
        upto = Window.partitionBy(group).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = _holding(df.groupBy(group, "_day").agg(F.count("*").alias("_n")), upto, offset, size)
        hit = hit.select(F.col(group).alias("_group"), F.col("_day").alias("_hit"), "_start")
        df = df.join(hit, F.col(group).eqNullSafe(F.col("_group")) & F.col("_day").eqNullSafe(F.col("_hit")))
        place = F.col("_start") + F.row_number().over(Window.partitionBy(group, "_day").orderBy(*order))
    ranked = df.withColumn("place", place).filter(F.col("place") <= offset + size).filter(F.col("place") > offset)
    return ranked.drop("_day", "_group", "_hit", "_start")


def kept(page: DataFrame) -> DataFrame:
    """Write a page that several joins read, so its search runs once. Every search is answered anew, and nothing stays cached."""
    return cut(page)


def only_keys(rows: DataFrame, keys: DataFrame, on: str, bound: int | None = None) -> DataFrame:
    """Rows whose ``on`` value occurs in ``keys``. ``bound`` is a proven limit on the keys' rows."""
    ids = keys.select(on)
    if bound is not None and bound <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), on, "left_semi")
    # Distinct first: partial aggregation keeps a hot key from piling up in one task.
    return rows.join(ids.distinct(), on, "left_semi")
