"""Running values over an ordered history, safe for a key that holds much of the data.

A window over one key puts all its rows in one task. Here a key's history is cut
into blocks of its sequence number; each block is scanned on its own, and only
one summary row per block is scanned across blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000


def last_before(df: DataFrame, key: str, seq: str, values: list[str], initial: DataFrame | None = None,
                block: int = BLOCK) -> DataFrame:
    """Add ``prev_<v>``: the latest non-null ``v`` strictly before the row, per key.

    ``seq`` is a whole number, unique per key, so a block holds at most ``block`` rows.
    ``initial`` has one row per key, whose other columns are added to the key's rows; it is
    joined to the blocks, not to the rows.
    """
    cut = df.withColumn("_block", F.floor(F.col(seq) / block).cast("bigint"))
    before = Window.partitionBy(key, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.select("*", *[F.last(v, ignorenulls=True).over(before).alias(f"_in_{v}") for v in values])

    ends = cut.groupBy(key, "_block").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(seq))).alias(f"_end_{v}") for v in values])
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        key, "_block", *[F.last(f"_end_{v}", ignorenulls=True).over(earlier).alias(f"_carry_{v}") for v in values])
    extra: list[str] = []
    if initial is not None:
        extra = [c for c in initial.columns if c != key]
        carried = carried.join(initial, key, "left")
    joined = inside.join(carried, [key, "_block"], "left")
    return joined.select(
        *df.columns, *[F.coalesce(f"_in_{v}", f"_carry_{v}").alias(f"prev_{v}") for v in values], *extra)
