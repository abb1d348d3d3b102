"""View times and recording ids of a program, as arrays.

An array lives in one row, so it must stay bounded whatever a single program's
share of the data is. Programs with up to ``PART_ROWS`` entries get one row with
whole arrays; a larger one gets several rows (``part`` 0 .. ``parts`` - 1), each
holding a share of the entries. Concatenating the parts gives the whole array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleledger.operators.paging import BROADCAST_ROWS, only_keys

PART_ROWS = 100_000


def nested_by_program(
    views: DataFrame,
    recordings: DataFrame | None,
    keys: DataFrame,
    bound: int | None = None,
    live_only: bool = False,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``program_id, part, parts, viewed_times, recordings`` for the programs in ``keys``.

    ``bound`` is a proven limit on the keys' rows: then the tables are cut down to them
    first. Otherwise they are aggregated first, so that no shuffle gathers one program's rows.
    Both arrays ascend. Programs with neither views nor recordings have no row here.
    """
    bounded = bound is not None and bound <= BROADCAST_ROWS

    def rows_of(table: DataFrame, *columns: str) -> DataFrame:
        rows = table.select("program_id", *columns)
        return only_keys(rows, keys, "program_id", bound) if bounded else rows

    entries = (
        rows_of(views, "viewed_time").filter(F.col("viewed_time").isNotNull())
        .groupBy("program_id", "viewed_time").agg(F.count("*").alias("copies"))
        .select("program_id", "viewed_time", F.lit(None).cast("string").alias("rid"), "copies"))
    id_type = "string"
    if recordings is not None:
        id_type = recordings.schema["id"].dataType.simpleString()
        files = rows_of(recordings.filter("deleted_at IS NULL") if live_only else recordings, "id")
        entries = entries.unionByName(files.select(
            "program_id",
            F.lit(None).cast(views.schema["viewed_time"].dataType).alias("viewed_time"),
            F.col("id").cast("string").alias("rid"),
            F.lit(1).cast("bigint").alias("copies"),
        ))

    # Entries per program, summed on the map side, decide the number of parts.
    sizes = entries.groupBy("program_id").agg(
        F.ceil(F.sum("copies") / part_rows).cast("bigint").alias("parts"))
    if bounded:
        sized = entries.join(F.broadcast(sizes), "program_id")
    else:
        sized = entries.join(sizes.join(keys.select("program_id").distinct(), "program_id", "left_semi"), "program_id")

    # Copies of one moment beyond a part's size are spread over parts as well.
    spread = (
        sized.select(
            "program_id", "viewed_time", "rid", "copies", "parts",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / part_rows))).alias("slice"))
        .withColumn("n", F.least(F.lit(part_rows), F.col("copies") - F.col("slice") * part_rows).cast("int"))
        .withColumn("part", F.when(F.col("parts") == 1, F.lit(0)).otherwise(
            F.pmod(F.xxhash64("viewed_time", "rid", "slice"), F.col("parts"))).cast("int"))
    )
    time = F.when(F.col("viewed_time").isNotNull(), F.struct("viewed_time", "n"))
    if not bounded:
        # By part as well: the join above leaves all parts of a program in one place.
        spread = spread.repartition("program_id", "part")
    out = spread.groupBy("program_id", "part").agg(
        F.first("parts").alias("parts"),
        F.array_sort(F.collect_list(time)).alias("times"),
        F.collect_list("rid").alias("rids"),
    )
    return out.select(
        "program_id", "part", "parts",
        F.flatten(F.transform("times", lambda x: F.array_repeat(x["viewed_time"], x["n"]))).alias("viewed_times"),
        F.array_sort(F.col("rids").cast(f"array<{id_type}>")).alias("recordings"),
    )


def with_nested(df: DataFrame, nested: DataFrame, on: str = "program_id") -> DataFrame:
    """Attach the arrays; rows without entries get empty ones."""
    joined = df.join(nested.withColumnRenamed("program_id", on), on, "left")
    times, ids = nested.schema["viewed_times"].dataType, nested.schema["recordings"].dataType
    return (
        joined
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("viewed_times", F.coalesce("viewed_times", F.array().cast(times)))
        .withColumn("recordings", F.coalesce("recordings", F.array().cast(ids)))
    )
