"""Recording files: validated appends, and patches with their rules.

A patch carries each field with a ``<field>_set`` flag, since a field left out is
not the same as one set to null. Patches of one recording apply in ``seq`` order;
each ends with a status: 200 done or nothing to do, 400, 404 or 500 refused whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger.functions import paths
from teleledger.operators.scan import last_before
from teleledger.session import cut

_COLUMNS = ["id", "program_id", "file_path", "file_size", "watched_at", "deleted_at", "created_at"]


def validate(arrivals: DataFrame) -> DataFrame:
    """Add ``is_valid``: whether the path may be stored."""
    return arrivals.withColumn("is_valid", paths.is_valid(F.col("file_path")))


def split_valid(arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and rows to set aside."""
    checked = validate(arrivals)
    return checked.filter("is_valid").drop("is_valid"), checked.filter("NOT is_valid").drop("is_valid")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_set"), F.lit(False))


def judge_patches(recordings: DataFrame, patches: DataFrame) -> DataFrame:
    """Each patch with its status and the file path before and after it.

    Patches: ``id, seq, file_path, file_folder, watched_at, deleted_at`` and the four ``_set`` flags.
    """
    deletes = _flag("deleted_at") & F.col("deleted_at").isNotNull()
    moves = ~deletes & _flag("file_folder")
    renames = ~deletes & ~_flag("file_folder") & _flag("file_path")
    malformed = (
        (deletes & _flag("file_path") & (F.coalesce(F.col("file_path"), F.lit("-")) != ""))
        | (moves & (_flag("file_path") | F.col("file_folder").isNull()))
        | (renames & ~paths.is_valid(F.col("file_path"))))
    sound = patches.select(
        "*", deletes.alias("deletes"), moves.alias("moves"), renames.alias("renames"), malformed.alias("malformed"))
    # What a patch does to the path, whatever the path is now: an outright value, or a folder.
    sound = sound.select(
        "*",
        F.when(~F.col("malformed") & F.col("deletes"), F.struct("seq", F.lit("").alias("path")))
        .when(~F.col("malformed") & F.col("renames"), F.struct("seq", F.col("file_path").alias("path")))
        .alias("put"),
        F.when(~F.col("malformed") & F.col("moves"), F.struct("seq", "file_folder")).alias("move"),
    )
    now = recordings.select("id", F.col("file_path").alias("stored_path"), F.lit(True).alias("known"))
    rows = last_before(sound, "id", "seq", ["put", "move"], initial=now)

    base = F.coalesce(F.col("prev_put.path"), F.col("stored_path"))
    moved = F.col("prev_move.seq") > F.coalesce(F.col("prev_put.seq"), F.lit(-(2**62)))
    # A folder change after the last outright value took effect unless the file was gone.
    old_path = F.when(F.coalesce(moved, F.lit(False)) & (base != ""),
                      F.coalesce(paths.with_folder(base, F.col("prev_move.file_folder")), base)).otherwise(base)
    rows = rows.withColumn("old_path", F.when(F.col("known"), old_path))
    status = (
        F.when(F.col("known").isNull(), 404)
        .when(F.col("malformed"), 400)
        .when(F.col("moves") & (F.col("old_path") == ""), 404)
        .when(F.col("moves") & (F.size(F.split("old_path", "/")) < 4), 500)
        .otherwise(200))
    rows = rows.withColumn("status", status)
    new_path = (
        F.when(F.col("status") != 200, F.col("old_path"))
        .when(F.col("deletes"), F.lit(""))
        .when(F.col("moves"), paths.with_folder(F.col("old_path"), F.col("file_folder")))
        .when(F.col("renames"), F.col("file_path"))
        .otherwise(F.col("old_path")))
    return rows.withColumn("new_path", new_path).select(
        "id", "seq", "status", "old_path", "new_path", "deletes", "moves",
        _flag("watched_at").alias("watched_at_set"), "watched_at",
        _flag("deleted_at").alias("deleted_at_set"), "deleted_at")


def apply_patches(recordings: DataFrame, judged: DataFrame) -> DataFrame:
    """The recordings after all accepted patches."""

    def latest(value: str, given: Column) -> Column:
        """The last accepted patch that gave this field, as a struct so that null stays a value."""
        return F.max_by(F.struct(F.col(value)), F.when(given, F.col("seq")))

    changes = judged.filter("status = 200").groupBy("id").agg(
        F.max_by("new_path", "seq").alias("new_path"),
        latest("watched_at", F.col("watched_at_set")).alias("w"),
        latest("deleted_at", F.col("deleted_at_set")).alias("d"),
        F.max(F.col("deletes")).alias("removed"),
    )
    joined = recordings.join(changes, "id", "left")
    return joined.select(
        "id", "program_id",
        F.coalesce("new_path", "file_path").alias("file_path"),
        F.when(F.coalesce("removed", F.lit(False)), None).otherwise(F.col("file_size")).alias("file_size"),
        F.when(F.col("w").isNotNull(), F.col("w.watched_at")).otherwise(F.col("watched_at")).alias("watched_at"),
        F.when(F.col("d").isNotNull(), F.col("d.deleted_at")).otherwise(F.col("deleted_at")).alias("deleted_at"),
        "created_at")


def patch_recordings(recordings: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New recordings, and every patch with its outcome."""
    # Both results, and the commands, follow from this; it is worked out once.
    judged = cut(judge_patches(recordings, patches))
    return apply_patches(recordings, judged), judged
