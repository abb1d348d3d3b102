"""File commands that follow from recording patches, and their intake on the file side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger import schema
from teleledger.functions import paths


def file_commands(judged: DataFrame) -> DataFrame:
    """``id, seq, action, file_path, old_path, new_path, value``; ``value`` is the message as JSON."""
    delete = F.col("deletes") & (F.col("old_path") != "")
    rename = ~F.col("deletes") & F.col("moves") & (F.col("old_path") != F.col("new_path"))
    rows = judged.filter("status = 200").filter(delete | rename)
    columns = rows.select(
        "id", "seq",
        F.when(delete, "delete").otherwise("rename").alias("action"),
        F.when(delete, F.col("old_path")).alias("file_path"),
        F.when(~delete, F.col("old_path")).alias("old_path"),
        F.when(~delete, F.col("new_path")).alias("new_path"))
    # Absent fields stay out of the message.
    return columns.withColumn("value", F.to_json(F.struct("action", "file_path", "old_path", "new_path")))


def parse_commands(messages: DataFrame, value: str = "value") -> DataFrame:
    """Decode queued messages; ``bad`` marks text that is not a JSON object."""
    parsed = F.from_json(F.col(value).cast("string"), schema.FILE_COMMAND)
    decoded = messages.withColumn("_c", parsed)
    is_object = F.coalesce(
        F.get_json_object(F.col(value).cast("string"), "$").startswith("{"), F.lit(False))
    return decoded.select(
        *messages.columns, (~is_object).alias("bad"),
        F.when(is_object, F.col("_c.action")).alias("action"),
        F.when(is_object, F.col("_c.file_path")).alias("file_path"),
        F.when(is_object, F.col("_c.old_path")).alias("old_path"),
        F.when(is_object, F.col("_c.new_path")).alias("new_path"))


def route_commands(parsed: DataFrame) -> DataFrame:
    """Add ``route`` (delete, rename, ignore or dead_letter), the path it is about, and the folder to make."""
    route = (
        F.when(F.col("bad"), "dead_letter")
        .when((F.col("action") == "delete") & F.col("file_path").isNull(), "dead_letter")
        .when((F.col("action") == "rename") & (F.col("old_path").isNull() | F.col("new_path").isNull()), "dead_letter")
        .when(F.col("action").isin("delete", "rename"), F.col("action"))
        .otherwise("ignore"))
    return parsed.select(
        "*", route.alias("route"),
        paths.first_given(F.col("file_path"), F.col("old_path")).alias("about_path"),
        F.when((F.col("action") == "rename") & F.col("new_path").contains("/"),
               paths.parent_of(F.col("new_path"))).alias("make_folder"))


# File-server statuses that mean the target is invalid or not there.
MISSING_TARGET = [0xC0000033, 0xC0000034, 0xC000003A]

OUTCOME_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("error", T.BooleanType()), T.StructField("ntstatus", T.LongType())])


def acknowledge(attempted: DataFrame) -> DataFrame:
    """Add ``ack``: a target that is not there counts as done; any other error is tried again."""
    failed = F.coalesce(F.col("error"), F.lit(False))
    missing = F.coalesce(F.col("ntstatus").isin(MISSING_TARGET), F.lit(False))
    return attempted.withColumn("ack", ~failed | missing)
