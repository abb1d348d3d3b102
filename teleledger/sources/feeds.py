"""Landing feeds, read with fixed schemas, in batch or as streams; and the command queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger import schema
from teleledger.operators.epg import channel_list


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def status_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Player reports as raw text, one JSON object per line, so a broken line can be set aside."""
    return _reader(spark, stream).schema("value string").text(path)


def queue(spark: SparkSession, source: str, options: dict[str, str], stream: bool = True) -> DataFrame:
    """Messages of any installed connector (``kafka``, for one) as text in ``value``."""
    rows = _reader(spark, stream).format(source).options(**options).load()
    return rows.withColumn("value", F.col("value").cast("string"))


def epg_feed(spark: SparkSession, path: str) -> DataFrame:
    """Nested guide files; ``svc_pos`` must be in the landed rows, since files have no order on a cluster."""
    fields = T.StructType(schema.EPG_FEED.fields + [T.StructField("svc_pos", T.LongType())])
    return spark.read.schema(fields).json(path)


def recorder_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RECORDER_INFO).json(path)


def view_arrivals(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    fields = T.StructType(schema.VIEW_ARRIVAL.fields + [T.StructField("seq", T.LongType())])
    return _reader(spark, stream).schema(fields).json(path)


def recording_arrivals(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    fields = T.StructType(schema.RECORDING_ARRIVAL.fields + [T.StructField("seq", T.LongType())])
    return _reader(spark, stream).schema(fields).json(path)


def channels(spark: SparkSession, path: str) -> DataFrame:
    return channel_list(spark.read.text(path))


def file_listing(spark: SparkSession, path: str, mount: str = "", server_prefix: str = "") -> DataFrame:
    """``path, length`` of the files under a folder; contents are not read.

    ``mount`` is the local form of ``server_prefix``, the form recordings are stored under.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    if not mount:
        return rows
    local = F.regexp_replace("path", r"^file:/+", "/")
    return rows.select(
        F.when(local.startswith(mount), F.concat(F.lit(server_prefix), F.substring(local, F.lit(len(mount) + 1), F.length(local))))
        .otherwise(local).alias("path"), "length")


def publish_commands(commands: DataFrame, sink: str | None, options: dict[str, str]) -> bool:
    """Send command messages (column ``value``) to a connector or as text files; without a sink nothing is sent."""
    if not sink:
        return False
    messages = commands.select("value")
    messages.write.format(sink).options(**options).mode("append").save()
    return True
