"""The five model tables, derived from the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """Parquet tables of one scale directory; every derived table is a plain projection or aggregate."""

    spark: SparkSession
    directory: str

    _seen: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def read(self, name: str) -> DataFrame:
        """A test table; its footer is read once per source."""
        if name not in self._seen:
            self._seen[name] = self.spark.read.parquet(f"{self.directory.rstrip('/')}/{name}.parquet")
        return self._seen[name]

    @property
    def programs(self) -> DataFrame:
        start = F.timestamp_add("MINUTE", F.col("o_orderkey") % 1440, F.col("o_orderdate"))
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_orderkey") % 65536).alias("event_id"),
            (F.lit(101) + F.col("o_custkey") % 8).alias("service_id"),
            F.concat(F.lit("Show "), F.col("o_orderpriority"), F.lit(" #"),
                     (F.col("o_orderkey") % 12 + 1).cast("string")).alias("name"),
            start.alias("start_time"),
            (F.lit(900) * (F.lit(1) + F.col("o_orderkey") % 8)).alias("duration"),
            F.lit(None).cast("string").alias("text"),
            F.lit(None).cast("string").alias("ext_text"),
            F.col("o_orderstatus").alias("genre"),
            F.timestamp_add("MINUTE", F.lit(1), start).alias("created_at"),
        )

    @property
    def recordings(self) -> DataFrame:
        # One-letter codes as numbers: fixed-width buffers keep this a hash aggregation.
        lines = self.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.char(F.min(F.ascii("l_returnflag"))).alias("flag"), F.char(F.min(F.ascii("l_linestatus"))).alias("status"),
            F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"),
            F.max("l_extendedprice").alias("price"))
        file_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        folder = F.when(F.col("status") == "F", "archive").otherwise("recorded")
        gone = F.col("flag") == "A"
        return lines.select(
            file_id.alias("id"), F.col("l_orderkey").alias("program_id"),
            F.when(gone, "").otherwise(
                F.concat(F.lit("//nas/"), folder, F.lit("/"), file_id.cast("string"))).alias("file_path"),
            F.when(~gone, F.floor("price").cast("bigint")).alias("file_size"),
            F.when(F.col("flag") == "R", F.col("last_at")).alias("watched_at"),
            F.when(gone, F.col("last_at")).alias("deleted_at"),
            F.col("first_at").alias("created_at"),
        )

    @property
    def views(self) -> DataFrame:
        """Every event is one view; about ten per viewed program, not all alike."""
        return self.read("events").select(
            F.expr("event_id div 100 * 10 + user_id % 10").alias("program_id"),
            F.col("ts").alias("viewed_time"),
            F.when(F.col("event_type") == "click", 2.0).when(F.col("event_type") != "error", 1.0).alias("speed"),
            F.col("ts").alias("created_at"),
        )

    @property
    def series(self) -> DataFrame:
        made = F.timestamp_add("DAY", F.col("id"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
        named = self.read("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
        return named.select("id", "name", made.alias("created_at"),
                            F.timestamp_add("DAY", F.lit(1), made).alias("modified_at"))

    @property
    def program_series(self) -> DataFrame:
        part = self.read("part").select("p_partkey", F.col("p_name").alias("name"))
        return (
            self.read("lineitem").select("l_orderkey", "l_partkey")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(self.series.select(F.col("id").alias("series_id"), "name"), "name")
            .select(F.col("l_orderkey").alias("program_id"), "series_id").distinct()
        )


# The same derivations for DuckDB, as common table expressions.
CTES = {
    "programs": """programs AS (SELECT o_orderkey AS id, o_orderkey % 65536 AS event_id,
        101 + o_custkey % 8 AS service_id,
        'Show ' || o_orderpriority || ' #' || CAST(o_orderkey % 12 + 1 AS VARCHAR) AS name,
        o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS start_time,
        900 * (1 + o_orderkey % 8) AS duration, CAST(NULL AS VARCHAR) AS text,
        CAST(NULL AS VARCHAR) AS ext_text, o_orderstatus AS genre,
        o_orderdate + to_minutes(CAST(o_orderkey % 1440 + 1 AS BIGINT)) AS created_at FROM orders)""",
    "recordings": """recordings AS (SELECT id, program_id,
        CASE WHEN flag = 'A' THEN '' ELSE '//nas/' || CASE WHEN status = 'F' THEN 'archive' ELSE 'recorded' END
            || '/' || CAST(id AS VARCHAR) END AS file_path,
        CASE WHEN flag <> 'A' THEN CAST(floor(price) AS BIGINT) END AS file_size,
        CASE WHEN flag = 'R' THEN last_at END AS watched_at,
        CASE WHEN flag = 'A' THEN last_at END AS deleted_at, first_at AS created_at
        FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS program_id, min(l_returnflag) AS flag,
            min(l_linestatus) AS status, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at,
            max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey, l_linenumber))""",
    "views": """views AS (SELECT CAST(event_id // 100 * 10 + user_id % 10 AS BIGINT) AS program_id,
        ts AS viewed_time, CASE WHEN event_type = 'click' THEN 2.0::DOUBLE
            WHEN event_type <> 'error' THEN 1.0::DOUBLE END AS speed, ts AS created_at FROM events)""",
    "series": """series AS (SELECT id, name, TIMESTAMP '2000-01-01' + to_days(CAST(id AS INTEGER)) AS created_at,
        TIMESTAMP '2000-01-02' + to_days(CAST(id AS INTEGER)) AS modified_at
        FROM (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name))""",
    "program_series": """program_series AS (SELECT DISTINCT l_orderkey AS program_id, s.id AS series_id
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN series s ON s.name = p_name)""",
}


def with_tables(body: str, *names: str, recursive: bool = False) -> str:
    """Prefix a query with the derived tables it reads; a body opening its own CTEs starts with a comma."""
    order = [n for n in CTES if n in names or (n == "series" and "program_series" in names)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTES[n] for n in order) + "\n" + body
