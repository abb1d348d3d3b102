"""Shared helpers: the run folder, stored intermediates, bounded Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.session import ship

#: Rows a Python worker gets at once; long texts must not add up.
BATCH_ROWS = 256
#: Size of a filter in bits: so many for each fingerprint, and no more than the limit whatever the data.
FILTER_BITS, FILTER_LIMIT = 16, 1 << 28
_BASE = 0x9E3779B97F4A7C15
_ALL = 2**64 - 1

_local_roots: dict[str, str] = {}
_kept: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only on a single machine that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="llm-run-")
    return _local_roots[context.applicationId]


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one. Its owner removes it once the results have been read."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; Spark has no call of its own for that."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The stored tables of one operator. Leaving the block removes them, but for those that its result reads: these stay
    until the caller has read the result and calls ``release``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        for df in [x for x, _ in self.paths.values()]:
            self.drop(df)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read many times: cuts the lineage and survives the loss of executors."""
        path = run_folder(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (back, path)
        return back

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, self.paths.pop(id(df))[1])

    def keep(self, df: DataFrame) -> DataFrame:
        _kept.setdefault(self.spark.sparkContext.applicationId, []).append(self.paths.pop(id(df))[1])
        return df


def release(spark: SparkSession) -> None:
    """Remove what results of earlier calls read; call it once they have been read or written elsewhere."""
    for path in _kept.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


@contextmanager
def reading(spark: SparkSession) -> Iterator[None]:
    """Within it results are made and read; what they alone read is removed at its end."""
    kept = _kept.setdefault(spark.sparkContext.applicationId, [])
    before = len(kept)
    yield
    while len(kept) > before:
        remove(spark, kept.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """A stored table that stays until ``release``."""
    scratch = Scratch(df.sparkSession)
    return scratch.keep(scratch.stored(df, name))


def small_batches(spark: SparkSession) -> None:
    """Make a session ready for Python in tasks: this package on the executors, and batches of few rows."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have; case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator's own outputs replace; case does not tell names apart."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = n + 1 + n // 8
        base = np.full(size, _BASE, dtype=np.uint64)
        inverse = np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
        base[0] = inverse[0] = 1
        _powers = np.cumprod(base), np.cumprod(inverse)
    return _powers


def fingerprints(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: int = _ALL) -> np.ndarray:
    """Of ``values[start:end]`` each, by prefix polynomials. ``mask`` weakens them, for tests of collisions."""
    up, down = _power_tables(len(values))
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.multiply(values, up[:len(values)], out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    x = (prefix[ends] - prefix[starts]) * down[starts]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) & np.uint64(mask)


@dataclass(frozen=True)
class Filter:
    """Which fingerprints may be frequent: two bits each."""

    words: np.ndarray

    def has(self, x: np.ndarray) -> np.ndarray:
        slots = np.uint64(len(self.words) * 64 - 1)
        found = np.ones(len(x), dtype=bool)
        for y in (x, x >> np.uint64(32)):
            y = y & slots
            found &= (self.words[y >> np.uint64(6)] >> (y & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def filter_of(found: DataFrame, bits: int, limit: int) -> Filter:
    """Of stored fingerprints. Its words are made by the tasks; their number does not pass the limit."""
    n = found.count()
    slots = min(max(1 << (bits * n).bit_length(), 1 << 12), limit)
    halves = found.select(F.explode(F.array(F.col("fp"), F.shiftrightunsigned("fp", 32))).alias("x"))
    slot = F.col("x").bitwiseAND(F.lit(slots - 1))
    set_ = halves.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(x & 63L))")).alias("set"))
    got = set_.toArrow()
    words = np.zeros(slots // 64, dtype=np.uint64)
    words[got["at"].to_numpy()] = got["set"].to_numpy().view(np.uint64)
    return Filter(words)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root``: the least node that each node of ``edges`` (``a``, ``b``) reaches. ``scratch`` owns the result, if given.

    Alternates two steps until nothing changes: every node hands its larger neighbours to the least node it knows,
    then its smaller ones. Each step is a minimum by key and a join, so a hub is split like any skewed key.
    Nodes without an edge to another node have no row.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    owner, scratch = scratch, scratch or Scratch(edges.sparkSession)
    edges = scratch.stored(edges.filter(F.col("a") != F.col("b")).select(most.alias("a"), least.alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(F.array(
                F.struct(F.col("a"), F.col("low").alias("b")),
                F.struct(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b")))).alias("e"))
        before, edges = edges, scratch.stored(small.select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct(), "edges")
        scratch.drop(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return (edges if owner else scratch.keep(edges)).select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
