"""Document fingerprints: the set of Lempel-Ziv phrases of a text, as a minimum-hash signature.

A text is parsed from left to right: a phrase is the longest one met before and the character after it. Texts with much in
common share phrases, so the likeness of their phrase sets follows how well one would compress the other. Every phrase is
hashed by prefix polynomials modulo 2**64; the hashes are dealt to ``BINS`` bins, and the least of each bin is kept as one
byte (0: no phrase fell there). The likeness of two signatures is the share of equal bins among those filled in either one,
less what chance gives: an estimate of the Jaccard likeness of the phrase sets.

Empty texts have the empty signature, whose likeness is 1 to itself and 0 to any other. Null texts
are empty. Documents follow each other in ascending doc_id order, null first, equal ones in the order of a hash of their
text; after the last comes the first. A table of one document is its own next one. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.llm import common

BINS = 128
_BASE = 0x9E3779B97F4A7C15
_CHANCE = 1 / 255
_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double")
_BORDER = f"part int, border string, text string, {_OUT}"
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n`` at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        base = np.full(size, _BASE, dtype=np.uint64)
        inverse = np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
        base[0] = inverse[0] = 1
        _powers = np.cumprod(base), np.cumprod(inverse)
    return _powers


class Phrases:
    """The parse of a text, which can go on with other text from any place between phrases."""

    def __init__(self):
        self.seen: set[str] = set()
        self.ends: list[int] = [0]

    def fork(self) -> Phrases:
        other = Phrases()
        other.seen, other.ends = self.seen.copy(), self.ends.copy()
        return other

    def parse(self, text: str, stop: int) -> None:
        """Phrases up to the last one that ends at ``stop`` or before. As every start of a phrase is one itself, the longest
        one met before is found by stepping up or down from the length of the last phrase."""
        seen, ends = self.seen, self.ends
        at, size = ends[-1], 1
        while at < stop:
            if text[at:at + size] in seen:
                size += 1
                while at + size <= stop and text[at:at + size] in seen:
                    size += 1
            else:
                while size > 1 and text[at:at + size - 1] not in seen:
                    size -= 1
            if at + size > stop:
                return
            seen.add(text[at:at + size])
            at += size
            ends.append(at)

    def signature(self, text: str) -> bytes:
        """Of the parse of all of ``text``. What is left after the last phrase is a phrase too."""
        edges = np.array(self.ends if self.ends[-1] == len(text) else [*self.ends, len(text)])
        starts, ends = edges[:-1], edges[1:]
        up, down = _power_tables(len(text))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        prefix = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(codes * up[:len(text)], out=prefix[1:])
        return minima((prefix[ends] - prefix[starts]) * down[starts])


def minima(hashes: np.ndarray) -> bytes:
    """The least hash of each bin as a byte from 1 to 255; 0 where there is none."""
    x = hashes.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    x.sort()
    bins, first = np.unique(x % np.uint64(BINS), return_index=True)  # the first in order is the least
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins] = ((x[first] // np.uint64(BINS)) * np.uint64(_BASE) >> np.uint64(32)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard likeness of two phrase sets, from 0 to 1."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    filled = int(((x > 0) | (y > 0)).sum())
    if not filled:
        return 1.0
    equal = int(((x == y) & (x > 0)).sum()) / filled
    return max(0.0, (equal - _CHANCE) / (1 - _CHANCE))


def fingerprint(text: str) -> bytes:
    whole = Phrases()
    whole.parse(text, len(text))
    return whole.signature(text)


class Document:
    """A text with its fingerprint. The parse is kept where an edit may start."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.kept = len(text) - len(text) // 4
        self.start = Phrases()
        self.start.parse(text, self.kept)
        whole = self.start.fork()
        whole.parse(text, len(text))
        self.fingerprint = whole.signature(text)

    def row(self, after: Document) -> tuple:
        """The result for this document, followed by ``after``. It can be asked for once."""
        edited = self.text[:self.kept] + after.text[:len(self.text) - self.kept]
        self.start.parse(edited, len(edited))
        changed = self.start.signature(edited)
        return (self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                self.fingerprint.hex(), changed.hex(), likeness(self.fingerprint, changed),
                likeness(self.fingerprint, after.fingerprint))


def _sorted(docs: DataFrame) -> DataFrame:
    """All documents in order over the partitions. Equal rows may lie in several, in any order."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(common.partitions(docs.sparkSession), "doc_id", "tie", "row")
    return ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a partition's documents but the last. Its first and last texts go along, for the partitions beside it."""
    part, first, last = TaskContext.get().partitionId(), None, None
    nothing = (None,) * 6
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            now = Document(doc_id, text)
            if last is None:
                rows.append((part, "first", text, doc_id, *nothing))
            else:
                rows.append((part, None, None, *last.row(now)))
            last = now
        yield _batch(rows, _BORDER)
    if last is not None:
        yield _batch([(part, "last", last.text, last.doc_id, *nothing)], _BORDER)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)],
                                      names=[n for n, _ in fields])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents whose next one lies in another partition."""
    for batch in batches:
        yield _batch([Document(r["doc_id"], r["text"]).row(Document(None, r["after"])) for r in batch.to_pylist()], _OUT)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's."""
    common.small_batches(spark)
    made = common.stored(_sorted(docs).mapInArrow(_within, _BORDER), "lz-fingerprints")
    firsts = made.filter("border = 'first'").select("part", F.col("text").alias("after"))
    lasts = made.filter("border = 'last'").select("part", "doc_id", "text")
    # One number for each partition; those without documents have none.
    parts = sorted(r["part"] for r in firsts.select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    ends = lasts.join(follows, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "after")
    columns = [f.split()[0] for f in _OUT.split(", ")]
    return made.filter("border is null").select(*columns).union(ends.mapInArrow(_across, _OUT))
