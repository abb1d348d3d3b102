"""Benchmark decontamination: training token windows against a hash set of the benchmark's windows.

A window is ``n`` consecutive words of a benchmark item (an item with fewer words, but not none, is one window). The set is
sent to the tasks only in blocks of at most ``BLOCK_CHARS`` characters of benchmark text; a larger benchmark is scanned in
several passes, each of which adds its hits to the stored result of the one before. A worker turns a document into
the benchmark's word numbers, looks only at runs of words that all occur in the benchmark, and takes a window as hit
when all its words are equal.

Null text has no words. A null item_id is listed as an empty string; equal items are listed once per id. With an empty
benchmark nothing is hit. Columns of ``docs`` named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger.llm import common

N = 13
#: Characters of benchmark text in one broadcast set.
BLOCK_CHARS = 32_000_000
#: A document counts as contaminated if at least one word in so many is hit.
SHARE = 20

_KEEP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CLEAN = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or _KEEP.match(bytes([c])) else 32) for c in range(256))

_OUT = {"n_words": T.LongType(), "hits": T.ArrayType(T.LongType()), "item_ids": T.ArrayType(T.StringType())}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN).split()


class WindowSet:
    """The windows of some benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.number: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], dtype=np.int32)
            width = min(n, len(ids))
            for i in range(len(ids) - width + 1 if width else 0):
                self.windows.setdefault(width, {}).setdefault(ids[i:i + width].tobytes(), set()).add(item)
        self.first = {w: np.unique([np.frombuffer(k, np.int32)[0] for k in found]) for w, found in self.windows.items()}

    def scan(self, split: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[str]]]:
        """For each document the places of its hit words and the items whose windows occur."""
        counts = np.array([len(w) + 1 for w in split])
        ids = np.zeros(int(counts.sum()), dtype=np.int32)  # documents end with a number that no window has
        begin = np.cumsum(counts) - counts
        for a, found in zip(begin.tolist(), split):
            ids[a:a + len(found)] = np.fromiter(map(self.number.get, found, repeat(0)), np.int32, len(found))
        stops = np.flatnonzero(ids == 0)
        gap = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids))  # known words from here on
        marks = np.zeros(len(ids) + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in split]
        for width, known in self.windows.items():
            first = np.zeros(len(self.number) + 1, dtype=bool)
            first[self.first[width]] = True
            at = np.flatnonzero((gap >= width) & first[ids])
            owner = np.searchsorted(begin, at, side="right") - 1
            for i, d in zip(at.tolist(), owner.tolist()):
                if (found := known.get(ids[i:i + width].tobytes())) is not None:
                    marks[i] += 1
                    marks[i + width] -= 1
                    items[d] |= found
        hit = np.cumsum(marks[:-1]) > 0
        return [np.flatnonzero(hit[a:a + c]) for a, c in zip(begin.tolist(), counts.tolist())], items


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    block, chars = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        block.append((item, text))
        chars += len(text or "")
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block or chars == 0:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with n_words, hits (places of the words inside any window, ascending) and item_ids (sorted as strings)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.without(docs, *_OUT)
    done = None
    for block in _blocks(benchmark):
        done = docs if done is None else common.stored(done, "hits")
        schema = T.StructType([f for f in done.schema.fields if f.name not in _OUT] + [T.StructField(k, v) for k, v in _OUT.items()])
        shared = spark.sparkContext.broadcast(WindowSet(block, n))

        def add(batches: Iterator[pa.RecordBatch], shared=shared, schema=schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                split = list(map(words, batch.column("text").to_pylist()))
                hits, items = shared.value.scan(split)
                if "hits" in batch.schema.names:
                    hits = [np.union1d(a, b) for a, b in zip(hits, batch.column("hits").to_pylist())]
                    items = [a.union(b) for a, b in zip(items, batch.column("item_ids").to_pylist())]
                made = {"n_words": pa.array(list(map(len, split)), pa.int64()),
                        "hits": pa.array([x.tolist() for x in hits], pa.list_(pa.int64())),
                        "item_ids": pa.array(list(map(sorted, items)), pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(
                    [made[k] if k in made else batch.column(k) for k in schema.names], names=schema.names)

        done = done.mapInArrow(add, schema)
    return done


def contaminated(share: int = SHARE) -> Column:
    return (F.size("hits") > 0) & (share * F.size("hits") >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = SHARE) -> DataFrame:
    """The documents of which fewer than one word in ``share`` is inside a benchmark window."""
    return scan(docs, benchmark, n).filter(~contaminated(share)).select(*[f"`{c}`" for c in docs.columns if c not in _OUT])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """All documents, their text without the words inside benchmark windows and what stands between these words."""
    hit = scan(docs, benchmark, n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                if hits:
                    data, gone = text.encode(), set(hits)
                    places = [m.span() for m in re.finditer(rb"\S+", data.translate(_CLEAN))]
                    kept, last = [], 0
                    for i, (a, b) in enumerate(places):
                        if i in gone:
                            kept.append(data[last:a] if i - 1 not in gone else b"")
                            last = b
                    text = (b"".join(kept) + data[last:]).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == "text" else batch.column(k) for k in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return hit.mapInArrow(cut, hit.schema)


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: The report in SQL. Rows are numbered, as a doc_id may come more than once.
SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
placed AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM placed),
seen AS (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS MATERIALIZED (
  SELECT x.r, x.k, x.p, win.item_id FROM (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM seen) x JOIN win USING (k, s)),
covered AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + k)) AS x FROM (SELECT DISTINCT r, k, p FROM hit)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
