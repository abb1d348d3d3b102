"""Substring dedup with sliding sentence spans.

Every run of ``RUN`` consecutive sentences of a document is hashed (lower-cased words only, so that white space and punctuation
do not count). Hashes are joined over all documents; a sentence is removed if a run that covers it occurred before: in a document
with a smaller doc_id, or earlier in its own. Runs of fewer than ``MIN_WORDS`` words are too common to prove a copy; they
are widened by the following sentences until they have as many. Sentences end at ``.``, ``!``, ``?`` or a line break.

Null text has no sentences and stays null; a null doc_id comes before all others. Rows that repeat doc_id and text are one
document and get the same result; of rows with one doc_id and different texts one keeps a run that they share. Columns of
``docs`` named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleledger.llm import common

RUN = 2
MIN_WORDS = 15
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+[\"')\]]*\s*|$)")
_OUT = ("n_sentences", "n_removed", "removed_spans")


def sentences(text: str | None) -> list[str]:
    """The sentences with what follows them; joined they are the text."""
    return [s for s in _SENTENCE.findall(text or "") if s]


_WORDS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def runs(text: str | None, run: int = RUN, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of each run; sentences without a word belong to the run but do not count."""
    parts = [s.encode().translate(_WORDS).split() for s in sentences(text)]
    full = [i for i, w in enumerate(parts) if w]
    out = []
    for k in range(len(full)):
        words, j = 0, k
        while j < len(full) and (j - k < run or words < least):
            words += len(parts[full[j]])
            j += 1
        if j - k >= run and words >= least:
            data = b" ".join([w for i in full[k:j] for w in parts[i]])
            out.append((xxhash.xxh3_128_intdigest(data), full[k], full[j - 1] - full[k] + 1))
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


_SPANS = "h1 long, h2 long, d long, t long, place long, own boolean"


def spans(docs: DataFrame, run: int = RUN, least: int = MIN_WORDS) -> DataFrame:
    """Every run: its hash, document, place (first sentence and length in one number), and whether its document had it before."""
    common.small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, text in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "text"))):
                seen = set()
                for h, i, n in runs(text, run, least):
                    rows.append((_signed(h >> 64), _signed(h & ((1 << 64) - 1)), d, t, i << 32 | n, h in seen))
                    seen.add(h)
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in columns[:5]] + [pa.array(columns[5], pa.bool_())],
                    names=["h1", "h2", "d", "t", "place", "own"])

    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("t"), "text")
    return keyed.mapInArrow(hashed, _SPANS)


def repeated(docs: DataFrame, run: int = RUN, least: int = MIN_WORDS) -> DataFrame:
    """d, t, place: every run that is not the first of its kind. The runs are made twice rather than kept."""
    made = spans(docs, run, least)
    first = (made.filter(~F.col("own")).groupBy("h1", "h2")
             .agg(F.min("d").alias("d0"), F.min_by("t", "d").alias("t0"), F.count("*").alias("n")).filter("n > 1"))
    first = common.stored(first.select("h1", "h2", "d0", "t0"), "repeats")
    later = made.filter(~F.col("own")).join(first, ["h1", "h2"]).filter("d <> d0 or t <> t0").select("d", "t", "place")
    return later.union(made.filter("own").select("d", "t", "place"))


def remove_repeats(docs: DataFrame, run: int = RUN, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the sentences that a repeated run covers, with n_sentences, n_removed and removed_spans.

    The spans are in characters of the text as it was.
    """
    docs = common.without(docs, *_OUT)
    gone = repeated(docs, run, least).groupBy("d", "t").agg(F.collect_set("place").alias("_places"))
    d, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64("text")
    joined = docs.withColumn("_d", d).withColumn("_t", t).join(
        gone.withColumnsRenamed({"d": "_d", "t": "_t"}), ["_d", "_t"], "left").drop("_d", "_t")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(docs.schema.fields + [
        T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed, found = [], [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("_places").to_pylist()):
                parts = sentences(text)
                off = set()
                for x in places or ():
                    off.update(range(x >> 32, (x >> 32) + (x & 0xFFFFFFFF)))
                at, ranges = 0, []
                for i, s in enumerate(parts):
                    if i in off:
                        if ranges and ranges[-1]["end"] == at:
                            ranges[-1]["end"] = at + len(s)
                        else:
                            ranges.append({"start": at, "end": at + len(s)})
                    at += len(s)
                texts.append("".join([s for i, s in enumerate(parts) if i not in off]) if off else text)
                counts.append(len(parts))
                removed.append(len(off))
                found.append(ranges)
            made = {"text": pa.array(texts, pa.string()), "n_sentences": pa.array(counts, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "removed_spans": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
            yield pa.RecordBatch.from_arrays([made[k] if k in made else batch.column(k) for k in schema.names], names=schema.names)

    return joined.mapInArrow(cut, schema)
