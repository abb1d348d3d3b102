"""Language ID by rank-order profiles.

A profile lists a text's ``SIZE`` most frequent n-grams of one to three characters in order (most frequent first, ties by
code). Text is lower-cased; everything but letters counts as one space. The distance of a document to a language is the sum,
over the document's n-grams, of how far each is out of place in the language's profile; an n-gram that is not in it counts
``SIZE``. The nearest language wins (ties: the first by name). The score is one minus the distance's share of the greatest
possible one.

Profiles are counted over a sample of at most about ``SAMPLE`` documents per language, taken by a hash of doc_id and
text; everything else covers all rows. A text that is null or has no letter is ``und`` with score 0, as is any text if
nothing was learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.llm import common

SIZE = 300
#: Documents per language that a profile is learned from.
SAMPLE = 2_000
#: Characters of a text that are counted at a time; the counts of all its blocks are added.
_BLOCK = 1 << 17
_GAP = re.compile(r"[\W\d_]+")
#: Scores below this are no language: random signs, not prose.
MIN_SCORE = 0.2


def letters(text: str | None) -> str:
    """Lower-cased letters with one space between runs, and at both ends; empty if there is no letter."""
    plain = _GAP.sub(" ", (text or "").lower())
    if not plain.isascii() and (odd := {c for c in set(plain) if c != " " and not c.isalpha()}):
        plain = " ".join(plain.translate(dict.fromkeys(map(ord, odd), " ")).split())
    plain = plain.strip()
    return f" {plain} " if plain else ""


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of one to three characters; a space alone is none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes, counts = [], []
    for a in range(0, len(code), _BLOCK):
        c = code[a:a + _BLOCK + 2]
        own = min(_BLOCK, len(code) - a)
        two = (c[:-1] << 21 | c[1:])[:own]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:own]
        found, n = np.unique(np.concatenate([c[:own][c[:own] != 32], two, three]), return_counts=True)
        codes.append(found)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent codes in order."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))][:size]


def learn(docs: DataFrame, size: int = SIZE, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """The profile of each language of ``docs`` (doc_id, text, lang; rows without a language or a text are left out)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    each = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(F.broadcast(each), "lang").filter(part * F.col("n") < sample)  # a row per language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(letters(text))
            for lang, texts in by.items():
                codes, counts = grams("".join(texts))
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(codes), "code": codes, "n": counts.astype(np.int64)})

    counted = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    profiles: dict[str, np.ndarray] = {}
    for (lang,) in sorted(each.select("lang").collect()):
        top = counted.filter(F.col("lang") == lang).orderBy(F.desc("n"), "code").limit(size).collect()
        if top:
            profiles[lang] = np.array([r.code for r in top], dtype=np.int64)
    return profiles


class Profiles:
    """All profiles side by side: for each known code its place in each language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.names])) if self.names else np.zeros(0, np.int64)
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int64)
        for j, k in enumerate(self.names):
            self.places[np.searchsorted(self.codes, profiles[k]), j] = np.arange(len(profiles[k]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        plain = letters(text)
        if not plain or not self.names:
            return "und", 0.0
        own = ranked(*grams(plain), self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != own] = len(self.codes)
        places = self.places[at]
        off = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.names[best], 1.0 - float(off[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.without(docs, "lang_pred", "score")
    shared = spark.sparkContext.broadcast(Profiles(profiles, size))
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(shared.value.nearest, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=schema.names)

    return docs.mapInArrow(judge, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, judge all: doc_id, held_out, lang_pred, score."""
    common.small_batches(spark)
    profiles = learn(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
