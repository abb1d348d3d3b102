"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are made of word shingles; a bit is one if it is set in over half of the shingles' hashes. Documents with one
fingerprint are one node from the start. Nodes link at ``LIMIT`` or fewer differing bits; the result is the connected
components over all links.

Two fingerprints that differ in at most ``LIMIT`` bits agree in one of ``LIMIT + 1`` blocks. So each fingerprint is entered
``LIMIT + 1`` times, turned so that another block leads, and the entries are sorted by Gray rank: entries of one lead lie
together, and neighbours differ in few bits. The index has three levels: the lead (a mask of the block's bits), leaves of
``LEAF`` neighbours, and nodes of ``NODE`` neighbours. Leaves and nodes carry the bits all their members share as pattern and
mask. Two groups are compared only if the bits in which their patterns differ, under both masks, are at most ``LIMIT``.

A lead with very many entries is many leaves, spread by the range sort. Links inside leaves are found first; leaves whose members
are all of one component by then need no comparison with each other. A comparison returns one link per pair of components,
never all pairs.

Null or wordless text has fingerprint zero. The component's name is the least doc_id in it, without nulls. Equal rows get
equal results. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.llm import common

SHINGLE = 4
LIMIT = 4
LEAF, NODE = 256, 16
SEED = 42
#: Shingles hashed at a time; the counts of all blocks are added.
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(shingles), _BLOCK):
        part = shingles[a:a + _BLOCK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in part), dtype="<u8", count=len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed) of each row."""
    common.small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(make, "doc_id long, fp long")


def _blocks(limit: int) -> list[tuple[int, int]]:
    """First bit (from the top) and width of each block."""
    n = limit + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _turned(column: str, by: int) -> Column:
    return F.col(column) if not by else F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, 64 - by))


def _gray_rank(column: Column) -> Column:
    """Place of a code in Gray order, shifted so that signed order is right."""
    for k in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, k))
    return column.bitwiseXOR(F.lit(-(2**63)))


def shared_bits(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and mask of each group of ``width`` consecutive values."""
    at = np.arange(0, len(values), width)
    both, any_ = np.bitwise_and.reduceat(values, at), np.bitwise_or.reduceat(values, at)
    mask = ~(both ^ any_)
    return both & mask, mask


def close_pairs(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs at most ``limit`` bits apart; groups of nodes fall out by what their shared bits differ in."""
    (pa_, ma), (pb, mb) = shared_bits(a, NODE), shared_bits(b, NODE)
    apart = np.bitwise_count((pa_[:, None] ^ pb[None, :]) & ma[:, None] & mb[None, :])
    x, y = np.nonzero(apart <= limit)
    inner = np.arange(NODE)
    i = np.minimum(x[:, None] * NODE + inner, len(a) - 1)
    j = np.minimum(y[:, None] * NODE + inner, len(b) - 1)
    near = np.bitwise_count(a[i][:, :, None] ^ b[j][:, None, :]) <= limit
    g, k, m = np.nonzero(near)
    return i[g, k], j[g, m]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index that each of ``n`` points reaches."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _leaves(entries: DataFrame, limit: int) -> DataFrame:
    """Leaves of the index over fp, comp: lead, leaf number, pattern, mask, members, their components."""
    turns = [
        F.struct(F.lit(k).alias("turn"), _gray_rank(_turned("fp", a)).alias("rank"), F.shiftrightunsigned(_turned("fp", a), 64 - w).alias("lead"))
        for k, (a, w) in enumerate(_blocks(limit))]
    entered = entries.select("fp", "comp", F.explode(F.array(*turns)).alias("e")).select("fp", "comp", "e.*")
    ordered = entered.repartitionByRange(common.partitions(entries.sparkSession), "turn", "rank").sortWithinPartitions("turn", "rank")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # turn, lead, fp, comp of the entries of an unfinished leaf

        def leaf(block: np.ndarray) -> tuple:
            fps = block[2].view(np.uint64)
            pattern, mask = shared_bits(fps, len(fps))
            return (int(block[0, 0]), int(block[1, 0]), int(fps[0].view(np.int64)), int(pattern.view(np.int64)[0]),
                    int(mask.view(np.int64)[0]), block[2].tobytes(), block[3].tobytes(), int(block[3].min()), int(block[3].max()))

        def flush(rows: np.ndarray, last: bool) -> tuple[list[tuple], np.ndarray]:
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            made, edges = [], [0, *change.tolist(), rows.shape[1]]
            for a, b in zip(edges, edges[1:]):
                final = last or b < rows.shape[1]
                while a < b and (final or b - a >= LEAF):
                    made.append(leaf(rows[:, a:min(b, a + LEAF)]))
                    a = min(b, a + LEAF)
            return made, rows[:, a:]

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32()] + [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made), kinds)], names=_LEAF_NAMES)

        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("turn", "lead", "fp", "comp")])
            rows = np.concatenate([*held, own], axis=1)
            made, rest = flush(rows, False)
            held = [rest]
            if made:
                yield batch_of(made)
        if held and held[0].shape[1]:
            yield batch_of(flush(held[0], True)[0])

    return ordered.mapInArrow(group, _LEAF)


_LEAF = "turn int, lead long, first long, pattern long, mask long, fps binary, comps binary, low long, high long"
_LEAF_NAMES = [x.split()[0] for x in _LEAF.split(", ")]


def _compared(pairs: DataFrame, limit: int) -> DataFrame:
    """a, b: components linked by two leaves' members, as a forest."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fa, ca, fb, cb in zip(*(batch.column(c).to_pylist() for c in ("fps_a", "comps_a", "fps_b", "comps_b"))):
                i, j = close_pairs(np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64), limit)
                x, y = np.frombuffer(ca, np.int64)[i], np.frombuffer(cb, np.int64)[j]
                names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                root = _forest(len(names), at[:len(x)], at[len(x):])
                moved = root != np.arange(len(names))
                out.append(np.stack([names[moved], names[root[moved]]]))
            found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def _named(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries with their component after these links."""
    roots = common.components(edges).select(F.col("node").alias("comp"), "root")
    return entries.join(roots, "comp", "left").select("fp", F.coalesce("root", "comp").alias("comp"))


def link(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """fp, comp: the least fingerprint that each distinct ``fp`` reaches."""
    entries = distinct.select("fp", F.col("fp").alias("comp"))
    alone = _leaves(entries, limit).select(
        F.col("fps").alias("fps_a"), F.col("comps").alias("comps_a"), F.col("fps").alias("fps_b"), F.col("comps").alias("comps_b"))
    entries = common.stored(_named(entries, _compared(alone, limit)), "entries")
    leaves = common.stored(_leaves(entries, limit), "leaves")
    a = leaves.select("turn", "lead", *[F.col(c).alias(f"{c}_a") for c in _LEAF_NAMES[2:]])
    b = leaves.select("turn", "lead", *[F.col(c).alias(f"{c}_b") for c in _LEAF_NAMES[2:]])
    apart = F.bit_count(F.col("pattern_a").bitwiseXOR(F.col("pattern_b")).bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b")))
    one = (F.col("low_a") == F.col("high_a")) & (F.col("low_b") == F.col("high_b")) & (F.col("low_a") == F.col("low_b"))
    pairs = a.join(b, ["turn", "lead"]).filter((F.col("first_a") < F.col("first_b")) & (apart <= limit) & ~one)
    return _named(entries, _compared(pairs, limit))


def report(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id."""
    made = common.stored(fingerprints(docs, shingle), "fingerprints")
    distinct = common.stored(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comps = common.stored(distinct.join(link(distinct.select("fp"), limit), "fp"), "components")
    names = comps.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_fp = comps.join(names, "comp").select("fp", "component_id")
    return made.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One document of each component: the one with the least doc_id; rows with no doc_id stay, as nothing names them."""
    found = report(docs.sparkSession, docs, shingle, limit).filter("component_id = doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    rest = docs.filter(F.col("doc_id").isNull())
    return docs.join(found, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi").unionByName(rest)
