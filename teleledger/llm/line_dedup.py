"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept per connected group.

A line is normalised by lower-casing, replacing digits by ``0`` and every run of other signs by a space; lines without a word
stay. Lines with equal normal forms are one node. The fingerprint of a node has a block of 64 bits for every ``BLOCK_WORDS`` to
twice as many words: each word is dealt to a block by its hash, and a block is the SimHash of its distinct words. A changed word touches
two blocks at most, so by the pigeonhole principle nodes with few changes share a block. One of fewer than ``KEY_WORDS`` words
goes together with those after it; of lines below 16 words, three of ``FEW`` blocks must agree. Nodes that share a block are
verified: edit distance at most ``1 - SIMILARITY`` of the longer line. Nodes of fewer than ``MIN_WORDS`` words are only compared
exactly. Of each connected group the first occurrence is kept, by doc_id, a hash of the text, and place in the text.

Under a block all nodes are first compared with the least one; pairs that are connected by then are not compared again, so a
block with very many variants of one line does not give all pairs.

Null text has no lines and stays null; a null doc_id comes first. Rows that repeat doc_id and text are one document and get the
same result. Very long lines are compared whole. An empty table gives an empty one. Columns of the input named like an output are
replaced; all others pass, whatever their names, and a document keeps one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleledger.llm import common

MIN_WORDS, BLOCK_WORDS, KEY_WORDS, FEW = 5, 4, 5, 5
SIMILARITY = 0.8
#: Characters that a task works on at once; a longer text is one part.
PART = 1 << 19
_OUT = ("n_lines", "n_removed")
_LOWEST = -(2**63)
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 or c == 10 else 32 for c in range(256)).translate(
    bytes.maketrans(b"123456789", b"000000000"))
_ODD = np.uint64(0xD6E8FEB86659FD93)
_FOUND = "d long, t long, place int, h1 long, h2 long, line string, keys array<long>"


def _document() -> list[Column]:
    """d and t: what tells documents apart and orders them."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("d"), F.xxhash64("text").alias("t")]


def normal(text: str) -> bytes:
    """UTF-8 of the normalised text. Line breaks stay, and spaces are not yet joined."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


class Lines:
    """The judged lines of some texts, in order: where they lie, their hashes, and the keys under which they meet."""

    def __init__(self, texts: list[str]):
        data = b"\n".join(normal(x) for x in texts)
        self.raw = np.frombuffer(data, dtype=np.uint8)
        breaks = np.flatnonzero(self.raw == 10)
        per_text = np.array([x.count("\n") + 1 for x in texts], dtype=np.int64)
        first = np.cumsum(per_text) - per_text
        line_text = np.repeat(np.arange(len(texts)), per_text)
        word = (self.raw != 10) & (self.raw != 32)
        edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(breaks, self.starts)
        lines, self.first, self.words = np.unique(of, return_index=True, return_counts=True)
        self.text = line_text[lines]
        self.place = lines - first[self.text]
        self.hashes = common.fingerprints(self.raw.astype(np.uint64) + np.uint64(1), self.starts, self.ends)
        last = self.first + self.words
        self.h1 = common.fingerprints(self.hashes, self.first, last)
        self.h2 = common.fingerprints(self.hashes * _ODD ^ (self.hashes >> np.uint64(29)), self.first, last)

    def line(self, i: int) -> str:
        a, n = self.first[i], self.words[i]
        return b" ".join(self.raw[self.starts[a]:self.ends[a + n - 1]].tobytes().split()).decode("utf-8", "surrogatepass")

    def keys(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Keys of each of the chosen lines. Near the most words of a number of blocks, those of the next number too."""
        out: list[list[np.ndarray]] = [[] for _ in chosen]
        blocks = block_count(self.words[chosen])
        above = block_count(np.ceil(self.words[chosen] / SIMILARITY).astype(np.int64))
        for level, which in ((blocks, np.arange(len(chosen))), (above, np.flatnonzero(above > blocks))):
            which = which[self.words[chosen[which]] >= MIN_WORDS]
            for at, found in zip(which.tolist(), self._level(chosen[which], level[which])):
                out[at].append(found)
        return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]

    def _level(self, chosen: np.ndarray, blocks: np.ndarray) -> list[np.ndarray]:
        if not len(chosen):
            return []
        n = self.words[chosen]
        at = np.arange(n.sum()) + np.repeat(self.first[chosen] - np.cumsum(n) + n, n)
        hashes = self.hashes[at]
        base = np.cumsum(blocks) - blocks
        block = np.repeat(base, n) + (hashes >> np.uint64(33)).astype(np.int64) % np.repeat(blocks, n)
        # A word counts once, or the commonest word alone would be the SimHash of its block.
        each = np.argsort(block.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
        hashes, block = hashes[each], block[each]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (block[1:] != block[:-1])))
        hashes, block = hashes[new], block[new]
        # Bits of another hash than the one that deals the words.
        mixed = (hashes ^ (hashes >> np.uint64(31))) * _ODD
        size = np.bincount(block, minlength=int(blocks.sum()))
        found = np.flatnonzero(size)
        ones = _ones(mixed, np.cumsum(size[found]) - size[found])
        line = np.searchsorted(base, found, side="right") - 1
        long = np.flatnonzero(blocks[line] != FEW)
        present = np.bincount(line, minlength=len(chosen))
        start = np.cumsum(present) - present
        long_ones, long_size = ones[long].copy(), size[found[long]]
        for step in range(1, KEY_WORDS):
            todo = np.flatnonzero((long_size < KEY_WORDS) & (step < present[line[long]]))
            then = long[todo] - start[line[long[todo]]] + step
            then = start[line[long[todo]]] + then % present[line[long[todo]]]
            long_ones[todo] += ones[then]
            long_size[todo] += size[found[then]]
        part = found[long] - base[line[long]] + 65_537 * blocks[line[long]]
        keys, lines = [_hashed(long_ones, long_size, part)], [line[long]]
        few = np.flatnonzero(blocks[line] == FEW)
        short = np.flatnonzero(blocks == FEW)
        slot = (np.cumsum(blocks == FEW) - 1)[line[few]] * FEW + found[few] - base[line[few]]
        short_ones, short_size = np.zeros((len(short) * FEW, 64), dtype=np.int32), np.zeros(len(short) * FEW, dtype=np.int64)
        short_ones[slot], short_size[slot] = ones[few], size[found[few]]
        short_ones, short_size = short_ones.reshape(-1, FEW, 64), short_size.reshape(-1, FEW)
        for k, three in enumerate(combinations(range(FEW), 3)):
            total = short_size[:, three].sum(axis=1)
            enough = total >= KEY_WORDS - 1
            keys.append(_hashed(short_ones[enough][:, three].sum(axis=1), total[enough], np.full(int(enough.sum()), 1 + k)))
            lines.append(short[enough])
        all_keys, of = np.concatenate(keys), np.concatenate(lines)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(chosen) + 1))
        all_keys = all_keys[order]
        return [all_keys[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _ones(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set from one of ``starts`` to the next."""
    if np.diff(np.append(starts, len(hashes))).max() >= 1 << 16:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    # Four counts share a number, 16 bits each.
    lanes = (hashes[:, None] >> np.arange(16, dtype=np.uint64)) & np.uint64(0x0001000100010001)
    return np.add.reduceat(lanes, starts, axis=0).view(np.uint16).reshape(-1, 16, 4).transpose(0, 2, 1).reshape(-1, 64).astype(np.int32)


def _hashed(ones: np.ndarray, size: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Keys of which blocks, and their SimHash: the bits that over half of the words have."""
    prints = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64).ravel()
    keys = (prints ^ (part.astype(np.uint64) * _ODD)) * _ODD
    return keys ^ (keys >> np.uint64(32))


def block_count(words: np.ndarray) -> np.ndarray:
    """Blocks of a line: ``FEW`` below 16 words, then a power of two."""
    return np.where(words < 16, FEW, 1 << np.floor(np.log2(np.maximum(words / BLOCK_WORDS, 1))).astype(np.int64))


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether ``b`` can be made from ``a`` by ``most`` edits: bit vectors of a whole column of the table at a time."""
    if abs(len(a) - len(b)) > most:
        return False
    start, end = 0, min(len(a), len(b))
    step = 64
    while start < end:  # what they begin with, and then what they end with, needs no edits
        if a[start:start + step] == b[start:start + step] and start + step <= end:
            start += step
        elif step > 1:
            step //= 4
        else:
            break
    a, b, step = a[start:], b[start:], 64
    same, end = 0, min(len(a), len(b))
    while same < end:
        if same + step <= end and a[len(a) - same - step:len(a) - same] == b[len(b) - same - step:len(b) - same]:
            same += step
        elif step > 1:
            step //= 4
        else:
            break
    a, b = a[:len(a) - same], b[:len(b) - same]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) <= most
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    whole, top, up, down, score = (1 << len(b)) - 1, 1 << (len(b) - 1), (1 << len(b)) - 1, 0, len(b)
    left = len(a)
    for c in a:
        match = at.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, back = down | (whole & ~(diagonal | up)), up & diagonal
        left -= 1
        if right & top:
            score += 1
        elif back & top:
            score -= 1
        if score - left > most:
            return False
        right = (right << 1) | 1
        back <<= 1
        up, down = (back | (whole & ~(diagonal | right))) & whole, right & diagonal & whole
    return score <= most


def similar(a: str, b: str, similarity: float) -> bool:
    return distance_within(a, b, int(max(len(a), len(b)) * (1 - similarity) + 1e-9))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines, np.ndarray]]:
    """Parts of batches with their lines, and the first line of each normal form in the part."""
    for batch in batches:
        texts, a = batch.column("text").to_pylist(), 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) < PART:
                size += len(texts[b])
                b += 1
            found = Lines(texts[a:b])
            yield batch.slice(a, b - a), found, np.unique(found.h1, return_index=True)[1]
            a = b


def _shared_keys(texts: DataFrame) -> DataFrame:
    """Keys that two nodes or more have, each with its least node."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, first in _each(batches):
            each = found.keys(first)
            nodes = np.repeat(found.h1[first], [len(x) for x in each])
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64), pa.int64()),
                "node": pa.array(nodes.view(np.int64), pa.int64())})

    made = texts.select("text").mapInArrow(keys, "key long, node long")
    shared = made.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    return shared.select("key", "low")


def _found_lines(texts: DataFrame, filter_words) -> DataFrame:
    """Every judged line; the first of a normal form in a batch with its text and keys if it may share one of them."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = common.Filter(filter_words.value)
        for batch, found, first in _each(batches):
            each = found.keys(first)
            sizes = np.array([len(x) for x in each], dtype=np.int64)
            flat = np.concatenate([*each, np.zeros(0, np.uint64)])
            hit = shared.has(flat)
            owner = np.repeat(np.arange(len(first)), sizes)
            lines: list[str | None] = [None] * len(found.h1)
            keys: list[np.ndarray | None] = [None] * len(found.h1)
            flat, owner = flat[hit].view(np.int64), owner[hit]
            edges = np.searchsorted(owner, np.arange(len(first) + 1)).tolist()
            for at, a, b in zip(first.tolist(), edges[:-1], edges[1:]):
                if b > a:
                    lines[at], keys[at] = found.line(at), flat[a:b]
            rows = pa.array(found.text)
            yield pa.RecordBatch.from_pydict({
                "d": batch.column("d").take(rows), "t": batch.column("t").take(rows), "place": pa.array(found.place, pa.int32()),
                "h1": pa.array(found.h1.view(np.int64)), "h2": pa.array(found.h2.view(np.int64)),
                "line": pa.array(lines, pa.string()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return texts.mapInArrow(find, _FOUND)


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b whose lines are similar enough."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a, b, similarity) for a, b in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = (pairs.join(lines.withColumnsRenamed({"node": "a", "line": "line_a"}), "a")
            .join(lines.withColumnsRenamed({"node": "b", "line": "line_b"}), "b"))
    return both.mapInArrow(judge, "a long, b long")


def links(found: DataFrame, shared: DataFrame, similarity: float, scratch: common.Scratch) -> DataFrame:
    """node, root over all nodes that are linked to another, roots included."""
    asked = found.filter("keys is not null").select(
        F.col("h1").alias("node"), F.length("line").alias("chars"), F.explode("keys").alias("key")).distinct()
    members = scratch.stored(asked.join(shared, "key"), "line-members")  # node, chars, key, low
    lines = found.filter("line is not null").groupBy(F.col("h1").alias("node")).agg(F.min("line").alias("line"))
    pairs = members.filter("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    first = scratch.stored(_verified(pairs, lines, similarity), "line-links")
    roots = common.components(first, scratch)
    named = members.join(roots, "node", "left").select("key", "node", "chars", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    named = scratch.stored(named.join(mixed, "key"), "line-members")
    side = lambda x: named.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "chars", "root")])
    long = F.greatest("chars_a", "chars_b")
    rest = side("a").join(side("b"), "key").filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
        & (F.abs(F.col("chars_a") - F.col("chars_b")) <= long * F.lit(1 - similarity) + F.lit(1e-9)))
    rest = rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = scratch.stored(_verified(rest.join(pairs, ["a", "b"], "left_anti"), lines, similarity), "line-links")
    roots = common.components(first.union(more), scratch)
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _gone(found: DataFrame, roots: DataFrame) -> DataFrame:
    """d, t and the places of the lines that are not the first of their group."""
    here = F.struct("d", "t", "place")
    seen = found.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    # Only lines that occur again or have a group can go.
    grouped = seen.join(roots.withColumnRenamed("node", "h1"), "h1", "left").filter("n > 1 or root is not null").select(
        "h1", "h2", F.coalesce("root", "h1").alias("g1"), F.when(F.col("root").isNull(), F.col("h2")).otherwise(0).alias("g2"), "first")
    best = grouped.groupBy("g1", "g2").agg(F.min("first").alias("best"))
    kept = grouped.join(best, ["g1", "g2"]).select("h1", "h2", "best")
    gone = found.select("h1", "h2", here.alias("here")).join(kept, ["h1", "h2"]).filter("here != best")
    return gone.groupBy("here.d", "here.t").agg(F.collect_set("here.place").alias("places"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY, bits: int = common.FILTER_BITS,
          limit: int = common.FILTER_LIMIT) -> DataFrame:
    """``docs`` without the lines that are not the first of their group, with n_lines and n_removed."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.without(docs, *_OUT)
    texts = docs.filter(F.col("text").isNotNull()).select(*_document(), "text")
    with common.Scratch(spark) as scratch:
        shared = scratch.stored(_shared_keys(texts), "line-keys")
        words = spark.sparkContext.broadcast(common.filter_of(shared.select(F.col("key").alias("fp")), bits, limit).words)
        found = scratch.stored(_found_lines(texts, words), "lines")
        gone = scratch.keep(scratch.stored(_gone(found, links(found, shared, similarity, scratch)), "line-gone"))
        named = gone.select(F.xxhash64("d", "t").alias("fp"))
        touched = spark.sparkContext.broadcast(common.filter_of(named, bits, limit).words)

    @F.pandas_udf("boolean")
    def may_change(x):
        import pandas as pd

        return pd.Series(common.Filter(touched.value).has(x.to_numpy().view(np.uint64)))

    # Documents that lose nothing are not shuffled.
    d, t = _document()
    name = common.unused(docs, "document")
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name), d, t)
    marked = marked.withColumn("changes", F.col(f"{name}.text").isNotNull() & may_change(F.xxhash64("d", "t")))
    changed = marked.filter("changes").join(gone, ["d", "t"], "left").select(name, "places")
    same = marked.filter("not changes").select(name, F.lit(None).cast("array<int>").alias("places"))
    parts = F.split(F.col(f"{name}.text"), "\n")
    kept = F.when(F.col("places").isNull(), F.col(f"{name}.text")).otherwise(F.array_join(
        F.filter(parts, lambda x, i: ~F.array_contains("places", i)), "\n"))
    return changed.union(same).select(
        *[kept.alias(c) if c == "text" else F.col(name)[c].alias(c) for c in docs.columns],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"))
