"""Packing: order-preserving dynamic programming over document and sentence boundaries.

The ids of all documents, each followed by the end id, form one long line in doc_id order. It is cut into windows of at
most ``size`` ids. A cut may fall at the end of a document (free), at the end of a sentence (``SENTENCE_COST``), or, in a
sentence of more than ``HARD_STEP`` ids, at every ``HARD_STEP``-th of its ids (``HARD_COST``). The cuts chosen make the sum
of padding and costs least; the best predecessor within ``size`` ids comes from a queue kept in monotone order, and the
window lengths that need no padding are looked up besides.

Each partition of the line is packed on its own, in blocks of ``BLOCK`` ids; the last window of a block is opened again
with the next one, so only the last window of a partition may lack documents to fill it. Sequence numbers start at a
prefix sum of the partitions' counts.

A null text is empty, so its document is the end id alone; rows of one doc_id are packed one after the other, in the order
of a hash of their text, and equal rows are packed as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teleledger.llm import common, token_files, tokens

SIZE = 2048
#: Costs in ids of padding.
SENTENCE_COST, HARD_COST, WINDOW_COST = 8, 64, 8
HARD_STEP = 256
#: Ids that are laid out at a time.
BLOCK = 1_000_000
#: Bytes of text to encode at once where workers hold other stages' memory too. ``tokens.TOGETHER`` takes 70 MB more, and less time.
TOGETHER = 1 << 20
_ENDS = frozenset((b".", b"!", b"?"))
_PIECES = ("part int, local long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long")


def unpadded(size: int) -> tuple[int, ...]:
    """Window lengths below ``size`` worth having as they are: the powers of two down to an eighth of it."""
    powers = [1 << k for k in range(1, size.bit_length()) if size // 8 <= 1 << k < size]
    return tuple(reversed(powers))


def cut(position: list[int], cost: list[int], size: int = SIZE) -> list[int]:
    """Indexes of the chosen boundaries, the first and the last included; neighbours are at most ``size`` apart."""
    at = np.array(position, dtype=np.int64)
    exact = []
    for length in unpadded(size):
        found = np.searchsorted(at, at - length)
        exact.append(np.where(at[found] == at - length, found, -1).tolist())
    n = len(position)
    best, key, back = [0] * n, [0] * n, [0] * n
    key[0] = position[0]
    queue = deque([0])
    for j in range(1, n):
        p = position[j]
        while position[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        least = key[i] - p + size
        for same in exact:
            k = same[j]
            if k >= 0 and best[k] < least:
                i, least = k, best[k]
        best[j] = least = least + cost[j] + WINDOW_COST
        back[j] = i
        key[j] = least = least + p
        while queue and key[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def boundaries(stops: np.ndarray, total: int) -> tuple[list[int], list[int]]:
    """Places after which a document of ``total`` ids may be cut, and their costs. stops: where its sentences end."""
    stops = np.append(stops[stops < total], total)
    stops = stops[np.diff(stops, prepend=-1) > 0]
    gaps = np.diff(stops, prepend=0)
    if gaps.max() <= HARD_STEP:
        return stops.tolist(), [SENTENCE_COST] * (len(stops) - 1) + [0]
    where, cost, last = [], [], 0
    for stop in stops.tolist():
        inner = range(last + HARD_STEP, stop, HARD_STEP)
        where += [*inner, stop]
        cost += [HARD_COST] * len(inner) + [SENTENCE_COST]
        last = stop
    cost[-1] = 0
    return where, cost


class _Line:
    """Documents not yet packed, and the windows made of them."""

    def __init__(self, size: int):
        self.size, self.made = size, 0
        self.docs: list[list] = []  # doc_id, ids as bytes, all its ids, where it starts in itself
        self.position, self.cost = [0], [0]

    def add(self, doc, data: bytes, where: list[int], cost: list[int]) -> None:
        base = self.position[-1]
        self.position += [base + x for x in where]
        self.cost += cost
        self.docs.append([doc, data, len(data) // 4, 0])

    def windows(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows cut so far; all but the last window, which stays open unless ``last``."""
        if len(self.position) < 2:
            return
        chosen = cut(self.position, self.cost, self.size)
        if not last:
            chosen.pop()
        d, kept = 0, self.position[chosen[-1]]
        for a, b in zip(chosen, chosen[1:]):
            room, offset = self.position[b] - self.position[a], 0
            while offset < room:
                doc, data, total, begun = self.docs[d]
                take = min(room - offset, total - begun)
                yield (self.made, doc, begun, take, zlib.crc32(data[4 * begun:4 * (begun + take)]), total, offset)
                offset += take
                self.docs[d][3] = begun + take
                if begun + take == total:
                    d += 1
            self.made += 1
        del self.docs[:d]
        first = chosen[-1]
        self.position = [x - kept for x in self.position[first:]]
        self.cost = self.cost[first:]


def _batches(part: int, pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows = list(pieces)
    if not rows:
        return
    local, doc, start, length, crc, total, offset = zip(*rows)
    long = pa.int64()
    yield pa.RecordBatch.from_pydict({
        "part": pa.array([part] * len(rows), pa.int32()), "local": pa.array(local, long), "doc_id": pa.array(doc, long),
        "start": pa.array(start, long), "length": pa.array(length, long), "ids_crc32": pa.array(crc, long),
        "doc_tokens": pa.array(total, long), "offset": pa.array(offset, long)})


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE,
         together: int = tokens.TOGETHER, remember: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``remember``: the workers keep
    the words they have met for the tasks that follow, which takes less time and more memory."""
    common.small_batches(spark)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        part, line = TaskContext.get().partitionId(), _Line(size)
        with tokens.borrowed(tokenizer, "word", remember) as encoder:
            for batch, ended in tokens.together(batches, together):
                words, number, edges, found = encoder.words(batch.column("text"))
                flat, sizes = tokens.gathered(found, number)
                at = np.append(0, np.cumsum(sizes))
                stops = np.flatnonzero(np.array([w[-1:] in _ENDS for w in words], dtype=bool)[number])
                edge, mark = at[edges].tolist(), np.searchsorted(stops, edges).tolist()
                stops, data, docs_here = at[stops + 1], flat.tobytes(), batch.column("doc_id").to_pylist()
                for first, last in zip([0, *ended], ended):
                    for i in range(first, last):
                        own = data[4 * edge[i]:4 * edge[i + 1]] + end
                        line.add(docs_here[i], own, *boundaries(stops[mark[i]:mark[i + 1]] - edge[i], len(own) // 4))
                    if line.position[-1] > BLOCK:
                        yield from _batches(part, line.windows(last=False))
        yield from _batches(part, line.windows(last=True))

    pieces = common.stored(token_files.in_doc_order(docs).mapInArrow(packed, _PIECES), "pieces")
    counts = pieces.groupBy("part").agg((F.max("local") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    return pieces.join(F.broadcast(bases), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset")
