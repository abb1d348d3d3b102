"""Phrase collocation mining: Rabin-Karp fingerprints, counted in a shuffle, verified against text for frequent phrases only.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line breaks, and the pieces into words at spaces and tabs. All
counts are per language; null is ``und``, an empty string a language of its own. A phrase is two to five words of a piece.

Tasks see blocks of text. Prefix polynomials modulo 2**64 over the bytes give every word a fingerprint, prefix polynomials
over these every run of words. Three rounds count fingerprints: of words, of pairs of words that are frequent, and of longer
runs all of whose pairs are. No phrase is more frequent than a part of it, so none is lost. What is known to be frequent
travels as a filter of bounded size. It may let others through, more of them as data grows; they cost a shuffled row and
are dropped for their counts. Fingerprints that collide only add up to too much, so again nothing is lost.

The last pass takes the occurrences of frequent fingerprints, with a pointer (doc_id and word) to one of each in a block.
Every occurrence is compared with that one's bytes; those that differ are counted under their own text. Tasks send what they
found packed, a row for each share of the fingerprints, and shares are summed by text. So the counts in the end are of
texts, and a collision cannot change them. The least pointer of a phrase is where it occurs first.

Null texts are empty. Rows that repeat are counted as often as they occur. A null doc_id comes first among pointers.
An empty table gives no rows. A text of any length is read in blocks that end between pieces; only a piece without any of
those signs is held whole. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teleledger.llm import common

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that a task works on at once.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ALL = 2**64 - 1
_COUNTS = "fp long, f long"
_FOUND = "lang string, size int, phrase string, f long, doc_id long, word long"
_NO_DOC = -(2**63)
#: Rows that a task sums before it sends them on; shares for each partition; shares of a language that are ranked by themselves.
_HELD_ROWS, _SHARES, _RANKED = 1 << 18, 8, 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Block:
    """Whole pieces of some documents: the words, and where runs of words may lie."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: list[str], ids: list[int | None], first: int, mask: int):
        """``starts``: where in ``data`` each document starts. ``first``: the words that the first one had before."""
        self.data, self.langs, self.ids = _LOWER[data], langs, ids
        kind = _KIND[data]
        edge = np.diff(np.concatenate(([False], kind == 0, [False])).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(starts, self.starts, side="right") - 1
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        piece = breaks[self.starts]
        self.more = piece[1:] == piece[:-1]  # the next word lies in the same piece
        self.count = np.bincount(self.doc, minlength=len(langs))
        before = np.cumsum(self.count) - self.count
        self.place = np.arange(len(self.starts)) - before[self.doc]
        self.place[self.doc == 0] += first
        self.mask = mask
        self.raw = common.fingerprints(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, mask)
        number = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        self.lang = np.array([number[x] for x in langs])[self.doc]
        self.seed = np.array([xxhash.xxh64_intdigest(x) for x in number], dtype=np.uint64)[self.lang]

    def runs(self, size: int, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of ``size`` words from each of ``starts``, each language and size apart."""
        x = common.fingerprints(self.raw, starts, starts + size, self.mask) + self.seed[starts]
        return (x + np.uint64(size)) * _BASE & np.uint64(self.mask)

    def frequent(self, filters: list[common.Filter], size: int) -> list[np.ndarray]:
        """Starts of the runs of 1, 2 ... ``size`` words that may be frequent, going by the filters known so far."""
        out = [np.arange(len(self.starts))]
        if filters:
            out[0] = np.flatnonzero(filters[0].has(self.runs(1, out[0])))
        if size > 1:
            known = np.zeros(len(self.starts) + 1, dtype=bool)
            known[out[0]] = True
            pairs = np.flatnonzero(known[:-2] & known[1:-1] & self.more)
            if len(filters) > 1:
                pairs = pairs[filters[1].has(self.runs(2, pairs))]
            out.append(pairs)
        if size > 2:
            known = np.zeros(len(self.starts) + size, dtype=bool)
            known[out[1]] = True
            at = out[1]
            for n in range(3, size + 1):
                at = at[known[at + n - 2]]
                out.append(at)
        if len(filters) > 2:
            out[2:] = [at[filters[2].has(self.runs(n, at))] for n, at in enumerate(out[2:], 3)]
        return out

    def texts(self, at: np.ndarray, size: int) -> pa.Array:
        """The runs of ``size`` words from each of ``at``, their words joined by single spaces."""
        words = at[:, None] + np.arange(size)
        starts, sizes = self.starts[words], self.ends[words] - self.starts[words]
        sizes[:, :-1] += 1
        edges = np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))
        ends = np.cumsum(sizes)
        source = np.arange(ends[-1]) + np.repeat(starts.ravel() - ends + sizes.ravel(), sizes.ravel())
        out = self.data[source]
        out[ends.reshape(sizes.shape)[:, :-1].ravel() - 1] = 0x20
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` have the same bytes, eight bytes at a time."""
        size = self.ends[a] - self.starts[a]
        out = size == self.ends[b] - self.starts[b]
        padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        eight = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        todo, at = np.flatnonzero(out & (a != b)), 0
        while len(todo):
            left = np.minimum(size[todo] - at, 8).astype(np.uint64)
            keep = np.uint64(_ALL) >> (np.uint64(64) - left * np.uint64(8))
            differ = ((eight[self.starts[a[todo]] + at] ^ eight[self.starts[b[todo]] + at]) & keep) != 0
            out[todo[differ]] = False
            at += 8
            todo = todo[~differ & (size[todo] > at)]
        return out


def blocks(batches: Iterator[pa.RecordBatch], limit: int, mask: int) -> Iterator[Block]:
    """``doc_id, lang, text`` as blocks of about ``limit`` bytes, cut between pieces."""
    held: list[tuple[np.ndarray, str, int | None]] = []
    size = words = 0
    for batch in batches:
        texts = pc.cast(batch.column("text"), pa.large_binary())
        edges = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset:texts.offset + len(texts) + 1].tolist()
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        for i, (lang, doc) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist())):
            text = data[edges[i]:edges[i + 1]]
            while size + len(text) >= limit and len(text):
                room = max(limit - size, 1)
                cuts = _breaks(text, room)
                if cuts is None:
                    break
                held.append((text[:cuts], lang, doc))
                block = _block(held, words, mask)
                yield block
                words = int(block.count[-1]) + (words if len(held) == 1 else 0)
                text, held, size = text[cuts:], [], 0
                if not len(text):
                    words = 0
            if len(text) or not held:
                held.append((text, lang, doc))
                size += len(text) + 1
            if size >= limit:
                yield _block(held, words, mask)
                held, size, words = [], 0, 0
    if held:
        yield _block(held, words, mask)


def _breaks(text: np.ndarray, room: int) -> int | None:
    """The place after the last break between pieces within ``room`` bytes, or else the first one after; None without any."""
    near = np.flatnonzero(_KIND[text[:room]] == 2)
    if len(near):
        return int(near[-1]) + 1
    for at in range(room, len(text), BLOCK):
        far = np.flatnonzero(_KIND[text[at:at + BLOCK]] == 2)
        if len(far):
            return at + int(far[0]) + 1
    return None


def _block(held: list[tuple[np.ndarray, str, int | None]], words: int, mask: int) -> Block:
    end = np.array([0x0A], dtype=np.uint8)
    starts = np.cumsum([0, *[len(x) + 1 for x, _, _ in held[:-1]]])
    return Block(np.concatenate([y for x, _, _ in held for y in (x, end)]), starts, [x for _, x, _ in held], [x for _, _, x in held],
                 words, mask)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _counted(texts: DataFrame, least: int, block: int, mask: int, pick: Callable[[Block], np.ndarray]) -> DataFrame:
    """Fingerprints that ``pick`` finds at least so often."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, block, mask):
            found, f = np.unique(pick(b), return_counts=True)
            for i in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_pydict({
                    "fp": pa.array(found[i:i + (1 << 16)].view(np.int64), pa.int64()),
                    "f": pa.array(f[i:i + (1 << 16)], pa.int64())})

    return texts.mapInArrow(count, _COUNTS).groupBy("fp").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("fp")


def _phrases(b: Block, filters: list[common.Filter], longest: int) -> Iterator[pa.Table]:
    """The phrases of a block that may be frequent, with verified counts. An empty phrase has the words of a language."""
    for size, at in enumerate(b.frequent(filters, longest), 1):
        if not len(at):
            continue
        keys = b.runs(size, at)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        lead = at[first][group]
        same = b.lang[at] == b.lang[lead]
        for k in range(size):
            same[same] = b.same(at[same] + k, lead[same] + k)
        odd = np.flatnonzero(~same)
        f = np.concatenate((np.bincount(group[same], minlength=len(first)), np.ones(len(odd), dtype=np.int64)))
        shown = np.concatenate((first, odd))
        yield _table(b, keys[shown], size, b.texts(at[shown], size), f, b.doc[at[shown]], b.place[at[shown]])
    nothing = pa.array([""] * len(b.langs), pa.string())
    seeds = np.array([xxhash.xxh64_intdigest(x) for x in b.langs], dtype=np.uint64)
    yield _table(b, seeds, 0, nothing, b.count, np.arange(len(b.langs)), np.zeros(len(b.langs), dtype=np.int64))


def _table(b: Block, keys, size: int, phrases: pa.Array, f, doc, place) -> pa.Table:
    ids = pa.array([_NO_DOC if x is None else x for x in b.ids], pa.int64())
    return pa.table({
        "lang": pa.array(b.langs, pa.string()).take(pa.array(doc)), "size": pa.array(np.full(len(f), size), pa.int32()), "phrase": phrases,
        "fp": pa.array(keys, pa.uint64()), "f": pa.array(f, pa.int64()), "doc_id": ids.take(pa.array(doc)), "word": pa.array(place, pa.int64())})


def _summed(tables: list[pa.Table]) -> pa.Table:
    """One row for each text, with the least pointer."""
    whole = pa.concat_tables(tables).sort_by([("doc_id", "ascending"), ("word", "ascending")])
    out = whole.group_by(["lang", "size", "phrase", "fp"], use_threads=False).aggregate([("f", "sum"), ("doc_id", "first"), ("word", "first")])
    del whole
    pa.default_memory_pool().release_unused()
    return out.rename_columns(["lang", "size", "phrase", "fp", "f", "doc_id", "word"])


def frequent_phrases(docs: DataFrame, scratch: common.Scratch, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK,
                     bits: int = common.FILTER_BITS, limit: int = common.FILTER_LIMIT, mask: int = _ALL) -> DataFrame:
    """lang, size, phrase, f and the least doc_id and word of every run of up to ``longest`` words that occurs ``least`` times; size 0: all words."""
    common.small_batches(docs.sparkSession)
    texts = _texts(docs)
    context = docs.sparkSession.sparkContext
    held: list = []

    def known() -> list[common.Filter]:
        return [common.Filter(x.value) for x in held]

    picks = [lambda b: b.runs(1, np.arange(len(b.starts))),
             lambda b: b.runs(2, b.frequent(known(), 2)[1]),
             lambda b: np.concatenate([b.runs(n, at) for n, at in enumerate(b.frequent(known(), longest)[2:], 3)] or [np.zeros(0, np.uint64)])]
    for pick in picks:
        found = scratch.stored(_counted(texts, least, block, mask, pick), "frequent")
        held.append(context.broadcast(common.filter_of(found, bits, limit).words))
        scratch.drop(found)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_tables: list[pa.Table] = []
        for b in blocks(batches, block, mask):
            held_tables += _phrases(b, known(), longest)
            if sum(len(x) for x in held_tables) > _HELD_ROWS:
                held_tables = [_summed(held_tables)]
                if len(held_tables[0]) > _HELD_ROWS * 3 // 4:
                    yield _packed(held_tables, shares)
                    held_tables = []
        if held_tables:
            yield _packed(held_tables, shares)

    def total(group: pa.Table) -> pa.Table:
        whole = _summed([pa.ipc.open_stream(x.as_buffer()).read_all() for x in group["rows"]])
        return whole.filter((pc.field("f") >= least) | (pc.field("size") == 0)).drop(["fp"])

    shares = _SHARES * common.partitions(docs.sparkSession)
    found = texts.mapInArrow(phrases, "share int, rows binary").groupBy("share").applyInArrow(total, _FOUND)
    return found.withColumn("doc_id", F.when(F.col("doc_id") > _NO_DOC, F.col("doc_id")))


def _packed(tables: list[pa.Table], shares: int) -> pa.RecordBatch:
    """A row for each share of the fingerprints, so that few rows are shuffled."""
    whole = _summed(tables)
    share = (whole["fp"].to_numpy() % np.uint64(shares)).astype(np.int32)
    order = np.argsort(share, kind="stable")
    whole, share = whole.take(pa.array(order)).combine_chunks(), share[order]
    found, first = np.unique(share, return_index=True)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(share)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema) as stream:
            stream.write_table(whole.slice(a, b - a))
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_pydict({"share": pa.array(found, pa.int32()), "rows": pa.array(out, pa.binary())})


def _joined(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, share, phrase, a, l, r, n, score and pointer of every phrase that no longer one covers."""
    exact = "decimal(38,0)"
    words = F.split("phrase", " ")
    several = frequent.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), "doc_id", "word")
    # Parts of every phrase; those that are as frequent as it are covered by it.
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _joined(words, i, n))))
    covered = several.filter("size > 2").select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer"))
    covered = covered.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = several.join(covered, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a").drop("longer")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", _joined(words, F.lit(1), F.col("k"))).withColumn("tail", _joined(words, F.col("k") + 1, F.col("size") - F.col("k")))
    of = frequent.filter("size > 0").select("lang", "phrase", "f")
    both = cuts.join(of.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    both = both.join(of.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # A language's total meets each share of its phrases, so that no task has a whole language.
    both = both.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(_RANKED)).cast("int"))
    total = frequent.filter("size = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(_RANKED - 1))).alias("share"))
    both = both.join(total, ["lang", "share"])
    both = both.select("*", F.expr(
        f"(cast(1000 * cast(a as {exact}) * n as {exact})) div (cast(l as {exact}) * r)").alias("score"))
    best = both.groupBy("lang", "share", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n", "doc_id", "word")).alias("best"))
    return best.select("lang", "share", "phrase", "best.*")


def mine(spark: SparkSession, docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The first ``top`` phrases of each language, with the least place where each occurs."""
    scratch = common.Scratch(spark)
    found = scratch.keep(scratch.stored(frequent_phrases(docs, scratch, **options), "phrases"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = scored(found)  # first the best of each share of a language are taken
    for keys in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                         F.col("doc_id").alias("first_doc_id"), F.col("word").alias("first_word"))


#: The rows of ``mine`` but for where a phrase occurs first.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM split GROUP BY lang),
runs AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, range(1, 6) AS s(size) WHERE len(w) >= size)),
freq AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE size > 1),
parts AS (
  SELECT c.lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM cand, range(2, 5) AS p(s) WHERE s < size) c GROUP BY ALL),
alone AS (
  SELECT c.* FROM cand c LEFT JOIN parts p ON p.lang = c.lang AND p.phrase = c.phrase WHERE p.longer IS NULL OR 100 * p.longer < 100 * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM alone) c
  JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""
