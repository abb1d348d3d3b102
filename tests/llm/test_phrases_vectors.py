"""Ops 11 to 13 against brute force."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import helpers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from teleledger.llm import collocations, common, lz_fingerprint, whitening

ROWS = helpers.rows()


def order(rows):
    return sorted(map(tuple, rows), key=repr)


# Collocations

def _phrases(rows, least, longest=5, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    key = (lang, tuple(words[i:i + n]))
                    counts[key] = counts.get(key, 0) + 1
    often = {k: f for k, f in counts.items() if f >= least}
    out = {}
    for (lang, words), a in often.items():
        if len(words) < 2:
            continue
        inside = lambda o: any(o[i:i + len(words)] == words for i in range(len(o) - len(words) + 1))
        if any(x == lang and len(o) > len(words) and f >= a and inside(o) for (x, o), f in often.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return [(lang, rank, p.decode(), -a, left, right, total[lang], -s)
            for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
MORE = [(60, "New York, NEW  YORK new\tyork; new york city\nnew york city new york", "en"), (61, "a a a a a a. É é É é", ""),
        (62, "of the end of the end of the end of the end", "und"), (63, "language-a b c b c b c", "language-a"),
        (64, "language-a b c b c b c", "language-b"), (65, "x" * 5000 + " b c b c " + "y " * 300, "en")]


@pytest.mark.parametrize("options", [{}, {"mask": 0x3F}, {"block": 64}, {"bits": 1, "limit": 1 << 12}])
def test_collocations(spark, docs, options):
    rows = [(r[2], r[1]) for r in ROWS] + [(lang, t) for _, t, lang in MORE]
    all_docs = docs.unionByName(spark.createDataFrame(MORE, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = collocations.mine(spark, all_docs, least=4, **options)
    want = _phrases(rows, 4)
    assert order(got.select(*COLUMNS).collect()) == order(want) and len(want) > 20
    common.release(spark)


def test_collocation_places_ties_and_empty(spark, none):
    rows = [(None, "p q p q r s", None), (7, "q p q", "und"), (3, "r s. r s", "und"), (3, "r s. r s", "und")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["phrase"]: r for r in collocations.mine(spark, df, least=3, top=2).collect()}
    assert sorted((r["rank"], p, r["first_doc_id"], r["first_word"]) for p, r in got.items()) == [(1, "p q", None, 0), (2, "r s", None, 4)]
    assert collocations.mine(spark, none).count() == 0
    assert collocations.mine(spark, df).count() == 0


def test_score_beyond_64_bits(spark):
    big = 3 * 10**12
    rows = [("en", 0, "", 10**13, 1, 1), ("en", 1, "a", big, 1, 1), ("en", 1, "b", big - 1, 1, 1), ("en", 2, "a b", big - 2, 1, 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long, doc_id long, word long")).first()
    assert got["score"] == 1000 * (big - 2) * 10**13 // (big * (big - 1))


def test_blocks_hold_all_words():
    texts = ["a b. c d e f. g", None or "", "one two three four five six seven", "h. " * 50, "z"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5), pa.int64()), "lang": ["en"] * 5, "text": texts})
    for limit in (1, 8, 40, 10_000):
        words = {}
        for b in collocations.blocks(iter([batch]), limit, collocations._ALL):
            for i, t in enumerate(b.texts(np.arange(len(b.starts)), 1).to_pylist() if len(b.starts) else []):
                words.setdefault(b.ids[b.doc[i]], []).append((int(b.place[i]), t))
        for doc, text in enumerate(texts):
            assert words.get(doc, []) == list(enumerate(re.findall(r"[^ .]+", text)))


# Lempel-Ziv fingerprints

def _parse(text):
    """The phrase set, a character at a time."""
    phrases, now = set(), ""
    for c in text:
        now += c
        if now not in phrases:
            phrases.add(now)
            now = ""
    return phrases | ({now} if now else set())


def test_parse_equals_plain_parse():
    for text in ["", "a", "aaaaaaa", "abababababab", helpers.prose(3, 400), helpers.prose(3, 400, "de"), "👍é漢" * 40, "x" * 5000]:
        whole = lz_fingerprint.Phrases()
        whole.parse(text, len(text))
        ends = whole.ends if whole.ends[-1] == len(text) else [*whole.ends, len(text)]
        assert {text[a:b] for a, b in zip(ends, ends[1:])} == _parse(text)


def test_likeness_estimates_jaccard():
    texts = [helpers.prose(i, 900) for i in range(6)] + [helpers.prose(1, 600) + helpers.prose(9, 300)]
    for a in texts:
        for b in texts:
            x, y = _parse(a), _parse(b)
            near = lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b))
            assert abs(near - len(x & y) / len(x | y)) < 4 * math.sqrt(0.25 / lz_fingerprint.BINS)


def _lz(rows):
    """All rows by plain parses; rows of one doc_id are given in the order of the operator."""
    prints, out = [lz_fingerprint.fingerprint(t or "") for _, t in rows], []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        changed = lz_fingerprint.fingerprint(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i].hex(), changed.hex(),
                    lz_fingerprint.likeness(prints[i], changed), lz_fingerprint.likeness(prints[i], prints[(i + 1) % len(rows)])))
    return out


def test_lz_report(spark, docs, none):
    low = -(2**63)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(keyed, key=lambda r: (low if r["doc_id"] is None else r["doc_id"], r["tie"]))]
    got = lz_fingerprint.report(spark, docs).collect()
    assert order(got) == order(_lz(rows))
    assert lz_fingerprint.report(spark, none).count() == 0
    one = spark.createDataFrame([(5, "alone in here")], "doc_id long, text string")
    assert order(lz_fingerprint.report(spark, one).collect()) == order(_lz([(5, "alone in here")]))
    same = spark.createDataFrame([(5, "again")] * 7, "doc_id long, text string")
    assert {r["near_next"] for r in lz_fingerprint.report(spark, same).collect()} == {1.0}
    common.release(spark)


def test_lz_tells_edits_from_strangers():
    texts = [helpers.prose(100 + i, 60 + 40 * i) for i in range(30)]
    for a, b in zip(texts, texts[1:]):
        edited = lz_fingerprint.Document(1, a).row(lz_fingerprint.Document(2, b))
        assert edited[5] > edited[6]


# Whitening

@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_components(size):
    random = np.random.default_rng(size)
    a = random.standard_normal((3 * size, size))
    cases = [a.T @ a, np.eye(size), np.diag(np.arange(size, dtype=float)), np.zeros((size, size)) + 2]
    if size > 6:
        q, _ = np.linalg.qr(random.standard_normal((size, size)))
        cases.append(q @ np.diag([5.0, 5.0, 5.0 + 1e-12, 5.0, *[1e-9] * (size - 4)]) @ q.T)
    for matrix in cases:
        k = min(4, size)
        values, vectors = whitening.components(matrix, k)
        top = np.linalg.eigvalsh(matrix)[::-1][:k]
        scale = max(1.0, np.abs(matrix).max()) * size
        assert np.allclose(values, top, atol=1e-13 * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * scale)


def _clean(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def test_whitening(spark):
    random = np.random.default_rng(1)
    base = [(i, random.normal(0, [0.3, 0.2, 0.1, 0.05, 0.02], 5).tolist()) for i in range(60)]
    rows = [*base, *[(100 + i, base[3][1]) for i in range(40)], (None, base[4][1]), (7, base[5][1]), (200, None), (201, [None] * 5),
            (202, [float("nan")] + [0.0] * 4), (203, [float("inf")] + [0.0] * 4), (204, [0.5, -0.25]), (205, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, whitened string").repartition(3)
    good = _clean(rows)
    whole = [[math.floor(256 * c) for c in v] + [0] * (5 - len(v)) for _, v in good]
    fit = [list(x) for x in {tuple(x) for x in whole}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array([[float(c - Fraction(s, n)) for c, s in zip(v, sums)] for v in fit])
    matrix = x.T @ x / n
    values, vectors = np.linalg.eigh(matrix)
    got = whitening.report(spark, df).collect()
    assert len(got) == 4 * len(good)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] / (values[-r["component"]] / np.trace(matrix)) - 1) < 1e-9
    signs = {}
    for (doc, _), v in zip(good, whole):
        off = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for k in range(1, 5):
            y = sum(float(c - Fraction(s, n)) * e for c, s, e in zip(v, sums, vectors[:, -k])) / math.sqrt(values[-k])
            z = by[doc, off][k]["whitened"]
            if abs(y) > 1e-6:
                assert signs.setdefault(k, y * z > 0) == (y * z > 0)
            assert abs(abs(y) - abs(z)) < 1e-8
    common.release(spark)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])]])
def test_whitening_without_variance(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.report(spark, df).count() == 0


def test_whitening_of_rank_one_and_large_entries(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.report(spark, df).collect()} == {1}
    big = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e7, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.report(spark, big).collect()}
    assert got == {1: None, 2: None, 3: None}


def test_exact_deviations():
    x = np.array([[3, -2], [2**40, 5]], dtype=np.int64)
    assert whitening.deviations(x[:1], 2, (1, 1)) == [(6 - 1) ** 2 + (-4 - 1) ** 2]
    assert whitening.deviations(x, 2, (1, 1))[0] == 50 and whitening.deviations(x, 2, (1, 1))[1] is None
    assert whitening.deviations(np.array([[2**30, 1]]), 2, (2**31 - 5, 0)) == [25 + 4]
