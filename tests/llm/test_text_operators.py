"""Ops 5, 6, 8, 9 and 4 against brute force."""

import hashlib
import random
import re
from collections import Counter

import helpers
import xxhash
from pyspark.sql import functions as F

from teleledger.llm import common, decontaminate, language_id, line_dedup, simhash_dedup, substring_dedup

ROWS = helpers.rows()
DOCS = [(r[0], r[1]) for r in ROWS]
LOW = -(2**63)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (9, 9), (20, 10), (30, 20), (40, 30), (50, 40)] + [(100, 200 + i) for i in range(50)]
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {2: 1, 3: 1, 20: 10, 30: 10, 40: 10, 50: 10, **{200 + i: 100 for i in range(50)}}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _windows(items, n=13):
    out = {}
    for item, text in items:
        words = decontaminate.words(text)
        width = min(n, len(words))
        for k in range(len(words) - width + 1 if width else 0):
            out.setdefault(tuple(words[k:k + width]), set()).add("" if item is None else str(item))
    return out


def _contamination(items, docs):
    windows, want = _windows(items), []
    for doc, text in docs:
        words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        hit, found = set(), set()
        for width in {len(k) for k in windows}:
            for k in range(len(words) - width + 1):
                if ids := windows.get(tuple(words[k:k + width])):
                    hit.update(range(k, k + width))
                    found |= ids
        want.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                     len(hit) > 0 and 20 * len(hit) >= len(words)))
    return want


ITEMS = [(1, helpers.prose(2, 30)), (2, helpers.prose(6, 80, "de")), (10, "The  No!two"), (3, None), (4, ""), (None, "don't we'll"),
         (2, helpers.prose(1, 40)), (5, "x" * 50_000), (5, "x" * 50_000)]


def test_decontamination(spark, docs, none, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    want = order(_contamination(ITEMS, DOCS))
    assert order(decontaminate.report(spark, docs, items).collect()) == want
    assert any(x[-1] for x in want) and not all(x[-1] for x in want)
    # A benchmark of many blocks is scanned in as many passes.
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 1_000)
    assert order(decontaminate.report(spark, docs, items).collect()) == want
    assert decontaminate.report(spark, none, items).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.report(spark, docs, empty).collect())
    kept = decontaminate.remove_documents(docs, items)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(x[0] for x in want if not x[-1])


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Before it, one TWO three! After é"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert got == {1: "Before it, ! After é", 2: None}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash(spark, docs, none):
    fps = [_fingerprint(t) for _, t in DOCS]
    found = helpers.roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    names = {}
    for i, r in enumerate(found):
        if DOCS[i][0] is not None:
            names[r] = min(names.get(r, DOCS[i][0]), DOCS[i][0])
    want = sorted(((d, f"{f:016x}", names.get(r)) for (d, _), f, r in zip(DOCS, fps, found)), key=repr)
    assert sorted(map(tuple, simhash_dedup.report(spark, docs).collect()), key=repr) == want
    assert simhash_dedup.report(spark, none).count() == 0
    assert simhash_dedup.keep_first(docs).columns == docs.columns


def test_index_with_dense_and_chained_groups(spark):
    import random

    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(600)}
    center = r.getrandbits(64)
    fps |= {center ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for _ in range(900)}
    x = r.getrandbits(64)
    for _ in range(40):
        x ^= sum(1 << b for b in r.sample(range(64), 4))
        fps.add(x)
    fps = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    found = helpers.roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = dict(tuple(y) for y in simhash_dedup.link(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)).collect())
    want = {}
    for v, root in zip(signed, found):
        want.setdefault(root, set()).add(v)
    have = {}
    for v, comp in got.items():
        have.setdefault(comp, set()).add(v)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))


def _key(doc, text):
    return (LOW if doc is None else doc, text)


def test_substring_dedup(spark, docs, none):
    seen, want = {}, {}
    ordered = sorted({_key(d, t) for d, t in DOCS if t is not None})
    for doc, text in ordered:
        gone, here = set(), set()
        for h, i, n in substring_dedup.runs(text):
            if h in here or seen.get(h, (doc, text)) != (doc, text):
                gone.update(range(i, i + n))
            here.add(h)
            seen.setdefault(h, (doc, text))
        parts = substring_dedup.sentences(text)
        assert "".join(parts) == text
        want[doc, text] = ("".join(p for i, p in enumerate(parts) if i not in gone), len(gone))
    # Rows are told apart by their place, which the operator passes through.
    placed = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "row long, " + docs._jdf.schema().toDDL())
    got = {r.row: r for r in substring_dedup.remove_repeats(placed).collect()}
    assert len(got) == len(ROWS)
    for i, (doc, text) in enumerate(DOCS):
        if text is None:
            assert got[i].text is None and got[i].n_removed == 0
        else:
            assert (got[i].text, got[i].n_removed) == want[_key(doc, text)]
            assert got[i].n_removed == 0 or got[i].removed_spans
    assert sum(r.n_removed for r in got.values()) > 50
    assert substring_dedup.remove_repeats(none).count() == 0


def _distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def _normal(line):
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ")


def _spans(docs):
    """Every judged line of distinct documents, in order: document, place, normal form."""
    out = sorted({(_key(d, t), p, " ".join(_normal(x).split())) for d, t in docs if t for p, x in enumerate(t.split("\n"))})
    return [x for x in out if x[2]]


def _alike(a, b):
    """By the distance that test_line_distance holds against the plain one."""
    return len(a.split()) >= 5 <= len(b.split()) and line_dedup.similar(a, b, 0.8)


def _left(docs, roots):
    seen, gone = set(), {}
    for doc, place, line in _spans(docs):
        if roots[line] in seen:
            gone.setdefault(doc, set()).add(place)
        seen.add(roots[line])
    return gone


def test_line_dedup(spark, none):
    base = helpers.prose(70, 60).replace("\n", " ")
    longer = helpers.prose(71, 300).replace("\n", " ")
    texts = [(1, base + "\nShort one."), (2, base.upper() + "!\nShort one."), (3, base + " x\n\n" + longer), (4, longer + " y"), (5, None), (6, ""),
             (7, "a b c d e\n" * 30), (7, "a b c d e\n" * 30), (None, base[:-4] + "abcd"), (8, helpers.prose(72, 5)), (9, "w " * 40_000),
             (10, "-- !\n-- !"), (11, "w " * 40_001 + "\nÉTÉ 123\nété 456"), (12, "one two three four five six\r\none two three four five sixx"),
             (13, "x " * 70_000 + "end")]
    schema = "row long, doc_id long, text string, n_lines string, d string, t string, places string, document string, changes string, `a.b` string"
    docs = spark.createDataFrame([(i, d, t, *["clash"] * 7) for i, (d, t) in enumerate(texts)], schema)
    distinct = sorted({x for *_, x in _spans(texts)})
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if _alike(distinct[i][:2000], distinct[j][:2000])]
    gone = _left(texts, dict(zip(distinct, helpers.roots(len(distinct), links))))
    with common.reading(spark):
        got = {r.row: r for r in line_dedup.dedup(docs).collect()}
    assert line_dedup.dedup(docs).columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    for i, (doc, text) in enumerate(texts):
        off = gone.get(_key(doc, text), set())
        want = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in off)
        assert (got[i].text, got[i].n_removed, got[i].n_lines) == (want, len(off), 0 if text is None else text.count("\n") + 1), i
        assert {got[i][c] for c in ("d", "t", "places", "document", "changes", "a.b")} == {"clash"}
    assert sum(map(len, gone.values())) > 30
    assert line_dedup.dedup(none).count() == 0
    common.release(spark)


def test_line_dedup_recall(spark):
    """Lines within the edit similarity, found by comparing all pairs, end in one group in nine cases of ten at least; no others do."""
    r, made = random.Random(5), []
    for seed in range(60):
        words = helpers.prose(500 + seed, r.choice([6, 9, 14, 20, 45, 90, 150])).replace("\n", " ").split()
        made.append(" ".join(words))
        for _ in range(r.randint(0, 3)):
            now = list(words)
            for _ in range(r.randint(1, max(1, len(words) // 12))):
                at = r.randrange(len(now))
                if (how := r.randrange(3)) == 0:
                    now[at] = helpers.prose(r.randrange(10**6), 1)
                elif how == 1:
                    del now[at]
                else:
                    now.insert(at, helpers.prose(r.randrange(10**6), 1))
            made.append(" ".join(now))
    r.shuffle(made)
    docs = list(enumerate(made))
    spans = [x for *_, x in _spans(docs)]
    pairs = [(i, j) for i in range(len(spans)) for j in range(i) if _alike(spans[i], spans[j])]
    roots = helpers.roots(len(spans), pairs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    with common.reading(spark):
        got = {r.doc_id: r.n_removed for r in line_dedup.dedup(df).collect()}
    best = sum(1 for i, x in enumerate(roots) if x != i)
    found = sum(got.values())
    assert best > 50 and 0.9 * best <= found <= best
    assert all(roots.count(roots[i]) > 1 for i, n in got.items() if n)


def test_line_distance():
    r = random.Random(3)
    for _ in range(400):
        a = "".join(r.choice("abcé ") for _ in range(r.randint(0, 90)))
        b = list(a)
        for _ in range(r.randint(0, 12)):
            at = r.randint(0, len(b))
            b[at:at + r.randint(0, 2)] = r.choice(["", "x", "ab"])
        b = "".join(b)
        d = _distance(a, b)
        assert [line_dedup.distance_within(a, b, k) for k in (d - 1, d, d + 1) if k >= 0] == [k >= d for k in (d - 1, d, d + 1) if k >= 0]


def test_language(spark, docs, none):
    got = language_id.report(spark, docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in DOCS:
        for r in by[doc]:
            assert 0 <= r.score <= 1
            if not any(c.isalpha() for t in [x for d, x in DOCS if d == doc] for c in t or ""):
                assert r.lang_pred == "und"
    judged = {r[0]: r[2] for r in ROWS if r[0] is not None and r[0] >= 20}
    assert all(by[d][0].lang_pred == lang for d, lang in judged.items())
    assert language_id.report(spark, none).count() == 0
    assert {r.lang_pred for r in language_id.report(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_distance_is_out_of_place():
    texts = {"en": helpers.prose(1, 500), "de": helpers.prose(1, 500, "de")}
    profiles = {k: language_id.ranked(*language_id.grams(language_id.letters(t))) for k, t in texts.items()}
    judge = language_id.Profiles(profiles, language_id.SIZE)

    def grams(text):
        plain = language_id.letters(text)
        found = Counter(plain[i:i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))
        del found[" "]
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return sorted(found, key=lambda g: (-found[g], code(g)))[:300]

    own, best = grams(texts["de"][:300]), {}
    for lang, text in texts.items():
        place = {g: i for i, g in enumerate(grams(text))}
        best[lang] = sum(abs(i - place[g]) if g in place else 300 for i, g in enumerate(own))
    name, score = judge.nearest(texts["de"][:300])
    assert name == min(best, key=best.get) == "de" and abs(score - (1 - best["de"] / (300 * len(own)))) < 1e-12
