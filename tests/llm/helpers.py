"""Small documents with everything that may go wrong, and plain versions to hold the operators against."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use themselves.
    *[T.StructField(n, T.StringType()) for n in (
        "hits", "n_words", "item_ids", "score", "lang_pred", "n_lines", "n_removed", "n_sentences", "removed_spans", "fp", "d", "place")]])
_SYLLABLES = {"en": ["the", "er", "ing", "and", "wh", "tion", "st"], "de": ["sch", "ein", "ung", "ch", "der", "ß", "ö"]}


def prose(seed: int, words: int, lang: str = "en") -> str:
    r = random.Random(seed)
    made = ["".join(r.choice(_SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(words)]
    return " ".join(w + ("." if i % 9 == 8 else "\n" if i % 23 == 22 else "") for i, w in enumerate(made))


def rows() -> list[tuple]:
    long_text = prose(1, 6_000)
    texts = [
        (0, prose(2, 120), "en"), (1, prose(3, 120, "de"), "de"), (2, prose(2, 120), "en"), (3, prose(2, 120) + " extra", "en"),
        (4, None, "en"), (5, "", None), (6, "   \n\t ", "de"), (7, "12 34 !!", None), (8, long_text, "en"), (9, long_text[:20_000], "en"),
        (10, "x" * 50_000, None), (None, prose(5, 60), "en"), (None, None, None), (11, prose(6, 80, "de"), "de"), (11, prose(6, 80, "de"), "de"),
        (12, "İß 漢字 é\u0301 👍 ﬁn don't we'll <|endoftext|>. Yes!\r\nNo  two  spaces\u00a0here", "en"),
        (13, prose(7, 70) + "\n" + prose(2, 120), "en"), (14, "a b c " * 400, "en"), (-5, prose(8, 90, "de"), "de"),
        *[(20 + i, prose(40 + i, 60, "de" if i % 3 else "en"), "de" if i % 3 else "en") for i in range(30)]]
    return [(d, t, lang, "s", len(t or ""), *["clash"] * 12) for d, t, lang in texts]


def roots(n: int, pairs) -> list[int]:
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
