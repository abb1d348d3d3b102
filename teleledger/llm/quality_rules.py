"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose measure exceeds a cutoff. Cutoffs are chosen per stratum (``lang``; null is a stratum of
its own) from a fixed grid: labelled good documents are the holdout, and a cutoff is admitted if the exact binomial tail
rejects, at level ``DELTA`` divided by the number of all tests, that it wrongly rejects more than ``ALPHA`` of the good
documents. The strictest admitted cutoff holds; a stratum with too few labels has none, and its documents stay. So with
probability ``1 - DELTA`` no rule of any stratum rejects more than ``ALPHA`` of its good documents.

Null text has no words. A doc_id with several labels is good only if all are; labels without a quality are left out; equal
rows count as often as they come. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.llm import common

ALPHA, DELTA = 0.01, 0.05
_SPACE = r"[\x20\x09-\x0D]+"

#: Measure and the cutoffs that are tested for it.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeat_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "mean_word_chars": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0],
    "upper_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],
    "marks_per_word": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count_of(text: Column, signs: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the rules' measures of each row."""
    text = F.coalesce("text", F.lit(""))
    parts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"),
                        F.array_remove(F.split(text, _SPACE), "").alias("words"),
                        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    counted = parts.select(
        "doc_id", "stratum", n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        _count_of(F.col("text"), "#*$%&|<>").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _count_of(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), _count_of(F.col("text"), "!?").alias("n_marks"),
        hashes.alias("hashes"))
    # Sorted only where some window occurs again.
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    marked = counted.withColumn("marked", F.when(again, F.sort_array(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    places = F.sort_array(F.transform(F.filter("marked", lambda x, i: (
        (i > 0) & (F.get("marked", i - 1)["h"] == x["h"])) | F.coalesce(F.get("marked", i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["at"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    full = marked.withColumn("n_repeat_words", F.coalesce(F.when(F.col("marked").isNotNull(), covered), F.lit(0).cast("long")))
    return full.select(
        "doc_id", "stratum", *BASE, (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_share"), (F.col("n_marks") / words).alias("marks_per_word"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Probability of at most ``k`` of ``n`` at rate ``p``, exact up to rounding: terms are added as logarithms."""
    start = n * F.lit(math.log1p(-p))
    odds = math.log(p) - math.log1p(-p)
    total = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(start.alias("term"), start.alias("sum")),
        lambda a, i: _added(a, a["term"] + F.log((n - i + 1) / i) + F.lit(odds)), lambda a: a["sum"])
    return F.exp(total)


def _added(a: Column, term: Column) -> Column:
    return F.struct(term.alias("term"), (F.greatest(a["sum"], term) + F.log1p(F.exp(-F.abs(a["sum"] - term)))).alias("sum"))


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row per stratum with labels: for each rule the strictest admitted cutoff, or null."""
    good = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id"))
    held = measured.join(good, "doc_id", "left_semi")
    wrong = {(r, i): F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r, grid in RULES.items() for i, c in enumerate(grid)}
    counts = common.stored(held.groupBy("stratum").agg(F.count("*").alias("n"), *wrong.values()), "holdout")
    tests = F.lit(float(len(wrong) * max(1, counts.count())))
    chosen = []
    for rule, grid in RULES.items():
        admitted = [F.when(F.col(f"{rule}_{i}") > F.col("n") * alpha, False).otherwise(
            binomial_tail(F.col("n"), F.col(f"{rule}_{i}"), alpha) <= delta / tests) for i in range(len(grid))]
        chosen.append(F.coalesce(*[F.when(ok, F.lit(c)) for ok, c in zip(admitted, grid)]).alias(f"cutoff_{rule}"))
    return common.stored(counts.select("stratum", *chosen), "cutoffs")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    measured = common.stored(measures(typed), "measures")
    cutoffs = thresholds(measured, labels, alpha, delta)
    passed = F.lit(True)
    for rule in RULES:
        passed = passed & F.coalesce(F.col(rule) <= F.col(f"cutoff_{rule}"), F.lit(True))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.join(cutoffs, "stratum", "left").select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & passed).alias("kept"))
