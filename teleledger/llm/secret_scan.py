"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Patterns give the base spans. Besides, every run of at least ``LEAST`` characters of ``ALPHABET`` that has a letter and a digit
is a candidate. Two first-order Markov models, one of random strings and one of ordinary identifiers, score it: the mean
log-likelihood ratio of its character pairs. Candidates above ``THRESHOLD`` that meet no base span are spans of kind ``random``.

The models learn from labelled samples: the strings that patterns found in the corpus are random, and words of at least
``WORD_LEAST`` characters in a sample of about ``SAMPLE`` documents (by a hash of the text) that could be no candidates themselves
are identifiers.
A null text is empty. Equal rows get equal results, without any document there are none. Only DataFrame functions are used.

Places are found by matching the gap before a match together with it, each match starting where the last one ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.llm import common

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST, WORD_LEAST = 20, 8
THRESHOLD = 0.75
#: Pairs that the frequency of the second character alone stands for.
BACKOFF = 20.0
SAMPLE = 4_000
_RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"


def _spans(text: Column, kind: int, pattern: str, value: bool = False, least: int = 0) -> Column:
    """start, kind, end and text of each match; with ``value`` the text is the pattern's own group, of ``least`` characters."""
    whole = r"\G([\s\S]*?)(" + pattern + ")"
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(whole), 1).alias("gap"), F.regexp_extract_all(text, F.lit(whole), 2).alias("hit"),
        F.regexp_extract_all(text, F.lit(whole), 3 if value else 2).alias("value"))
    empty = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("end"), x["value"].alias("text"))
        return F.struct(end.cast("bigint").alias("at"), F.when(
            F.length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(found, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), step, lambda a: a["spans"])


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the patterns), runs (candidates for the models) of each row."""
    text, empty = F.col("text"), F.array().cast(_SPAN)
    kinds = [
        F.when(text.rlike(_ASSIGN_HEAD), _spans(text, 0, _ASSIGN, value=True, least=6)).otherwise(empty),
        F.when(text.contains("AKIA"), _spans(text, 1, _ACCESS)).otherwise(empty),
        F.when(text.rlike(_HEX), _spans(text, 2, _HEX)).otherwise(empty)]
    runs = F.when(text.rlike(_RUN), F.filter(
        _spans(text, 3, _RUN), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"))).otherwise(empty)
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return plain.select("doc_id", F.concat(*kinds).alias("base"), runs.alias("runs"))


def _pairs(strings: DataFrame) -> DataFrame:
    """How often each pair of the alphabet's characters follows each other in ``s``."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i")
    pair = strings.filter(F.length("s") > 1).select("s", at).select(F.substring("s", F.col("i"), F.lit(2)).alias("pair"))
    return pair.filter(pair.pair.rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("pair").agg(F.count("*").alias("n"))


def learn(spans: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio, random to ordinary, of each character given the one before it; rows of the alphabet in order."""
    random = spans.select(F.explode("base").alias("x")).select(F.regexp_replace("x.text", r"[^A-Za-z0-9+/_=-]+", "").alias("s"))
    some = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1).cast("long"), F.lit(max(1, docs.count() // sample)))) == 0
    words = docs.filter(some).select(F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-z_][A-Za-z0-9_-]{{{WORD_LEAST - 1},}}"), 0)).alias("s"))
    words = words.filter((F.length("s") < LEAST) | ~F.col("s").rlike("[0-9]"))
    # At most the square of the alphabet in rows.
    counts = [{r.pair: r.n for r in _pairs(x).collect()} for x in (random, words)]
    tables = [_model(c) for c in counts]
    return [math.log(x / y) for x, y in zip(*tables)]


def _model(counts: dict[str, int]) -> list[float]:
    """Probability of each character after each; rare pairs lean on how common the second is, and that on all being alike."""
    alone = {b: 1 + sum(counts.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
    total, out = sum(alone.values()), []
    for a in ALPHABET:
        seen = sum(counts.get(a + b, 0) for b in ALPHABET)
        out += [(counts.get(a + b, 0) + BACKOFF * alone[b] / total) / (seen + BACKOFF) for b in ALPHABET]
    return out


def score(string: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of a string over the alphabet."""
    table, size = F.lit(ratios), len(ALPHABET)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(string, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(string) - 1), F.lit(0.0),
                        lambda acc, i: acc + F.get(table, (place(i) - 1) * size + place(i + 1) - 1))
    return total / (F.length(string) - 1)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = common.stored(base_spans(docs), "secrets")
    ratios = learn(found, docs)
    clear = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    judged = found.withColumn("runs", clear).withColumn("random", F.filter("runs", lambda r: score(r["text"], ratios) > threshold))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return judged.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "random")).alias("spans"))
