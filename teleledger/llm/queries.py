"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from teleledger.llm import (
    collocations, decontaminate, language_id, line_dedup, lz_fingerprint, packing, quality_rules, secret_scan, simhash_dedup,
    substring_dedup, token_files, url_filters, whitening,
)
from teleledger.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return url_filters.judge(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secret_scan.scan(spark, table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    return language_id.report(spark, table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that occurred before, exactly or nearly."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occurred before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-ID files, read back."""
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark."""
    return decontaminate.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of each document."""
    return simhash_dedup.report(spark, table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document, and whether it is kept."""
    return quality_rules.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return collocations.mine(spark, table(spark, sf_dir, "documents")).drop("first_doc_id", "first_word")


def op12_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text."""
    return lz_fingerprint.report(spark, table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding on the four leading components."""
    return whitening.report(spark, table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filters, op2_packing, op3_secret_scan, op4_language_id, op5_line_dedup, op6_substring_dedup,
        op7_token_files, op8_decontamination, op9_simhash_dedup, op10_quality_rules, op11_collocations, op12_lz_fingerprints,
        op13_embedding_whitening)
}

ORACLE_SQL: dict[str, str] = {"op8_decontamination": decontaminate.SQL, "op11_collocations": collocations.SQL}
