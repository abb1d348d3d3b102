"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.llm import common, decontaminate, language_id, line_dedup, packing, simhash_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages: rejected are ``und`` and scores below ``language_id.MIN_SCORE``."""
    common.small_batches(spark)
    judged = language_id.predict(docs, language_id.learn(docs.filter(~language_id.held_out())))
    good = (F.col("lang_pred") != "und") & (F.col("score") >= language_id.MIN_SCORE)
    return judged.filter(good).select(*[f"`{c}`" for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, exact or nearly so; n_chars follows the text."""
    cut = line_dedup.dedup(docs)
    chars = F.length("text").cast("long")
    return cut.select(*[(F.when(F.col("n_removed") > 0, chars).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`"))
                        for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return simhash_dedup.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain the benchmark."""
    return decontaminate.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), together=packing.TOGETHER, remember=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark), ("packing", packed)]

#: Language profiles and packing have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the next one's documents."""
    docs = common.table(spark, sf_dir, "documents")
    with common.Scratch(spark) as scratch:
        for name, stage in STAGES:
            before = docs
            with common.reading(spark):
                docs = scratch.stored(stage(spark, before, sf_dir), name.replace(" ", "-"))
            if stage is not STAGES[0][1]:
                scratch.drop(before)
        return scratch.keep(docs)
