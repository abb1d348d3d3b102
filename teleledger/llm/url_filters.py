"""URL filters: association rules mined from labelled URLs, beside given host and path rules.

A URL's tokens are its host's labels, its path's and query's words and their place; digits alone are no token. FP-growth mines
token combinations of labelled URLs with the label as one more item; rules that lead to the label are kept at ``CONFIDENCE``,
``SUPPORT`` and ``LIFT`` or more, unless a part of their tokens already leads there as surely. An inverted index files
each rule under its rarest token; a URL meets only the rules filed under its tokens, and is blocked if it has all tokens of one.

A given rule (host, path) fits its host and all subdomains if the path starts with the rule's; the longest fitting rule
decides alone; fitting rules of one length are the same host and path cut differently, and the first by host decides. A null URL,
or one without ``://``, has an empty host and path, no token, and is allowed. Equal URLs are judged once, and every row gets
its row back. A page_id with several labels is bad if one of them is. Without labels, or pages, nothing is mined. Further columns
are not read. Only DataFrame and ML functions of Spark are used.

Mining takes time by the number of token combinations that differ in their URLs, not by the length of URLs that are alike.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teleledger.llm import common

#: Least share of labelled URLs that a rule's tokens and label occur in together, and least share of bad ones among those.
SUPPORT, CONFIDENCE, LIFT = 0.001, 0.6, 1.5
#: Fewest labelled URLs that a rule rests on, whatever their share.
LEAST_URLS = 5
RULES: list[tuple[str, str, str]] = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BAD = "label:bad"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting(host_: Column, path_: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as verdict and text; null without one. The list is short and given by hand."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1]))
    fits = [F.when(((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p), F.struct(
        F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))) for verdict, h, p in longest]
    return F.coalesce(*fits)


def tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` labels of the host, ``p:`` words of the path, ``q:`` of what follows it."""
    words = lambda mark, text: F.transform(
        F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x.rlike("[a-z]")), lambda x: F.concat(F.lit(mark), x))
    after = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*([\s\S]*)", 1)
    return F.array_distinct(F.concat(words("h:", host(url)), words("p:", path(url)), words("q:", after)))


def classes(baskets: DataFrame) -> DataFrame:
    """token, n, n_bad, item: tokens that lie in the same baskets (``at``, ``items``, ``bad``) are one item, named by the least of them.

    Two sums of hashes of the baskets' numbers, their count and how many are bad stand for the baskets of a token.
    """
    seen = baskets.select("at", "bad", F.explode("items").alias("token"))
    by = seen.groupBy("token").agg(
        F.bit_xor(F.xxhash64("at")).alias("x"), F.bit_xor(F.xxhash64("at", F.lit(1))).alias("y"),
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    return by.select("token", "n", "n_bad", F.min("token").over(Window.partitionBy("x", "y", "n", "n_bad")).alias("item"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE,
         lift: float = LIFT) -> tuple[DataFrame, DataFrame]:
    """Rules from ``items`` and ``bad``: antecedent (items), confidence, support; and the items' tokens (token, item).

    A rule is dropped if a part of it is as sure. That lets FP-growth start from less, with the same rules: two tokens of the
    same baskets never share a rule, so a class of them is one item and any of its tokens will do; an item that leads to the label
    without exception is a rule, and no longer rule holds it; an item with too few bad baskets is in no rule.
    """
    # Numbered before it is written: a number given while items are spread out would be the item's.
    baskets = common.stored(labelled.select(F.monotonically_increasing_id().alias("at"), "items", "bad"), "baskets")
    total, bad = baskets.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    least = max(support, min(1.0, LEAST_URLS / max(1, total)))
    usable = common.stored(classes(baskets).filter(F.col("n_bad") >= math.ceil(least * total)), "classes")
    sure = usable.filter((F.col("n_bad") == F.col("n")) & (F.col("item") == F.col("token"))).select(
        F.array("item").alias("antecedent"), F.lit(1.0).alias("confidence"), (F.col("n") / max(1, total)).alias("support"))
    open_ = usable.filter((F.col("n_bad") < F.col("n")) & (F.col("item") == F.col("token"))).select("token")
    # Every basket stays, without an item as well, so that shares are shares of all labelled URLs.
    left = baskets.select("at", F.explode("items").alias("token")).join(open_, "token").groupBy("at").agg(F.collect_list("token").alias("items"))
    small = baskets.select("at", "bad").join(left, "at", "left").select(F.array_compact(F.concat(
        F.coalesce("items", F.array().cast("array<string>")), F.array(F.when(F.col("bad"), _BAD)))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(small)
    mined = model.associationRules.filter((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == _BAD)).select(
        F.sort_array("antecedent").alias("antecedent"), "confidence", "support")
    found = common.stored(mined.unionByName(sure).filter(F.col("confidence") * max(1, total) >= lift * (bad or 0)), "mined")
    # The parts of a rule one token shorter, by an equi-join; rules with one token have none.
    shorter = found.filter(F.size("antecedent") > 1).select("antecedent", "confidence", F.explode(F.transform(
        "antecedent", lambda x: F.array_remove(F.col("antecedent"), x))).alias("part"))
    as_sure = shorter.join(found.select(F.col("antecedent").alias("part"), F.col("confidence").alias("c")), "part").filter(
        F.col("c") >= F.col("confidence")).select("antecedent").distinct()
    return common.stored(found.join(as_sure, "antecedent", "left_anti"), "rules"), usable.select("token", "item")


def matched(urls: DataFrame, rules: DataFrame, tokens_of: DataFrame) -> DataFrame:
    """url, confidence: the surest mined rule all of whose items a URL (``url``, ``items``) has a token of."""
    used = tokens_of.join(rules.select(F.explode("antecedent").alias("item")).distinct(), "item", "left_semi")
    has = urls.select("url", F.explode("items").alias("token")).join(used, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    each = common.stored(has, "held").select("url", "items", F.explode("items").alias("item"))
    common_ = each.groupBy("item").agg(F.count("*").alias("n"))
    filed = (rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(common_, "item", "left")
             .groupBy("antecedent", "confidence").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("rarest"))
             .select("antecedent", "confidence", F.col("rarest.item").alias("item")))
    return (each.join(filed, "item").filter(F.size(F.array_except("antecedent", "items")) == 0)
            .groupBy("url").agg(F.max("confidence").alias("confidence")))


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, confidence of the mined rule if one matched."""
    urls = common.stored(pages.select("url").filter(F.col("url").isNotNull()).distinct().select("url", tokens(F.col("url")).alias("items")), "urls")
    bad = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    labelled = pages.select("page_id", "url").join(bad, "page_id").select(tokens(F.col("url")).alias("items"), "bad").filter(F.size("items") > 0)
    mined = matched(urls, *mine(labelled))
    fit = fitting(host(F.col("url")), path(F.col("url")), rules)
    return pages.select("page_id", "url").join(mined, "url", "left").select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), fit["rule"].alias("rule"),
        F.coalesce(fit["verdict"], F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
