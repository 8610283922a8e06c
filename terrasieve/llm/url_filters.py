"""URL filters: a host and path rule list, and rules mined by FP-growth for the urls that no listed rule fits.

Urls that a listed rule decides are the labelled transactions. FP-growth finds token combinations that go with a
label; rules are pruned by support, confidence and by a shorter rule that is as sure. No frequent token is left out: tokens in
the same labelled urls are mined as one, which any of them fulfils later. A url's host suffixes are nested, so several are as
good as the longest of them; each is mined in a pool of its own, without the others, as they would double the combinations
with each label. The rest of the urls meet mined rules through an inverted index from tokens to rules. Everything is built-in
functions and Spark's own FP-growth.

Defined results: a null url, or one without "://", has an empty host and path and is allowed; repeated rows are
judged alike; of mined rules that fit equally sure and supported ones go by their tokens' text, the larger first (of tokens mined as one the
url's longest, then largest, is the text); very long urls are
read whole, but host suffixes of more than 253 characters, the longest a host name can be, are no tokens; without labelled urls no rule
is mined and the rest is allowed; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.llm.common import ascii_lower, written


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    ListedRule("allow", "com", "/"),
    ListedRule("block", "example.com", "/en/"),
    ListedRule("allow", "www.example.com", "/en/"),
    ListedRule("block", "net", "/es/"),
    ListedRule("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
#: Characters of a host name at most, by the rules of the domain name system.
LONGEST_HOST = 253


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(rules: tuple[ListedRule, ...], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; equal lengths by rule text."""
    found = F.when(F.lit(False), F.lit(None).cast("struct<rule:string,verdict:string>"))
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = found.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens, sorted: host suffixes, path segments, the file's ending and query names; digits become 0."""
    # a host name can't be longer; of what is, the labels at its end count
    tail = F.when(F.length(host) <= LONGEST_HOST, host).otherwise(F.regexp_replace(F.right(host, F.lit(LONGEST_HOST)), r"^[^.]*\.?", ""))
    labels = F.split(tail, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, n), ".")))
    segments = F.transform(F.filter(F.split(F.lower(path), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), s))
    ending = F.filter(F.array(F.concat(F.lit("e:"), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))), lambda s: F.length(s) > 2)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.split_part(s, F.lit("="), F.lit(1))))
    every = F.concat(F.when(tail != "", suffixes).otherwise(F.array().cast("array<string>")), segments, ending, names)
    return F.sort_array(F.array_distinct(F.transform(every, lambda t: F.regexp_replace(t, r"\d+", "0"))))


def equal_tokens(labelled: DataFrame, least: int) -> DataFrame:
    """token and stands of all tokens that least urls of labelled(_id, tokens) have: of host suffixes, and of other tokens, in the same urls the longest stands for all."""
    found = labelled.select("_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_id")).alias("_x"))
    found = written(found.where(F.col("n") >= least).withColumn("_h", F.col("token").startswith("h:")), "tokens")
    longest = found.groupBy("n", "_x", "_h").agg(F.max_by("token", F.struct(F.length("token"), "token")).alias("stands"))
    return written(found.join(longest, ["n", "_x", "_h"]).select("token", "stands"), "stands")


def host_pools(short: DataFrame, least: int) -> DataFrame:
    """pool, _id, token: each url's tokens that aren't host suffixes, once for each of its suffixes (the pool) and once without any (pool "").

    Rarer tokens of a pool are left out, and those all its urls have: with the pool they make no other rule than without.
    """
    pools = short.where(F.col("token").startswith("h:")).select("_id", F.col("token").alias("pool"))
    others = short.where(~F.col("token").startswith("h:"))
    met = written(pools.join(others, "_id").unionByName(others.withColumn("pool", F.lit(""))), "pools")
    sizes = pools.groupBy("pool").agg(F.count(F.lit(1)).alias("size"))
    useful = met.groupBy("pool", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).join(sizes, "pool", "left")
    return met.join(useful.where("size is null or n < size").select("pool", "token"), ["pool", "token"])


def learnt(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """The rules of mine() on standing tokens, and equal_tokens()."""
    labelled = written(labelled.withColumn("_id", F.monotonically_increasing_id()), "labelled")
    total = labelled.count()
    least = max(math.ceil(support * total), 1)
    stands = equal_tokens(labelled, least)
    short = labelled.select("_id", "verdict", F.explode("tokens").alias("token")).join(stands, "token").select("_id", "verdict", F.col("stands").alias("token")).distinct()
    short = written(short, "short")
    # "/" can't be part of a host: an item is its pool, "/" and the token or label, so pools share no item
    item = lambda pool, what: F.concat(pool, F.lit("/"), what)
    kept = host_pools(short.select("_id", "token"), least).groupBy("pool", "_id").agg(F.collect_set(item(F.col("pool"), F.col("token"))).alias("items"))
    label = F.array(item(F.col("pool"), F.concat(F.lit("="), F.col("verdict"))))
    items = written(kept.join(labelled.select("_id", "verdict"), "_id").select(F.concat("items", label).alias("items")), "items")
    n = max(items.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(items)  # at least least urls
    said = lambda c: F.substring(c, F.instr(c, F.lit("/")) + 1, F.length(c))
    rules = model.associationRules.withColumn("pool", F.substring_index(F.get("consequent", F.lit(0)), "/", 1)).withColumn("to", said(F.get("consequent", F.lit(0))))
    rules = rules.withColumn("tokens", F.transform("antecedent", said)).where(F.col("to").startswith("=") & ~F.exists("tokens", lambda t: t.startswith("=")))
    pool = F.when(F.col("pool") == "", F.array().cast("array<string>")).otherwise(F.array("pool"))
    rules = rules.select(F.sort_array(F.concat(pool, "tokens")).alias("tokens"), F.expr("substring(to, 2)").alias("verdict"), "confidence", F.round(F.col("support") * n).alias("right"))
    # a host suffix alone
    hosts = short.where(F.col("token").startswith("h:")).groupBy("token", "verdict").agg(F.count(F.lit(1)).alias("right"))
    hosts = hosts.join(hosts.groupBy("token").agg(F.sum("right").alias("all")), "token").withColumn("confidence", F.col("right") / F.col("all"))
    hosts = hosts.where((F.col("right") >= least) & (F.col("confidence") >= confidence)).select(F.array("token").alias("tokens"), "verdict", "confidence", F.col("right").cast("double").alias("right"))
    rules = rules.unionByName(hosts).withColumn("support", F.col("right") / max(total, 1)).drop("right")
    rules = written(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "rules")
    # a rule goes if one that is part of it has the same verdict and is as sure; parts meet by their tokens
    whole = rules.select("rule_id", F.size("tokens").alias("n"), "verdict", "confidence", F.explode("tokens").alias("token"))
    part = whole.select(F.col("rule_id").alias("part"), F.col("n").alias("few"), "verdict", F.col("confidence").alias("sure"), "token")
    met = whole.join(part, ["token", "verdict"]).where("few < n and sure >= confidence").groupBy("rule_id", "part", "few").agg(F.count(F.lit(1)).alias("met"))
    return rules.join(met.where("met = few").select("rule_id").distinct(), "rule_id", "left_anti"), stands


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support of the rules in labelled(tokens, verdict), pruned; a token stands for all of equal_tokens()."""
    return learnt(labelled, support, confidence)[0]


def matches(token_sets: DataFrame, rules: DataFrame, stands: DataFrame) -> DataFrame:
    """_set and the verdict of its surest rule (then the best supported, then by tokens), for sets of tokens that have one.

    The index has a row for each token of each rule; a rule fires where all its tokens, or equal ones, met.
    """
    index = rules.select("rule_id", F.size("tokens").alias("n"), "verdict", "confidence", "support", F.explode("tokens").alias("stands"))
    own = token_sets.select("_set", F.explode("tokens").alias("token")).join(stands, "token").groupBy("_set", "stands").agg(F.max_by("token", F.struct(F.length("token"), "token")).alias("token"))
    fired = own.join(index, "stands").groupBy("_set", "rule_id").agg(F.count(F.lit(1)).alias("met"), F.sort_array(F.collect_list("token")).alias("tokens"), *[F.first(c).alias(c) for c in ("n", "verdict", "confidence", "support")]).where("met = n")
    rank = F.struct("confidence", "support", F.array_join("tokens", " ").alias("by"), "verdict")
    return fired.groupBy("_set").agg(F.max(rank).alias("best")).select("_set", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"), F.col("best.by").alias("evidence"))


def judge(pages: DataFrame, rules: tuple[ListedRule, ...] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict; for mined verdicts also confidence and evidence (the rule's tokens)."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "url")
    read = read.withColumn("_found", listed(rules, F.col("host"), F.col("path"))).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    read = written(read.withColumn("_set", F.xxhash64("tokens")), "urls")
    labelled = read.where("_found is not null").select("tokens", F.col("_found.verdict").alias("verdict"))
    mined, stands = learnt(labelled, **options)
    rest = read.where("_found is null").groupBy("_set").agg(F.first("tokens").alias("tokens"))
    found = matches(rest, mined, stands)
    # urls that a listed rule decides don't go through the join
    none = F.lit(None)
    decided = read.where("_found is not null").select("page_id", "host", "path", "_found", none.cast("string").alias("mined"), none.cast("double").alias("confidence"), none.cast("string").alias("evidence"))
    open_ = read.where("_found is null").join(found, "_set", "left").select(*decided.columns)
    return decided.unionByName(open_).select(
        "page_id", "host", "path", F.col("_found.rule").alias("rule"), F.coalesce(F.col("_found.verdict"), F.col("mined"), F.lit("allow")).alias("verdict"), "confidence", "evidence"
    )
