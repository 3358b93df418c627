"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that
every match must contain.  Token counts over all urls pick each rule's rarest
token; a url's tokens fetch the rules that wait for one of them, and only those
run their expression.  Equal (host, path) pairs are judged once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import cut

RULE_SCHEMA = "rule string, pattern string, literals array<string>, verdict string, strength int, listed boolean"
ALWAYS = ""  # the token of rules without a literal; every url has it
FEW_RULES = 1 << 15  # so many travel whole to the urls' tasks; more meet the urls' tokens in a shuffle

#: Words of hosts and paths that the method itself blocks.
SPAM_WORDS = ("adserver", "betting", "casino", "doubleclick", "escort", "gambling", "jackpot", "lottery",
              "payday", "poker", "porn", "roulette", "torrent", "viagra", "warez", "xxx")


def listed_rule(text: str, verdict: str) -> tuple:
    """A rule ``host/path``: fits the host, its subdomains, and paths that start with its path."""
    host, slash, path = text.partition("/")
    path = slash + path
    literals = [t for t in re.split(r"[^0-9a-z]+", host.lower()) if t]
    # a path segment is a token of the url only if the rule itself ends it
    literals += [t for t in re.findall(r"(?<=[^0-9a-z])([0-9a-z]+)(?=[^0-9a-z])", path.lower())]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}"
    return text, pattern, literals, verdict, len(text), True


def word_rule(word: str, verdict: str = "block") -> tuple:
    """A rule of the method: ``word`` as a whole token of host or path."""
    return word, rf"(?i)(?:^|[^0-9a-z]){re.escape(word)}(?:$|[^0-9a-z])", [word], verdict, 0, False


def rule_table(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    words = F.split(F.lower(F.concat(host, path)), r"[^0-9a-z]+")
    return F.array_distinct(F.concat(F.array(F.lit(ALWAYS)), words))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, pattern_rule, verdict``.

    Of the listed rules that fit, the longest decides (ties: the first by name);
    ``rule`` names it, else it is null.  Where none fits, the method's own rules
    decide (``pattern_rule``, block before allow), else ``default``.  A null url and
    one without ``://`` have empty host and path.  Null ids and repeated rows come
    out as they went in; empty tables of pages or rules are fine.
    """
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    urls = cut(p.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n")))
    tokens = urls.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("_token"))

    rules = rules.withColumn("_lit", F.when(F.size(F.coalesce("literals", F.array())) > 0, F.col("literals"))
                             .otherwise(F.array(F.lit(ALWAYS))))
    wanted = rules.select("rule", "pattern", "verdict", "strength", "listed", F.explode("_lit").alias("_token"))
    counts = tokens.join(wanted.select("_token").distinct(), "_token", "left_semi").groupBy("_token").agg(
        F.count(F.lit(1)).alias("_urls"))
    index = cut(wanted.join(counts, "_token", "left").groupBy("rule", "pattern", "verdict", "strength", "listed")
             .agg(F.min(F.struct(F.coalesce("_urls", F.lit(0)).alias("n"), F.col("_token").alias("t"))).alias("_min"))
             .select("rule", "pattern", "verdict", "strength", "listed", F.col("_min.t").alias("_token")))
    # the written urls pack into a small part of what their tokens take in memory, so by sizes Spark would
    # broadcast the tokens; only rules may be
    few = index.limit(FEW_RULES + 1).count() <= FEW_RULES
    hits = tokens.join(index.hint("broadcast" if few else "merge"), "_token").where(F.expr("concat(host, path) rlike pattern"))
    # least struct wins: the longest listed rule, then by name; block sorts after allow, so its flag is inverted
    order = F.struct((-F.col("strength")).alias("s"), F.col("rule").alias("r"), F.col("verdict").alias("v"))
    own = F.struct((F.col("verdict") != "block").alias("a"), F.col("rule").alias("r"), F.col("verdict").alias("v"))
    best = hits.groupBy("host", "path").agg(F.min(F.when(F.col("listed"), order)).alias("_rule"),
                                            F.min(F.when(~F.col("listed"), own)).alias("_own"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("_rule.r").alias("rule"),
                       F.when(F.col("_rule").isNull(), F.col("_own.r")).alias("pattern_rule"),
                       F.coalesce("_rule.v", "_own.v").alias("_v"))
    return p.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        "page_id", "host", "path", "rule", "pattern_rule", F.coalesce("_v", F.lit(default)).alias("verdict"))
