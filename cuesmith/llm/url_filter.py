"""Allow and block lists over URLs by host suffix and path prefix.

Every URL is expanded into host-suffix x path-prefix expressions (path prefixes only of lengths that
rules have), the expressions meet the rules by an equi-join on a short digest prefix, and the full
digest decides; the longest fitting rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.scratch import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of the digest that the join uses.
SHORT = 8


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, ASCII lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)  # a host holds no slash, so the parts stay apart


def prepared_rules(rules: DataFrame) -> DataFrame:
    """rules(action, host, path) with digests; of equal host and path, block wins."""
    r = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "action")
    r = r.groupBy("r_host", "r_path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    d = _digest(F.col("r_host"), F.col("r_path"))
    return r.select(d.alias("r_digest"), F.substring(d, 1, SHORT).alias("short"), F.concat("r_host", "r_path").alias("rule"), F.length("r_host").alias("r_len"), F.length("r_path").alias("p_len"), F.col("action").alias("r_action"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (columns so named are replaced).

    A rule (action, host, path) fits its host and all subdomains where the url's path starts with the rule's
    path. The longest rule (host and path together, then the longer host) wins; without one, rule is null and
    verdict is default. A null url, or one without ://, has empty host and path and fits no rule with a host.
    Verdicts are found once per distinct (host, path) and joined back, so repeated urls cost one expansion
    and keep all their rows. Whether the rules are broadcast is left to Spark's size threshold.
    """
    rules = prepared_rules(rules)
    # one row, as long as rules have distinct path lengths (at most the longest path of a rule)
    lengths = sorted(x.p_len for x in rules.select("p_len").distinct().collect())
    plain = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    distinct = plain.select("host", "path").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]', -1))), i -> array_join(slice(split(host, '[.]', -1), i, size(split(host, '[.]', -1))), '.'))")
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    wide = distinct.select("host", "path", F.explode(suffixes).alias("s"), F.transform(fits, lambda n: F.substr(F.col("path"), F.lit(1), n)).alias("ps"))
    wide = wide.select("host", "path", "s", F.explode("ps").alias("p")).withColumn("digest", _digest(F.col("s"), F.col("p")))
    wide = wide.withColumn("short", F.substring("digest", 1, SHORT)).select("host", "path", "digest", "short")
    hits = wide.join(rules, "short").filter(F.col("digest") == F.col("r_digest"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "r_action"), F.struct(F.col("r_len") + F.col("p_len"), F.col("r_len"))).alias("best"))
    b_host, b_path = fresh(pages, "_b_host"), fresh(pages, "_b_path")
    best = best.select(F.col("host").alias(b_host), F.col("path").alias(b_path), F.col("best.rule").alias("rule"), F.col("best.r_action").alias("verdict"))
    out = plain.join(best, (F.col("host") == F.col(b_host)) & (F.col("path") == F.col(b_path)), "left").drop(b_host, b_path)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
