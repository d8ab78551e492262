"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path with the literal tokens that any match
holds. A rule is filed under the one of its tokens that the fewest URLs hold; a URL fetches the
rules filed under its own tokens, and only those run their regular expressions. All steps are
DataFrame operations.

Two kinds of rules: a prefix rule "host/path" fits its host and all subdomains of it where the
URL's path starts with the rule's path, the longest fitting one decides; where none fits,
pattern rules decide (block before allow), and where none of those fits the verdict is allow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mvspark.llm.common import LOWER, UPPER

#: (verdict, host/path)
PREFIX_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: (verdict, pattern, literal tokens that a match holds whole)
PATTERN_RULES = [
    ("block", r"(?i)(?:^|[./_-])online[_-]casino(?:[./_-]|$)", ("online", "casino")),
    ("block", r"(?i)(?:^|[./_-])casino[_-]bonus(?:[./_-]|$)", ("casino", "bonus")),
    ("block", r"(?i)(?:^|[./_-])free[_-]porn(?:[./_-]|$)", ("free", "porn")),
    ("block", r"(?i)(?:^|[./_-])xxx(?:[./_-]|$)", ("xxx",)),
    ("block", r"(?i)(?:^|[./_-])buy[_-]viagra(?:[./_-]|$)", ("buy", "viagra")),
    ("block", r"(?i)(?:^|[./_-])payday[_-]loans?[./_-]online", ("payday",)),
    ("block", r"(?i)(?:^|\.)adserver\.", ("adserver",)),
    ("block", r"(?i)/warez/", ("warez",)),
    ("block", r"(?i)/torrent/download(?:/|$)", ("torrent", "download")),
    ("block", r"(?i)/cgi-bin/redirect(?:[./]|$)", ("cgi", "bin", "redirect")),
]

#: Up to so many rule rows the index is broadcast; beyond it the join is shuffled.
BROADCAST_RULES = 100_000
ADDED = ("_host", "_path", "_rule", "_verdict", "_pattern")


def prefix_rule(verdict: str, rule: str) -> tuple:
    host, slash, path = rule.partition("/")
    path = slash + path
    tokens = re.findall(r"[a-z0-9]+", host.lower()) + [t for t in re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower().replace("\n", " "))]
    return (rule, verdict, True, len(rule), rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens)


def rule_frame(spark: SparkSession, prefixes=PREFIX_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """Rules as rows: rule, verdict, is_prefix, length, regex, tokens."""
    rows = [prefix_rule(v, r) for v, r in prefixes] + [(p, v, False, len(p), p, list(t)) for v, p, t in patterns]
    return spark.createDataFrame(rows, "rule string, verdict string, is_prefix boolean, length int, regex string, tokens array<string>")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if url is null or has no "://"."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _tokens(target: Column) -> Column:
    """Distinct literal tokens of a URL, and the empty one, under which rules without tokens are filed."""
    return F.array_distinct(F.concat(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+"), F.array(F.lit(""))))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """pages with _host, _path, _rule (the deciding prefix rule or null), _verdict and _pattern added; columns of these names are replaced.

    Null urls and urls without "://" have an empty host and path, which no prefix rule fits: allow.
    Rows are kept as they are, repeated ones and null ids too; an empty table gives an empty result.
    Equal host + path are decided once per task and once more per value, so a hot page costs no skew.
    """
    host, path = host_path(F.col(url_col))
    kept = [c for c in pages.columns if c not in ADDED]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row")  # no name of pages can clash with one of the rules
    pages = pages.select(row, host.alias("_host"), path.alias("_path")).withColumn("target", F.concat("_host", "_path"))
    targets = pages.select("target")
    urls = targets.select("target", F.explode(_tokens(F.col("target"))).alias("token"))

    bounded = rules.count() <= broadcast_rules
    small = F.broadcast if bounded else (lambda df: df)
    filed = rules.select("*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    counts = urls.select("token").join(small(filed.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = filed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    index = filed.groupBy("rule", "verdict", "is_prefix", "length", "regex").agg(F.min_by("token", F.struct("n", "token")).alias("token"))

    fits = urls.join(small(index), "token").where(F.expr("target rlike regex"))
    rank = F.struct("is_prefix", F.when(F.col("is_prefix"), F.col("length")).otherwise(0).alias("longest"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = fits.groupBy("target").agg(F.max(rank).alias("best"))
    out, rule = pages.join(best, "target", "left"), F.col("best.rule")
    return out.select(
        "_row.*",
        "_host",
        "_path",
        F.when(F.col("best.is_prefix"), rule).alias("_rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("_verdict"),
        F.when(~F.col("best.is_prefix"), rule).alias("_pattern"),
    )
