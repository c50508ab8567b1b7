"""URL filters: rules indexed by their rarest literal token.

A rule is a host and path prefix, or a regular expression. Each names the literal tokens (runs of a-z and 0-9,
whole in any URL it fits) and is filed under the one that the fewest of the table's URLs hold. A URL's tokens fetch
the rules filed under them by an equi-join, and only those run their regular expression. Rules without a literal
token are tried on every URL.

All of it is DataFrame functions. URLs are judged once each and joined back, so a hot URL or host is one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.plans.shared import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name: what a fitting URL is told. rank: the highest of the fitting rules wins, then the smallest name."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits the host, in any case, and its subdomains where the URL's path starts with ``path``."""
    safe = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    whole = path[: path.rfind("/") + 1]  # what follows the last slash may go on in the URL
    return Rule(host + path, action, rf"^(?:[^/]*\.)?{safe(host)}(?![^/]){safe(path)}", tuple(re.findall("[a-z0-9]+", f"{host}{whole}".translate(str.maketrans(UPPER, LOWER)))), 1000 + len(host + path), True)


def pattern_rule(name: str, action: str, pattern: str, *tokens: str) -> Rule:
    """``pattern`` is searched for in host and path; ``tokens`` are whole in every URL it fits."""
    return Rule(name, action, pattern, tokens, 0, False)


#: The rules of the contract.
HOSTS = (host_rule("block", "net", "/"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/"))
#: The method's own: machinery of sites and trade in vice, wherever no listed rule fits.
PATTERNS = (
    pattern_rule("login", "block", r"/wp-(?:login|admin)(?:[./]|$)", "wp"),
    pattern_rule("feed", "block", r"/xmlrpc\.php$", "xmlrpc", "php"),
    pattern_rule("cart", "block", r"/(?:[^/]+/)*cart/checkout(?:/|$)", "cart", "checkout"),
    pattern_rule("casino", "block", r"(?:^|[./-])casino(?:[./-]|$)", "casino"),
    pattern_rule("adserver", "block", r"^(?:[^/]*\.)?adserver\.", "adserver"),
    pattern_rule("tracker", "block", r"^(?:[^/]*\.)?ads?-track\.", "track"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if null or without ``://``."""
    get = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z0-9]+)"), 1))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = HOSTS + PATTERNS, default: str = "allow", small: int = 50_000) -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row of ``pages``.

    rule: the name of the winning listed rule, else null. verdict: that rule's action; else that of the first
    fitting pattern by name; else ``default``. Null and malformed URLs have empty host and path and get the
    default. Repeated rows and ids stay rows of their own; other columns are not read. No rules: all default.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    target = F.concat("host", F.when(F.col("path").startswith("/") | (F.col("path") == ""), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    urls = rows.select("host", "path").distinct().withColumn("target", target)
    table = spark.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.rank, r.listed) for r in rules], "name string, action string, pattern string, tokens array<string>, rank int, listed boolean")
    at = urls.select("host", "path", "target", F.explode(tokens(F.col("target"))).alias("token"))
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    seen = at.join(broadcast_if_small(wanted, small), "token").groupBy("token").count()
    first = F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token"))
    filed = table.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left").groupBy("name", "action", "pattern", "rank", "listed").agg(first.alias("token"))
    fetched = at.join(broadcast_if_small(filed, small), "token").drop("token")
    loose = table.where(F.size("tokens") == 0).select("name", "action", "pattern", "rank", "listed")
    if any(not r.tokens for r in rules):
        fetched = fetched.unionByName(urls.join(F.broadcast(loose), F.expr("target RLIKE pattern")))
    best = fetched.where(F.expr("target RLIKE pattern")).groupBy("host", "path").agg(F.min_by(F.struct("name", "action", "listed"), F.struct(-F.col("rank"), "name")).alias("won"))
    return rows.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.when(F.col("won.listed"), F.col("won.name")).alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


#: Equals judge_urls() with the rules above, for DuckDB.
URL_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
  ELSE CASE WHEN regexp_matches(host || path, '/wp-(?:login|admin)(?:[./]|$)|/xmlrpc\.php$|/(?:[^/]+/)*cart/checkout(?:/|$)|(?:^|[./-])casino(?:[./-]|$)|^(?:[^/]*\.)?(?:adserver|ads?-track)\.') THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
