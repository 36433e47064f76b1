"""URL filter: allow and block rules on host suffix and path prefix.

Every distinct url is expanded into (host suffix, path prefix) expressions. An
expression meets the rules by an equi-join on the first bytes of its SHA-256;
the full digest is then confirmed, and the longest confirmed rule wins.

* Hosts are expanded at label borders, so a rule ``com`` fits ``com`` and all
  its subdomains but not ``xcom``.
* Paths are expanded at the prefix lengths that occur in the rules.
* The url ``scheme://Host/path?query#fragment`` has its host lower-cased (A-Z
  only); null, or without ``://``: host and path are empty strings, and only a
  rule of empty host and path could fit.
* Precedence: the longest rule (host plus path), then the longest host, then
  block before allow. No rule: ``default``. Repeated rows each get their verdict;
  extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
# rules up to this count are broadcast, more are joined by a shuffle
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]; an empty host gives itself."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, hash_prefix: int = 8,
               default: str = ALLOW) -> DataFrame:
    """``pages(page_id, url)`` and ``rules(host, path, action)`` -> page_id, url,
    host, path, rule, verdict. ``hash_prefix`` is in hex digits."""
    pages = pages.select("page_id", "url")
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path"),
        F.col("action").alias("r_action"),
    ).distinct()
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    rules = rules.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path")))
    rules = rules.withColumn("r_key", F.substring("r_digest", 1, hash_prefix))
    # one number per distinct rule-path length: bounded by the longest rule
    lengths = sorted(r[0] for r in rules.select(F.char_length("r_path")).distinct().collect())
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    host, path = F.col("host"), F.col("path")
    urls = (
        pages.select("url").distinct()
        .select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    )
    prefixes = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths])
        if lengths else F.array().cast("array<string>"),
        lambda p: p.isNotNull(),
    )
    expressions = (
        urls.withColumn("e_host", F.explode(host_suffixes(host)))
        .withColumn("e_path", F.explode(prefixes))
        .withColumn("e_digest", digest(F.col("e_host"), F.col("e_path")))
        .select("url", "e_digest", F.substring("e_digest", 1, hash_prefix).alias("e_key"))
    )
    hit = F.col("e_key") == F.col("r_key")
    found = expressions.join(F.broadcast(rules) if small else rules, hit).filter(
        F.col("e_digest") == F.col("r_digest")
    )
    rank = F.struct(
        (F.char_length("r_host") + F.char_length("r_path")).alias("n"),
        F.char_length("r_host").alias("h"),
        (F.col("r_action") == BLOCK).alias("b"),
    )
    best = found.groupBy(F.col("url").alias("b_url")).agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_action"), rank).alias("best")
    )
    judged = urls.join(best, F.col("url").eqNullSafe(F.col("b_url")), "left").select(
        F.col("url").alias("u_url"), "host", "path", "best"
    )
    return pages.join(judged, F.col("url").eqNullSafe(F.col("u_url")), "left").select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.r_action"), F.lit(default)).alias("verdict"),
    )
