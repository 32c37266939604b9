"""URL allow and block lists.

A rule is (host, path, verdict).  It fits a URL whose host is the rule's host
or a subdomain of it and whose path starts with the rule's path; the longest
``host + path`` wins, then the longer host, then block before allow.

Each URL is expanded into host-suffix x path-prefix expressions, path
prefixes only at lengths that occur in the rules.  Expressions equi-join the
rules on a short hash prefix; a full SHA-256 digest then confirms the match.
A million URLs of one host spread over the join by their expressions, and the
few expressions that rules contain are joined by adaptive, size-checked joins.

Defined results: a null URL or one without ``://`` has empty host and path;
no fitting rule gives a null rule and the default verdict.  Every input row
gives one output row, repeated rows and null ids included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import load, register

SHORT_HEX = 8  # hex digits of the joined prefix: 32 bits
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER),
            F.coalesce(path, F.lit("")))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict."""
    host, path = split_url(F.col(url_col))
    # Rules for one expression that disagree: block stands.
    rules = (
        rules.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("rule_digest", _digest(F.col("host"), F.col("path")))
        .select(
            F.substring("rule_digest", 1, SHORT_HEX).alias("short"), "rule_digest",
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_len"), "rule_verdict",
        )
    )
    # Lengths of rule paths and label counts of rule hosts: one row each, no
    # longer than the longest rule.  Only suffixes and prefixes of such sizes
    # are built, so a host of very many labels costs no more than its length.
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("rule") - F.col("host_len"))).alias("a"))
    rule_host = F.substring(F.col("rule"), F.lit(1), F.col("host_len"))
    counts = rules.agg(F.array_sort(F.collect_set(F.size(F.split(rule_host, r"\.")))).alias("a"))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns({
        "lengths": F.coalesce(lengths.scalar(), F.array().cast("array<int>")),
        "counts": F.coalesce(counts.scalar(), F.array().cast("array<int>")),
        "labels": F.split("host", r"\."),
    })
    # Same URL parts give the same verdict: judge each distinct (host, path)
    # once, so a URL that fills a third of the table is expanded once.
    parts = urls.select("host", "path", "labels", "lengths", "counts").distinct()
    suffixes = F.transform(
        F.filter("counts", lambda n: n <= F.size("labels")),
        lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = (
        parts.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, SHORT_HEX))
    )
    won = (
        expressions.join(rules, "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            F.length("rule").alias("n"), "host_len", "rule_verdict", "rule")).alias("best"))
    )
    return urls.join(won, ["host", "path"], "left").select(
        F.col(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )


SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
hits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id
      ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, rverdict DESC) AS k
  FROM parts LEFT JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM hits WHERE k = 1
"""


@register("op7_url_filter", SQL)
def op7_url_filter(spark, sf_dir):
    return filter_urls(load(spark, sf_dir, "pages"), rules_frame(spark))
