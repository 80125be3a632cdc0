"""URL filter: host-suffix and path-prefix expressions, hash-prefix equi-join, digest confirmation.

Every distinct (host, path) is expanded into ``host suffix + path prefix`` expressions. Only suffixes
with as many labels and prefixes of as many characters as some rule has are made, so the expansion is
bounded by the rule table, not by the URL. The first four bytes of an expression's SHA-256 are joined
with those of the rules; the full digest then confirms the match and the longest rule wins (a block
before an allow of the same length). All of it is built-in functions.

Defined results: null URLs and URLs without ``://`` have empty host and path and get the default
verdict; repeated rows stay repeated; an empty table gives an empty table; further columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import values

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Rule tables of up to this many rows (some 20 MB) are broadcast, larger ones are shuffled.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All ``suffix + prefix`` strings with one of the given label counts and prefix lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.array(*[F.when(F.size(parts) >= n, F.substring_index(host, ".", -n)) for n in labels])
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.filter(both, lambda e: e.isNotNull())


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """``rules``: a DataFrame (verdict, host, path) or a list of such tuples."""
    table = rules if isinstance(rules, DataFrame) else values(spark, list(rules), "verdict string,host string,path string")
    rule = F.concat(F.translate("host", UPPER, LOWER), F.col("path"))
    return table.select(
        rule.alias("rule"), "verdict", F.sha2(rule, 256).alias("digest"),
        (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("chars"),
    ).where(F.col("rule").isNotNull())


def filter_urls(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict for every row of ``pages``."""
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    shape = table.agg(F.collect_set("labels"), F.collect_set("chars"), F.count(F.lit(1))).first()
    host, path = url_parts(F.col(url).cast("string"))
    parsed = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shape[2]:
        return parsed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sites = parsed.select("host", "path").distinct()
    asked = sites.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(shape[0]), sorted(shape[1]))).alias("expression"))
    asked = asked.select("host", "path", F.sha2("expression", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, 8))
    table = table.select("rule", "verdict", F.col("digest").alias("rule_digest"), F.substring("digest", 1, 8).alias("prefix"))
    hits = asked.join(F.broadcast(table) if shape[2] <= BROADCAST_RULES else table, "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("chars"), (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
s AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
