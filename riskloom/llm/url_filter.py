"""URL filters: host-suffix and path-prefix expressions joined with rules by hashed prefixes.

A rule (host, path, verdict) fits its host and all subdomains, if the url's path starts with
the rule's. Every rule is one expression, host and path. Every url is expanded into the
expressions that could be rules: its host cut to as many labels as some rule's host has, and
its path cut to as many characters as some rule's path has. These shapes come from the whole
rule table, so none is missed, and a url with thousands of labels yields no more expressions
than there are shapes. Expressions meet rules by an equi-join on the first bytes of a digest;
the full digests are compared afterwards. Of the rules that fit, the longest wins (host and
path together, then the longer host, then block before allow); a url without one gets the
default verdict.

Only hashes, ids, host and path are joined. The rules' side is broadcast when its measured size
is small. Beyond that the join shuffles, with a url's part of the key salted over ``SALTS``
copies of the rules, so a host with a third of all pages is met by many tasks. The best rule is
an aggregate per page, reduced before its shuffle.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the
default verdict unless a rule has an empty host and path; repeated rows and ids are judged one
by one; a rule with a null host, path or verdict is left out; repeated rules count once; a port
or user name belongs to the host; an empty page table gives no rows, an empty rule table the
default verdict for all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.operators.joins import broadcast_if_small

#: Bytes of a digest that are joined, as hexadecimal digits; the rest is compared afterwards.
PREFIX_DIGITS = 8
#: Copies of the rules over which pages are dealt when rules are too many to broadcast.
SALTS = 16
#: The rules of the query: host, path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


def _labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.", -1))).cast("int")


def _digest(host: Column, path: Column) -> Column:
    # A zero byte between host and path, so that no other pair gives the same text.
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = tuple(RULES)) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path, or null) and verdict of every page row."""
    host = F.translate("host", _UPPER, _LOWER)
    known = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .select(host.alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    )
    # The shapes of all rules: at most (labels of the longest host) x (characters of the longest path).
    shape = F.struct(_labels(F.col("r_host")).alias("labels"), F.length("r_path").alias("length"))
    shapes = sorted((r["labels"], r["length"]) for r in known.select(F.inline(F.array(shape))).distinct().collect())
    own_host, own_path = host_and_path(F.col("url"))
    # The number of a row in its part of the scan; used once, before any shuffle.
    tagged = pages.select(
        F.monotonically_increasing_id().alias("tag"), F.col("page_id").cast("long").alias("page_id"),
        own_host.alias("host"), own_path.alias("path"),
    )
    if not shapes:
        return tagged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    fits = lambda labels, length: (_labels(F.col("host")) >= labels) & (F.length("path") >= length)
    suffix = lambda labels: F.substring_index("host", ".", -labels) if labels else F.lit("")
    expressions = F.array(*[
        F.when(fits(labels, length), _digest(suffix(labels), F.substring("path", 1, length))) for labels, length in shapes
    ])
    expanded = tagged.withColumn("digest", F.explode_outer(F.array_compact(expressions)))

    short = lambda c: F.substring(c, 1, PREFIX_DIGITS)
    known = known.withColumn("r_short", short("r_digest"))
    small = broadcast_if_small(known)
    joined_on = (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest"))
    expanded = expanded.withColumn("short", short("digest"))
    if small is known:
        known = known.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        expanded = expanded.withColumn("salt", F.pmod(F.xxhash64("tag"), F.lit(SALTS)).cast("int"))
        joined_on = joined_on & (F.col("salt") == F.col("r_salt"))
        small = known
    met = expanded.join(small, joined_on, "left")
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("total"), F.length("r_host").alias("host"), (F.col("r_verdict") == "block").alias("block")
    )
    rule = F.when(F.col("r_digest").isNotNull(), F.struct(order.alias("order"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")))
    best = met.groupBy("tag", "page_id", "host", "path").agg(F.max(rule).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP12_SQL = r"""
WITH rules (r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
  SELECT row_number() OVER () AS tag, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT tag, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), met AS (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY length(r_host) + length(r_path) DESC NULLS LAST) AS place
  FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM met WHERE place = 1
"""
