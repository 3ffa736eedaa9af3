"""URL rules through a blocked Bloom filter and an exact hash join. DataFrame functions only.

A rule is (host, path, action). It fits its host and all subdomains of it, where the
url's path starts with the rule's path. Every url yields the keys that a rule could
have (suffixes of its host, as many labels as the longest listed host has; prefixes of
its path, of the lengths that listed paths have). The keys probe a blocked Bloom
filter of the listed (host, path) pairs: one block of eight 32-bit words for each key,
one bit in each word; hosts alone go through a filter of the listed hosts first. What passes goes to an exact hash join with the rules, which
removes false positives, and the longest rule that fits wins. Urls are numbered in a written table.

Null urls, and urls without "://", have empty host and path; they fit no rule unless
one with an empty host is listed. Repeated rows are judged each on its own. Rules that
repeat are taken once; of two rules of the same length, that with the greater
"rule" string wins, then "block" before "allow". Very long urls are judged whole. Other columns of the input, whatever their names, have no
effect. An empty table gives an empty result, and without rules every url has the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, broadcast_if, materialize, table

RULES_SCHEMA = "rule_host string, rule_path string, action string"
#: The filters have a block of 32 bytes for so many rules. They are broadcast where they are counted to be small, else joined by block.
KEYS_PER_BLOCK = 8
WORDS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, ASCII lower case, and path."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\x00"), path)


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks))


def _masks(h: Column) -> list[Column]:
    """One bit in each of eight words, from five bits each of a second hash."""
    g = F.xxhash64(h, F.lit(0x5BD1E995))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """block, w0 .. w7: the filter as a table of at most `blocks` rows."""
    h = _key_hash(F.col("rule_host"), F.col("rule_path"))
    keys = rules.select(h.alias("h"))
    keys = keys.select(_block(F.col("h"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("h")))])
    return keys.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict for every row of pages."""
    rules = rules.select(
        ascii_lower(F.coalesce("rule_host", F.lit(""))).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "action"
    ).groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    # What the probes need of the list: one row, whatever the list's size.
    facts = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
        F.max(F.length(F.concat("rule_host", "rule_path"))).alias("widest"),
    ).first()
    blocks = max(1, -(-facts["n"] // KEYS_PER_BLOCK))
    host, path = url_parts(F.col(url_col))
    rows = materialize(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(facts["labels"] or 1))),
        lambda k: F.array_join(F.slice(labels, -k, k), "."),
    )
    fitting = [n for n in facts["lengths"] or []]
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in fitting]) if fitting else F.array().cast("array<string>"), lambda p: p.isNotNull())

    def passing(probes: DataFrame, filter_rows: DataFrame) -> DataFrame:
        """Probes (with h, their hash) that the filter lets pass."""
        hit = F.lit(True)
        for i, m in enumerate(_masks(F.col("h"))):
            hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
        found = probes.withColumn("block", _block(F.col("h"), blocks)).join(broadcast_if(filter_rows, blocks, 80), "block")
        return found.where(hit).drop("block", "h", *[f"w{i}" for i in range(WORDS)])

    # Hosts are probed first, so that only urls of listed hosts have their paths' prefixes made.
    of_host = passing(rows.withColumn("key_host", F.explode(suffixes)).withColumn("h", _key_hash(F.col("key_host"), F.lit(""))), bloom_blocks(rules.withColumn("rule_path", F.lit("")), blocks))
    of_both = passing(of_host.withColumn("key_path", F.explode(prefixes)).withColumn("h", _key_hash(F.col("key_host"), F.col("key_path"))), bloom_blocks(rules, blocks))
    listed = rules.select(
        F.col("rule_host").alias("key_host"), F.col("rule_path").alias("key_path"),
        F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("action")).alias("found"),
    )
    exact = of_both.select("row", "key_host", "key_path").join(broadcast_if(listed, facts["n"], 64 + 8 * (facts["widest"] or 0)), ["key_host", "key_path"])
    best = exact.groupBy("row").agg(F.max("found").alias("found"))
    # Only urls that a rule fits are shuffled for it.
    out = rows.join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.action"), F.lit(default)).alias("verdict"))


#: The rules of the query's contract.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op8_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULES_SCHEMA))


ORACLE = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule_host, rule_path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
n AS (SELECT *, row_number() OVER () AS id FROM p),
m AS (
  SELECT n.id, r.rule_host || r.rule_path AS rule, r.action, row_number() OVER (PARTITION BY n.id ORDER BY length(r.rule_host || r.rule_path) DESC) AS rn
  FROM n JOIN r ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path))
SELECT n.page_id, n.host, n.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM n LEFT JOIN m ON m.id = n.id AND m.rn = 1
"""
