"""Operator 1, URL filters.

``judge`` compares the canonical form of every URL with a table of listed canonical URLs. A blocked Bloom filter of the
list (256-bit blocks; a URL sets one bit in each of a block's eight words) lets only possible hits on to the exact hash
join, which removes the false positives. The filter has at most ``max_blocks`` blocks (2^18 blocks of 32 bytes are
8 MB), so its broadcast is bounded however long the list is; a list too long for it only lets more URLs on to the exact
join and changes no result. Host and path rules, if given, come before the list; the longest fitting rule wins.

Defined cases: a null URL or one without ``://`` has an empty host and path, no canonical form and is allowed; repeated
URLs and repeated list entries are judged each, resp. listed once; an empty list allows everything that no rule blocks;
extra columns of the input are kept (names used here are overwritten).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, read, stored

#: (verdict, rule): a host and a path prefix.
Rules = Sequence[tuple[str, str]]

CONTRACT_RULES: Rules = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Query parameters that do not choose the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Words in a host that put the URL on the query's list.
LISTED_HOSTS = r"spam|pills|casino|track"

_SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a final slash, sorted query without tracking parameters; no scheme, no fragment. Null without a host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """The longest of ``rules`` that fits, as text; null if none does. Rules are a short parameter, not a table."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        out = F.when(fits, rule).otherwise(out)
    return out


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key)
    block = F.shiftrightunsigned(h, 32) % F.lit(blocks)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    bit = [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in (x >> 1 | 1 for x in _SALTS)]
    return block, [F.call_function("shiftleft", F.lit(1).cast("int"), b) for b in bit]


def bloom_blocks(listed: DataFrame, bits_per_url: int = 16, max_blocks: int = 1 << 18) -> tuple[DataFrame, int]:
    """The filter of ``listed.canonical`` as rows (block, w0 .. w7), and its number of blocks."""
    blocks = max(1, min(max_blocks, math.ceil(listed.count() * bits_per_url / 256)))
    block, bits = _block_and_bits(F.col("canonical"), blocks)
    rows = listed.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]), blocks


def judge(pages: DataFrame, listed: DataFrame, rules: Rules = (), url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, listed (boolean: an exact hit of the list).

    ``listed`` has a column canonical (see ``canonical_url``).
    """
    listed = stored(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    bloom, blocks = bloom_blocks(listed)
    host, path = url_host(F.col(url)), url_path(F.col(url))
    new = ("host", "path", "rule", "verdict", "listed", "canonical", "_block", "_maybe")
    base = pages.select(*[c for c in pages.columns if c not in new], host.alias("host"), path.alias("path"), canonical_url(F.col(url)).alias("canonical"))
    block, bits = _block_and_bits(F.col("canonical"), blocks)
    # the filter has at most max_blocks rows of eight ints
    met = base.withColumn("_block", F.when(F.col("canonical").isNotNull(), block).otherwise(F.lit(-1))).join(F.broadcast(bloom.withColumnRenamed("block", "_block")), "_block", "left")
    maybe = F.lit(True)
    for i, b in enumerate(bits):
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(b) != 0)
    met = met.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("_block", *[f"w{i}" for i in range(8)])
    hits = met.where("_maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = hits.unionByName(met.where("not _maybe").withColumn("listed", F.lit(False)))
    out = out.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    says = F.when(F.col("listed"), "block").otherwise("allow")
    for verdict, rule in rules:
        says = F.when(F.col("rule") == rule, verdict).otherwise(says)
    return out.withColumn("verdict", says).drop("_maybe")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the contract's rules and the canonical URLs of the hosts with a listed word."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_host(F.col("url")).rlike(LISTED_HOSTS)).select(canonical_url(F.col("url")).alias("canonical"))
    return judge(pages, listed, CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


OP1_SQL = r"""
WITH b AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q
  FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM b),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, 'spam|pills|casino|track'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict,
  canonical, coalesce(canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL), false) AS listed
FROM c
"""
