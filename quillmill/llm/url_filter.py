"""URL filter: a blocked Bloom filter in front of an exact hash join.

A list has entries ``host + path prefix`` such as ``example.com/en/7``; an entry covers its host and all
subdomains, and every path that starts with the prefix. A URL is judged by its keys: each suffix of its host
with each prefix of its path as long as some listed prefix; the canonical form of an empty path is ``/``. Keys that the filter lets pass go to a join with
the list, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that decide, the longest first: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Canonical URLs of whole hosts that are blocked where no rule decides: each name under each domain.
LISTED_NAMES, LISTED_DOMAINS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("example.com", "example.net", "example.org")
LISTED = tuple(("block", f"{name}.{domain}", "/") for name in LISTED_NAMES for domain in LISTED_DOMAINS)
#: A block is 8 words of 32 bits, one bit a key in each; 64 MB of blocks at most, whatever the list's size.
WORDS, BITS_PER_KEY, MAX_BLOCKS = 8, 16, 1 << 21

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def entries(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """The list as a table (kind, verdict, host, path)."""
    rows = [("rule", *r) for r in rules] + [("listed", *r) for r in listed]
    return spark.createDataFrame(rows, "kind string, verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path up to ``?`` or ``#``; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, prefix_lengths: list[int]) -> Column:
    """All keys of a URL: its host's suffixes times its path's prefixes of the listed lengths."""
    labels = F.split(host, "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, prefix_lengths)), lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def bloom_filter(keys: DataFrame, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS):
    """The filter of column ``key`` as an array of blocks; made on the executors, at most ``max_blocks`` rows go to the driver."""
    import numpy as np

    blocks = min(max_blocks, max(1, -(-keys.count() * bits_per_key // (32 * WORDS))))
    h = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.xxhash64("key", F.lit(1)).alias("h"))
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {5 * i}) & 31 as int))")).alias(f"w{i}") for i in range(WORDS)]
    bits = np.zeros((blocks, WORDS), np.uint32)
    for row in h.groupBy("block").agg(*words).toLocalIterator():
        bits[row[0]] = row[1:]
    return bits


def passing(keys: DataFrame, bits) -> DataFrame:
    """The rows whose ``key`` may be listed."""
    import numpy as np

    shared, blocks = keys.sparkSession.sparkContext.broadcast(bits), len(bits)

    @F.pandas_udf("boolean")
    def maybe(places: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held = shared.value
        for block, h in places:
            b, x = block.to_numpy(), h.to_numpy().view(np.uint64)
            hit = np.ones(len(b), bool)
            for i in range(WORDS):
                hit &= (held[b, i] >> ((x >> np.uint64(5 * i)) & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
            yield pd.Series(hit)

    return keys.where(maybe(F.pmod(F.xxhash64("key"), F.lit(blocks)), F.xxhash64("key", F.lit(1))))


def judge_urls(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, listed.

    The longest rule that fits decides, the longer host on a tie; without one a ``listed`` entry decides, which
    takes an empty path for ``/``, and
    what is not listed is allowed. Null urls, and those without ``://``, have an empty host and path and are
    allowed. Repeated rows stay, other columns are ignored, an empty listing allows all. Of entries that repeat
    with other verdicts ``block`` wins.
    """
    spark = pages.sparkSession
    listing = listing.where("host is not null and path is not null").groupBy("kind", "host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", F.concat("host", "path"))
    lengths = sorted(r[0] for r in listing.select(F.length("path")).distinct().collect())  # at most as many as a path can have lengths
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    bits = bloom_filter(listing.select("key").distinct())
    canonical = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    keys = urls.select("host", "path").distinct().select("host", "path", F.explode(url_keys(F.col("host"), canonical, lengths)).alias("key"))
    rank = F.struct(F.length("key"), F.length("listing.host"), "verdict", "key")
    hits = passing(keys, bits).alias("urls").join(listing.alias("listing"), "key").where((F.col("kind") == "listed") | F.startswith("urls.path", "listing.path"))
    hits = hits.groupBy("urls.host", "urls.path").agg(F.max(F.when(F.col("kind") == "rule", rank)).alias("rule"), F.max(F.when(F.col("kind") == "listed", rank)).alias("listed"))
    judged = urls.join(hits, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("rule.key").alias("rule"), F.coalesce("rule.verdict", "listed.verdict", F.lit("allow")).alias("verdict"), F.col("listed.key").alias("listed"))
