"""URL filters: host and path rules, then a blocked Bloom filter whose possible hits an exact join confirms."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.store import write_table
from sieveworks.llm.text import lower_ascii

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
WORDS_A_BLOCK = 8
BITS_A_KEY = 16
#: The filter is sent to every executor only up to this size; beyond it, pages and blocks meet in a shuffle.
BROADCAST_BYTES = 8 << 20


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading www., path without trailing slashes, query without tracking parameters, no scheme or
    fragment. Null for null and for what has no ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^&=]*|ref|gclid|fbclid)(=[^&]*)?", ""), "^&+", "")
    site = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(
        url.contains("://"),
        F.concat(site, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")),
    )


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Equally long rules: the longer host wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, on, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bit(key: Column, i: int) -> Column:
    """The one bit that a key sets in word i of its block."""
    spread = F.xxhash64(key, F.lit("bits"))
    return F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(spread, 5 * i).bitwiseAND(F.lit(31)).cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def build_filter(listed: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(rows of block, w0 .. w7; the number of blocks). Each key sets one bit in each of the eight 32-bit words of one block."""
    blocks = max(1, ceil(n_keys * BITS_A_KEY / (32 * WORDS_A_BLOCK)))
    bits = [F.bit_or(_bit(F.col(key), i)).alias(f"w{i}") for i in range(WORDS_A_BLOCK)]
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*bits), blocks


def listed_rows(rows: DataFrame, key: str, listed: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean flag: whether their key is in listed (its column of that name; nulls and repeats are ignored).

    The Bloom filter lets go of most rows by a join with its blocks; only possible hits meet the list itself, so
    a row that is not listed never gets true. A null key gets false; an empty list gives false for all."""
    own = write_table(listed.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), "url-list")
    filter_rows, blocks = build_filter(own, key, own.count())
    if blocks * (WORDS_A_BLOCK * 4 + 8) <= BROADCAST_BYTES:
        filter_rows = F.broadcast(filter_rows)
    names = [f"__w{i}" for i in range(WORDS_A_BLOCK)]
    filter_rows = filter_rows.toDF("__block", *names)
    hit = F.lit(True)
    for i, w in enumerate(names):
        hit = hit & (F.col(w).bitwiseAND(_bit(F.col(key), i)) != 0)
    # Null keys are in no block; they are spread over places that no block has.
    nowhere = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    probed = rows.withColumn("__block", F.when(F.col(key).isNull(), nowhere).otherwise(_block(F.col(key), blocks))).join(filter_rows, "__block", "left")
    probed = probed.withColumn("__maybe", F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("__block", *names)
    exact = own.select(F.col(key).alias("__listed"))
    possible = probed.where("__maybe").join(exact, F.col(key) == F.col("__listed"), "left")
    sure = probed.where("NOT __maybe").withColumn("__listed", F.lit(None).cast("string"))
    return possible.unionByName(sure).withColumn(flag, F.col("__listed").isNotNull()).drop("__maybe", "__listed")


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict.

    The longest fitting rule decides; where none fits, a page whose canonical URL is in listed (column canonical) is
    blocked, others are allowed. A null url, or one without ://, has empty host and path, no rule, and is allowed.
    Repeated rows are judged alike, very long urls whole; columns of pages that have the names of the results are
    replaced, others are kept, whatever their names. An empty table gives an empty result."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own = F.col(f"`{url}`")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"), host_of(own).alias("host"), path_of(own).alias("path"), canonical(own).alias("canon"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    judged = listed_rows(rows, "canon", listed.select(F.col("canonical").alias("canon")), "hit")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    return judged.select("page.*", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
