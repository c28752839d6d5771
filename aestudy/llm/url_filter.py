"""URL filter: host and path rules first, then a list of URLs behind a blocked Bloom filter.

Listed URLs are kept in canonical form. Each sets eight bits in one block of 256 bits, which its hash
names; the blocks are made by a distributed aggregation and broadcast, at most ``max_blocks`` of
them, a size that does not depend on the list. A page whose bits are all set is a possible hit, and
only possible hits are shuffled into the exact hash join with the list that removes the false ones.
A list too long for ``max_blocks`` makes more possible hits, never a wrong verdict.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has neither: no rule fits, it
is never listed, and so it is allowed. Repeated rows get a verdict each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, WORD_BITS = 4, 64
BITS_PER_KEY = 16
#: 2^20 blocks of 32 bytes: some 17 million listed URLs at 16 bits each; more only widen the exact join.
MAX_BLOCKS = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, pattern, 1), UPPER, LOWER), F.regexp_extract(known, pattern, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without trailing slashes; null where there is no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict: the longest of the (verdict, host, path) rules that fits, else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        chosen = F.when(fits, F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def masks_of(key: Column) -> list[Column]:
    """The key's bits in its block: two in each of four words."""
    bits = F.xxhash64(key, F.lit("bits"))
    words = []
    for w in range(WORDS):
        places = [F.shiftrightunsigned(bits, 12 * w + 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(2)]
        one = F.lit(1).cast("long")
        words.append(F.call_function("shiftleft", one, places[0]).bitwiseOR(F.call_function("shiftleft", one, places[1])))
    return words


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: one row per block that has a bit set."""
    masks = [m.alias(f"m{w}") for w, m in enumerate(masks_of(F.col(key)))]
    rows = listed.select(block_of(F.col(key), blocks).alias("block"), *masks)
    return rows.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) for every row of ``pages``.

    ``listed`` holds URLs in ``listed_col``; pages at a listed canonical URL are blocked unless a rule decides.
    """
    if max_blocks < 1:
        raise ValueError("the filter has at least one block")
    own_host, own_path = host_and_path(F.col(listed_col))
    keys = listed.select(canonical(own_host, own_path).alias("key")).where("key IS NOT NULL").distinct()
    n_keys = keys.count()
    blocks = min(max_blocks, max(1, -(-n_keys * BITS_PER_KEY // (WORDS * WORD_BITS))))

    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("fits", rule_for(F.col("host"), F.col("path"), rules)).withColumn("key", canonical(F.col("host"), F.col("path")))
    judged = judged.withColumn("block", block_of(F.col("key"), blocks))
    judged = judged.join(F.broadcast(bloom_blocks(keys, "key", blocks)), "block", "left")
    hits = [F.col(f"w{w}").bitwiseAND(m) == m for w, m in enumerate(masks_of(F.col("key")))]
    possible = F.col("fits").isNull() & F.coalesce(hits[0] & hits[1] & hits[2] & hits[3], F.lit(False))
    judged = judged.select("page_id", "host", "path", "fits", F.when(possible, F.col("key")).alias("key"))

    sure = judged.where("key IS NULL").select("page_id", "host", "path", "fits", F.lit(False).alias("hit"))
    exact = keys.select("key", F.lit(True).alias("hit")).hint("shuffle_hash")
    checked = judged.where("key IS NOT NULL").join(exact, "key", "left").select("page_id", "host", "path", "fits", F.coalesce("hit", F.lit(False)).alias("hit"))
    verdict = F.coalesce("fits.verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    return sure.union(checked).select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"))
