"""URL filter: blocked Bloom filter of listed canonical URLs, then an exact hash join.

The listed URLs are made canonical, and each sets eight bits in one 512-bit block
of a filter (eight 64-bit words, one bit in each). The filter is a table of blocks,
built by a bitwise-or aggregation, so it is built and probed like any other table.
URLs whose eight bits are all set are possible hits. Only they go on to an exact
hash join with the list, which removes the false positives; all others are known
not to be listed. A short table of host and path rules overrides the list.

Defined cases: a null url, or one without ``://``, has an empty host and path and is
never listed; an empty list or rule table lists nothing; repeated rows each get their
verdict; repeated list entries count once; hosts are compared with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that say how a reader came to a page, not which page it is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
WORDS = 8
BITS_PER_KEY = 16
#: Parts over which rows without a partner are spread.
SPREAD = 1 << 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a last slash, and the
    sorted query without tracking parameters; null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    )
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&")))
    return F.when(
        F.instr(url, "://") > 0, F.concat(host, path, F.coalesce(tail, F.lit("")))
    )


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _mask(key: Column, word: int) -> Column:
    """One bit of a 64-bit word, from a second hash of the key."""
    bits = F.xxhash64(key, F.lit(WORDS))
    place = F.shiftrightunsigned(bits, 8 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def build_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks ``(block, w0 .. w7)`` of the filter over the column ``key``."""
    masks = [_mask(F.col("key"), i).alias(f"w{i}") for i in range(WORDS)]
    return (
        listed.select(_block(F.col("key"), n_blocks).alias("block"), *masks)
        .groupBy("block")
        .agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
    )


def possible_hits(
    keyed: DataFrame, key: str, blocks: DataFrame, n_blocks: int, broadcast_bytes: int
) -> DataFrame:
    """``keyed`` with a boolean ``possible``: false means surely not listed.

    The filter is broadcast only while its full size, known from ``n_blocks``, is
    within ``broadcast_bytes``; a larger one is joined on the block number.
    """
    if n_blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    hit = F.lit(True)
    for i in range(WORDS):
        mask = _mask(quoted(key), i)
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    # Rows without a key are in no block, and not all in the same one.
    nowhere = -1 - F.pmod(F.xxhash64(*map(quoted, keyed.columns)), F.lit(SPREAD))
    place = F.coalesce(_block(quoted(key), n_blocks), nowhere)
    at = free_name(keyed, "at_block")
    return (
        keyed.withColumn(at, place)
        .join(blocks, F.col(at) == F.col("block"), "left")
        .withColumn("possible", F.coalesce(quoted(key).isNotNull() & hit, F.lit(False)))
        .drop(at, "block", *(f"w{i}" for i in range(WORDS)))
    )


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``(rule, verdict)`` of the longest fitting rule, or null.

    Of rules of one length the one with the longer host wins.
    """
    ordered = sorted(set(rules), key=lambda r: (-len(r.host + r.path), -len(r.host), r.host))
    fits = None
    for r in ordered:
        test = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    if fits is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return fits


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Rows ``id, host, path, rule, verdict, listed`` for every row of ``pages``.

    ``verdict`` is the longest fitting rule's; without one, ``block`` for a listed
    canonical URL and ``allow`` for any other.
    """
    keys = materialize(
        listed.select(canonical(quoted(listed_col)).alias("key"))
        .where("key IS NOT NULL")
        .distinct(),
        "listed",
    )
    n_blocks = max(1, -(-keys.count() * BITS_PER_KEY // (64 * WORDS)))
    blocks = materialize(build_filter(keys, n_blocks), "bloom")

    url = quoted(url_col)
    base = pages.select(
        quoted(id_col).alias("id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        canonical(url).alias("key"),
    )
    tested = possible_hits(base, "key", blocks, n_blocks, broadcast_bytes)
    # Only possible hits are looked up; all others are spread over the tasks.
    asked = tested.withColumns(
        {
            "probe": F.when(F.col("possible"), F.col("key")),
            "salt": F.when(F.col("possible"), F.lit(0).cast("long")).otherwise(
                1 + F.pmod(F.xxhash64("id", "host", "path", "key"), F.lit(SPREAD))
            ),
        }
    )
    entries = keys.select(F.col("key").alias("probe"), F.lit(0).cast("long").alias("salt"), F.lit(True).alias("found"))
    ruled = asked.join(entries, ["probe", "salt"], "left").withColumns(
        {
            "listed": F.coalesce("found", F.lit(False)),
            "by_rule": rule_for(F.col("host"), F.col("path"), rules),
        }
    )
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select(
        "id",
        "host",
        "path",
        F.col("by_rule.rule").alias("rule"),
        F.coalesce(F.col("by_rule.verdict"), method).alias("verdict"),
        "listed",
    )
