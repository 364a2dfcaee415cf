"""Sharding by a Feistel permutation with cycle walking over global row numbers. Native."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import numbered, utf8_size

ROUNDS = 4


def radices(n: int) -> tuple[int, int]:
    """The two digits of the permuted domain: at least ``n`` numbers, fewer than sqrt(n) + 1 more."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of a Feistel network over pairs (left, right) in mixed radix: a bijection of 0..a*b-1."""
    a, b = radices(n)
    left, right = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
    for i in range(ROUNDS):
        left = (left + F.pmod(F.xxhash64(F.lit(f"{seed}/{i}/l"), right), F.lit(a))) % F.lit(a)
        right = (right + F.pmod(F.xxhash64(F.lit(f"{seed}/{i}/r"), left), F.lit(b))) % F.lit(b)
    return left * F.lit(b) + right


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of ``row`` under a permutation of 0..n-1: walk the cycle until it is below ``n`` again.

    The domain has at most sqrt(n) surplus numbers, so a walk of more than one step has odds of about
    1/sqrt(n) each; up to 4,096 rows the steps cover every surplus number, and beyond, 64 steps that all
    miss would need odds under 64**-64. Were that to happen the query fails rather than return a wrong place.
    """
    a, b = radices(n)
    steps = max(1, min(64, a * b - n))
    once = feistel(row, n, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda x, _: F.when(x < n, x).otherwise(feistel(x, n, seed)))
    held = F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return F.when(once < n, once).otherwise(held)


def shards(df: DataFrame, order: list[str], n_shards: int, seed: int = 7) -> DataFrame:
    """``df`` with ``row``, ``place``, ``shard`` and ``slot``; shard sizes differ by one row at most.

    Row numbers follow ``order`` ascending (nulls first); equal rows take successive numbers. A row's place
    is the permuted row number, its shard ``place mod n_shards`` and its slot ``place div n_shards``, so
    both can be computed from the row number, the row count and the seed alone, and slots are gapless from
    0 in each shard. An empty table gives no rows. Columns called row, place, shard or slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows, n = numbered(df.drop("row", "place", "shard", "slot"), order)
    at = rows.withColumn("place", permuted(F.col("row"), n, seed))
    return at.withColumns({"shard": (F.col("place") % n_shards).cast("int"), "slot": F.floor(F.col("place") / n_shards).cast("long")})


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """Every document's size, checksum, shard and slot. A null text has no bytes and checksum 0."""
    facts = docs.select(
        "doc_id",
        (utf8_size(F.col("text")) + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = shards(facts, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
