"""Sharding by a Feistel permutation over global row numbers.

Every row gets its number in the order of the key columns. A keyed Feistel network permutes the numbers
``0 .. n-1``; where it lands outside that range it is applied again (cycle walking). The permuted number ``p``
gives the shard ``p mod shards`` and the slot ``p div shards``, so shard sizes differ by one row at most, slots
are gapless, and place and number can be computed from each other without reading any data.

The network works on ``Z_a x Z_b`` with ``a * b`` barely over ``n`` (less than ``a`` numbers too many), so
walks are short: an orbit can visit each of the surplus numbers once at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys of the rounds; another seed is another permutation.
ROUNDS = 4
#: A walk longer than this has a chance below n ** -16 for large n; it raises an error and never gives a wrong place.
WALKS = 32


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, math.ceil(n / a))


def round_keys(seed: int) -> list[int]:
    return [seed * 1_000_003 + i for i in range(ROUNDS)]


def permuted(row_no: Column, n: int, seed: int) -> Column:
    """The place of ``row_no`` under the permutation of ``0 .. n-1`` that belongs to ``seed``."""
    a, b = sides(n)
    walks = min(WALKS, a * b - n) + 1
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def turn(acc: Column, step: Column) -> Column:
        even = F.pmod(step, F.lit(2)) == 0
        key = F.get(keys, F.pmod(step, F.lit(ROUNDS)))
        left = F.when(even, F.pmod(acc["l"] + F.pmod(F.xxhash64(key, acc["r"]), F.lit(a)), F.lit(a))).otherwise(acc["l"])
        right = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(F.xxhash64(key, acc["l"]), F.lit(b)), F.lit(b)))
        landed = (F.pmod(step, F.lit(ROUNDS)) == 0) & (step > 0) & (acc["l"] * b + acc["r"] < n)
        return F.when(acc["done"] | landed, F.struct(acc["l"].alias("l"), acc["r"].alias("r"), F.lit(True).alias("done"))).otherwise(
            F.struct(left.alias("l"), right.alias("r"), F.lit(False).alias("done"))
        )

    start = F.struct(
        F.floor(row_no / F.lit(b)).cast("long").alias("l") if b > 1 else row_no.cast("long").alias("l"),
        F.pmod(row_no, F.lit(b)).cast("long").alias("r"),
        F.lit(False).alias("done"),
    )
    steps = F.sequence(F.lit(0).cast("long"), F.lit(walks * ROUNDS - 1).cast("long"))
    end = F.aggregate(steps, start, turn, lambda acc: acc["l"] * b + acc["r"])
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("Feistel walk too long: choose another seed")).cast("long"))


def shard_rows(keys: DataFrame, order: list[str], shards: int, seed: int = 7) -> DataFrame:
    """Append ``row_no``, ``shard`` and ``slot`` to the narrow table ``keys``.

    keys: the columns that identify a row (not the texts; join them afterwards, or write by shard).
    Nulls in the order columns come first. Rows equal in every order column are interchangeable, so a repeated
    row gets a place of its own and the set of places stays the same. An empty table gives an empty table. Texts never
    come here, only their sizes, so long ones cost no more. Other columns are kept; row_no, shard, slot and names that
    begin with an underscore are the operator's own.
    """
    keys = common.stored(keys, "shard-keys")
    out, n = common.numbered(keys, order, keys.count())
    if not n:
        return out.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    place = out.withColumn("_place", permuted(F.col("row_no"), n, seed))
    return place.select(
        *out.columns,
        F.pmod(F.col("_place"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"),
    ).drop("_place")
