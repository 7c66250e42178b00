"""Joins whose keys may be held by a large share of the rows, and a sieve that thins rows before a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fits_broadcast

#: A key with more than one HOT-th of all rows counts as hot; fewer than HOT keys can be.
HOT = 200
#: Bits of a sieve: its table has at most a 64th as many rows of two numbers, whatever the data.
SIEVE_BITS = 1 << 23


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and, as ``size``, the key's number of rows.

    Null keys equal null. Hot keys are joined by broadcast: there are fewer than HOT of them, whatever
    the data, and their rows must have a bounded size. Every other key holds too few rows to unbalance
    the shuffle join. Both sides are read two or three times, so they should be written tables or plain
    scans; ``size`` is dropped.
    """
    total = rows.count() if total is None else total
    hot = F.col("size") * HOT > total
    few, many = groups.where(hot).drop("size"), groups.where(~hot).drop("size")
    values = [f"g.{c}" for c in few.columns if c not in keys]

    def on(other: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys])

    by_broadcast = rows.alias("r").join(F.broadcast(few.alias("g")), on("g")).select("r.*", *values)
    cold = rows.alias("r").join(F.broadcast(few.select(*keys).alias("h")), on("h"), "left_anti")
    by_shuffle = cold.alias("r").join(many.alias("g"), on("g")).select("r.*", *values)
    return by_broadcast.unionByName(by_shuffle)


def join_small_or_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`join_groups`, or one broadcast where all of ``groups`` is small; the result is the same. Null keys match nothing."""
    if fits_broadcast(groups):
        return rows.join(F.broadcast(groups.drop("size")), keys)
    return join_groups(rows.where(" and ".join(f"{k} is not null" for k in keys)), groups, keys)


def sieved(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = SIEVE_BITS) -> DataFrame:
    """``rows`` without most of those whose key is not among ``wanted``; none that is wanted is lost.

    The wanted keys set bits of one fixed bitmap, which is broadcast as words of 64 bits; a row passes
    if its key's bit is set. So far fewer rows are shuffled by the exact join that must follow.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set"))
    at = rows.withColumn("_p", place).withColumn("word", F.shiftright("_p", 6))
    hit = F.expr("(shiftrightunsigned(`set`, cast(_p & 63 as int)) & 1L) = 1L")
    return at.join(F.broadcast(words), "word").where(hit).drop("_p", "word", "set")
