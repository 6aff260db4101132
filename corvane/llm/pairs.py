"""Pairs of items that share a key, in tasks of bounded size however many items a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a key that meet each other in one place; those of a larger key are spread over pairs of blocks of so many.
BLOCK = 1000


def sized(keyed: DataFrame, key: str) -> DataFrame:
    """(``key``, n): how many rows each key of two or more has, counted with partial counts before the shuffle."""
    return keyed.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def sharing(keyed: DataFrame, key: str, item: str, block: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: every pair of items that share a key; ``keyed`` has distinct rows (``key``, ``item``). ``sizes`` has the keys to go by, if not all, as :func:`sized` gives them.

    Keys of one item are left out before anything meets. A key of over
    ``block`` items is cut into blocks by a hash of the item, and each pair of
    blocks is a join key of its own, so no task holds more than two blocks of a
    key and no pair is lost or found in two places.
    """
    block = block or BLOCK
    sizes = (sized(keyed, key) if sizes is None else sizes).select(key, F.ceil(F.col("n") / block).cast("int").alias("_blocks"))
    held = keyed.join(sizes, key).withColumn("_own", F.when(F.col("_blocks") > 1, F.pmod(F.xxhash64(item, key), "_blocks")).otherwise(0).cast("int"))
    held = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = held.select(key, F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "_own", item)
    one, two = placed.toDF("k", "l", "h", "own_a", "a"), placed.toDF("k", "l", "h", "own_b", "b")
    met = one.join(two, ["k", "l", "h"]).filter("a < b and (l = h or own_a <> own_b)")
    return met.select("a", "b").distinct()
