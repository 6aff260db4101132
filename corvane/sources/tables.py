"""Reading the tables of a code index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; filters and column pruning reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def delivered(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """:func:`table` with ``_delivery``, the place at which each row is stored (file, row)."""
    return table(spark, folder, name).select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("_delivery"))


def latest(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """One row per key: that with the greatest ``order`` columns, nulls first; equal rows are one.

    Deliveries of one record share its key. Ties in ``order`` between unequal
    rows are broken by a hash of the ``tie`` columns (all by default), so the
    result is the same on every run; all of them are read for that, so select
    what is needed first. Rows with a null key form one group.
    """
    keys = keys or ["id"]
    order = order or [c for c in ("updated_at", "inserted_at") if c in df.columns]
    by: list[Column] = [F.col(c).desc_nulls_last() for c in order]
    flat = tie if tie is not None else [c for c, kind in df.dtypes if "map<" not in kind]
    if flat or not by:
        by.append(F.xxhash64(*(flat or keys)))
    window = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def current(df: DataFrame, *columns: str, key: str | list[str] = "id") -> DataFrame:
    """The key and ``columns`` of the latest delivery of each key; no other columns but those that order deliveries are read."""
    keys = [key] if isinstance(key, str) else key
    order = [c for c in ("updated_at", "inserted_at") if c in df.columns]
    wanted = df.select(*keys, *columns, *[F.col(c).alias(f"_by_{c}") for c in order])
    return latest(wanted, keys, [f"_by_{c}" for c in order] or keys).drop(*[f"_by_{c}" for c in order])


def hash128(text: Column) -> Column:
    """128 bits that stand for a text: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
