"""Incremental indexing: change detection, upserts, clean-up, caches, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of symbols and states of calls.
KINDS = "function method class module struct enum trait interface type macro constant variable test decorator mixin extension typedef impl resource data callback behaviour protocol record object job service widget section spec".split()
STATES = ["success", "error", "timeout"]


def changed_files(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` (project_id, path, content_hash, ...) whose hash differs from the stored one or that are not stored; a null hash on either side only equals null."""
    old = stored.select("project_id", "path", F.col("content_hash").alias("_old"), F.lit(True).alias("_there"))
    joined = new.join(old, ["project_id", "path"], "left")
    return joined.filter(F.col("_there").isNull() | ~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old", "_there")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys; of several new rows of a key the greatest counts.

    Columns in ``keep`` hold their old value where there is one.
    """
    order = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in ("updated_at", "inserted_at") if c in new.columns], F.xxhash64(*[c for c, t in new.dtypes if not t.startswith("map")]))
    last = new.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    if keep:
        held = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
        last = last.join(held, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).drop(*[f"_{c}" for c in keep])
    return old.join(last.select(*keys), keys, "left_anti").select(old.columns).unionByName(last.select(old.columns))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it does not hold, one per key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(old.columns))


def without_orphan_chunks(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks whose index is below their file's number of chunks (file_id, n); files that are not counted keep theirs."""
    return chunks.join(counts.select("file_id", "n"), "file_id", "left").filter(F.col("n").isNull() | (F.col("chunk_index") < F.col("n"))).drop("n")


def without_project(df: DataFrame, project: str) -> DataFrame:
    """A table without a project's rows."""
    return df.filter(~F.col("project_id").eqNullSafe(F.lit(project)))


def without_stale_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols without those whose bare qualified name has a sibling in the same file that ends with ``.name``, by an equi-join on file and last part."""
    tail = F.substring_index("qualified_name", ".", -1)
    full = symbols.filter(F.contains(F.col("qualified_name"), F.lit("."))).select("file_id", tail.alias("qualified_name")).distinct()
    bare = symbols.filter(F.col("qualified_name").isNotNull() & ~F.contains(F.col("qualified_name"), F.lit("."))).join(full, ["file_id", "qualified_name"], "left_semi").select("id")
    return symbols.join(bare, "id", "left_anti")


def needs_summary(symbols: DataFrame, force: bool = False) -> DataFrame:
    """Symbols whose summary is missing or made of other content."""
    if force:
        return symbols
    return symbols.filter(F.col("summary").isNull() | ~F.upper(F.md5("content")).eqNullSafe(F.upper("summary_hash")))


def pages(df: DataFrame, after: str | None = None, size: int = 50, key: str = "id") -> DataFrame:
    """A page of ``size`` rows in order of ``key``, those after ``after``; a set that shrinks meanwhile skips nothing."""
    return (df if after is None else df.filter(F.col(key) > after)).orderBy(key).limit(size)


def validate(df: DataFrame, required: list[str], allowed: dict[str, list[str]] | None = None, at_least_zero: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons): required columns, allowed values, no negative numbers."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    reasons += [F.when(~F.col(c).isin(values), F.lit(f"{c} is not allowed")) for c, values in (allowed or {}).items()]
    reasons += [F.when(F.col(c) < 0, F.lit(f"{c} is negative")) for c in at_least_zero or []]
    checked = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def cache_lookup(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Texts with their cached embedding and whether there is one; cached nulls count as none."""
    held = cache.filter(F.col("embedding").isNotNull()).select("content_hash", "embedding").dropDuplicates(["content_hash"])
    return texts.withColumn("content_hash", F.sha2(F.col(text), 256)).join(held, "content_hash", "left").withColumn("hit", F.col("embedding").isNotNull())


def fill_cache(texts: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[list[float] | None]], text: str = "text", batch: int = 48) -> DataFrame:
    """The cache with the embeddings of all missing texts, each distinct text once, from a provider called with ``batch`` texts at a time."""
    missing = cache_lookup(texts.select(text).distinct(), cache, text).filter("not hit").filter(F.col(text).isNotNull()).select("content_hash", F.col(text).alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            wanted, found = rows.column(1).to_pylist(), []
            for i in range(0, len(wanted), batch):
                found += provider(wanted[i : i + batch])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.float32()))], names=["content_hash", "embedding"])

    got = missing.mapInArrow(ask, "content_hash string, embedding array<float>").filter(F.col("embedding").isNotNull())
    now = F.lit(datetime.now(timezone.utc))
    return cache.select("content_hash", "embedding", "cached_at").unionByName(got.withColumn("cached_at", now))


def evict(cache: DataFrame, most: int = 50_000, share: float = 0.25) -> DataFrame:
    """A cache of over ``most`` rows without its oldest ``share``."""
    n = cache.count()
    if n <= most:
        return cache
    edge = cache.agg(F.percentile_approx("cached_at", share, 10_000).alias("t")).first().t
    return cache.filter(F.col("cached_at") > F.lit(edge))


def cache_stats(lookups: DataFrame) -> DataFrame:
    """(lookups, hits, misses) of looked-up texts."""
    return lookups.agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
