"""The indexing pipeline: scan, compare, parse, cut, embed, store; only what changed is written.

A store is a folder of append-only Parquet tables, partitioned by project. A
run writes the symbols and chunks of the changed files first and their rows of
``files`` last; those rows are the commit. What a file holds is what its latest
row's run wrote, so a run that fails, or is run twice, leaves nothing behind
that is read, and readers never see half a file. ``compacted`` writes the
current state alone into a new store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.vectors import hash_embed
from corvane.operators import chunking, incremental, parsers
from corvane.plans.lineage import cut
from corvane.sources.files import scan

#: The columns of a store's tables; all but the cache are partitioned by project.
TABLES = {
    "files": "path string, language string, size_bytes bigint, line_count int, content_hash string, last_modified timestamp, deleted boolean, indexed_at timestamp, run string",
    "symbols": "path string, language string, line_start int, line_end int, kind string, name string, qualified_name string, visibility string, metadata map<string,string>, content string, summary_hash string, embedding array<float>, run string",
    "chunks": "path string, chunk_index int, line_start int, line_end int, token_count int, content string, embedding array<float>, run string",
    "cache": "content_hash string, embedding array<float>, cached_at timestamp",
}


class Store:
    """The tables of an index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """All that was ever written to a table."""
        schema = TABLES[name] + ("" if name == "cache" else ", project_id string")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Write rows, in the table's columns."""
        columns = [c.split(" ")[0] for c in TABLES[name].split(", ")]
        if name == "cache":
            rows.select(columns).write.mode("append").parquet(f"{self.folder}/{name}")
        else:
            rows.select(*columns, "project_id").write.mode("append").partitionBy("project_id").parquet(f"{self.folder}/{name}")

    def files(self) -> DataFrame:
        """The latest row of every file that is there."""
        order = Window.partitionBy("project_id", "path").orderBy(F.desc("indexed_at"), F.desc("run"))
        return self.read("files").withColumn("_r", F.row_number().over(order)).filter("_r = 1 and not deleted").drop("_r")

    def current(self, name: str) -> DataFrame:
        """The rows of ``symbols`` or ``chunks`` that the files' latest runs wrote."""
        return self.read(name).join(self.files().select("project_id", "path", "run"), ["project_id", "path", "run"], "left_semi")


def index_tree(spark: SparkSession, root: str, project_id: str, store: Store, provider: Callable[[list[str]], list[list[float] | None]] | None = None) -> dict[str, int]:
    """Index a source tree; see :func:`index_files`."""
    return index_files(scan(spark, root, project_id), store, provider)


def index_files(files: DataFrame, store: Store, provider: Callable[[list[str]], list[list[float] | None]] | None = None, whole: bool = True) -> dict[str, int]:
    """Store what changed among scanned files; (changed, deleted) files are counted.

    Files whose hash is the stored one are left alone. With ``whole``, files
    that are stored but not scanned are deleted, else those without content.
    Each distinct text is embedded once, by ``provider`` if its embedding is
    not cached, without a provider by a deterministic stand-in. Files that a
    limit left out of the scan keep what is stored.
    """
    run, now = uuid.uuid4().hex, F.current_timestamp()
    seen = cut(files)
    there = seen.filter("content is not null")
    stored = cut(store.files())
    changed = cut(incremental.changed_files(there, stored))
    if whole:
        projects = seen.select("project_id").distinct()
        gone = stored.join(projects, "project_id", "left_semi").join(seen.select("project_id", "path"), ["project_id", "path"], "left_anti")
    else:
        gone = stored.join(seen.filter("content is null and left_out is null").select("project_id", "path"), ["project_id", "path"], "left_semi")
    n, lost = changed.count(), gone.count()
    if n:
        keyed = changed.withColumn("path", F.struct("project_id", "path"))  # paths are unique within a project
        named = keyed.select(F.concat_ws("/", "path.project_id", "path.path").alias("path"), F.col("path").alias("of"), "content")
        symbols = parsers.parse(named).join(named.withColumn("lines", F.split("content", "\n")).select("path", "of", "content", F.size("lines").alias("n")), "path")
        symbols = symbols.withColumn("line_end", F.coalesce("line_end", "n")).withColumn("content", T.content_slice(F.col("content"), F.col("line_no"), F.col("line_end")))
        symbols = symbols.select("of.project_id", "of.path", "language", F.col("line_no").alias("line_start"), "line_end", "kind", "name", "qualified_name", "visibility", "metadata", "content", T.summary_hash(F.col("content")).alias("summary_hash"))
        symbols = symbols.withColumn("text", T.embed_text(F.col("kind"), F.col("qualified_name"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("content")))
        chunks = chunking.windows(changed.select("project_id", "path", "content")).withColumn("text", F.col("content"))
        for name, rows in (("chunks", chunks), ("symbols", symbols)):
            store.append(name, _embedded(cut(rows), store, provider).withColumn("run", F.lit(run)))
    if n or lost:
        kept = changed.withColumn("deleted", F.lit(False)).drop("content", "left_out")
        rows = kept.unionByName(gone.drop("indexed_at", "run").withColumn("deleted", F.lit(True)))
        store.append("files", rows.withColumns({"indexed_at": now, "run": F.lit(run)}))
    return {"changed": n, "deleted": lost}


def _embedded(rows: DataFrame, store: Store, provider: Callable[[list[str]], list[list[float] | None]] | None) -> DataFrame:
    """Rows with the embedding of their ``text``; new embeddings are added to the store's cache."""
    if provider is None:
        return rows.withColumn("embedding", hash_embed(F.col("text")).cast("array<float>"))
    cache = cut(store.read("cache"))
    filled = cut(incremental.fill_cache(rows, cache, provider))
    store.append("cache", filled.join(cache.select("content_hash"), "content_hash", "left_anti"))
    return incremental.cache_lookup(rows, filled).drop("content_hash", "hit")


def compacted(store: Store, folder: str) -> Store:
    """The current state alone, in a new store."""
    out = Store(store.spark, folder)
    for name in ("chunks", "symbols"):
        out.append(name, store.current(name))
    out.append("files", store.files())
    out.append("cache", store.read("cache").dropDuplicates(["content_hash"]))
    return out
