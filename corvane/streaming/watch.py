"""Re-indexing as a stream: file events are debounced per path, then batched.

Both are session windows over event time with a watermark, so late events
within it count and a restart goes on from the checkpoint. The same functions
run on static frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.parsers import supported
from corvane.plans.pipeline import Store, index_files
from corvane.sources.files import ignored, read_paths


def relevant(events: DataFrame) -> DataFrame:
    """Events (project_id, path, event, ts) that change a source file."""
    return events.filter(F.col("event").isin("modified", "created", "renamed") & supported(F.col("path")) & ~ignored(F.col("path")))


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", watermark) if events.isStreaming else timed


def debounce(events: DataFrame, keys: list[str], gap: str = "1500 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """(keys, events, first_ts, last_ts): one row per key and quiet period; events at most ``gap`` apart are one."""
    windowed = _timed(events, watermark).groupBy(*keys, F.session_window("ts", gap))
    return windowed.agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("session_window")


def batches(indexed: DataFrame, key: str = "path", gap: str = "3 seconds", watermark: str = "10 seconds", by: list[str] | None = None) -> DataFrame:
    """(by, first_ts, last_ts, paths): what was indexed without a pause of ``gap``, in order of arrival; ``by`` keeps the batches of projects apart, so that one project's flood is one group."""
    windowed = _timed(indexed, watermark).groupBy(*(by or []), F.session_window("ts", gap))
    rows = F.array_sort(F.collect_list(F.struct("ts", F.col(key).alias("k"))))
    return windowed.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_distinct(F.transform(rows, lambda r: r["k"])).alias("paths")).drop("session_window")


def shed(pending: DataFrame, most: int = 1000, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of a micro-batch's pending rows, those that came first kept; an explicit load limit, off unless called."""
    kept = pending.orderBy("ts", key).limit(most)
    return kept, pending.exceptAll(kept)


def events_of(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """The stream of file events (project_id, path, event, ts) that a watcher leaves as JSON lines in ``folder``; at most ``per_batch`` of its files at a time."""
    reader = spark.readStream.schema("project_id string, path string, event string, ts timestamp")
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).json(folder)


def re_index(events: DataFrame, roots: dict[str, str], store: Store, checkpoint: str, gap: str = "1500 milliseconds", watermark: str = "10 seconds") -> StreamingQuery:
    """Index what changes: relevant events, one per quiet period of a path, are read again and stored.

    Micro-batches follow each other, so a path that is being indexed is never
    indexed twice at once; what changes meanwhile is in a later batch. A batch
    that is run again after a failure finds its files unchanged and stores nothing.
    """
    quiet = debounce(relevant(events), ["project_id", "path"], gap, watermark)

    def index(batch: DataFrame, number: int) -> None:
        paths = batch.select("project_id", "path").distinct().persist()
        for project, root in roots.items():
            index_files(read_paths(paths.filter(F.col("project_id") == project).select("path"), root, project), store, whole=False)
        paths.unpersist()

    return quiet.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def publish(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Leave each batch's updated paths as JSON lines in ``folder``, written by the executors, for any number of subscribers to follow."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def notify(stream: DataFrame, subscriber: Callable[[list[str]], None], checkpoint: str) -> StreamingQuery:
    """Call ``subscriber`` on the driver with the paths of each batch, a partition at a time; for many subscribers see :func:`publish`."""

    def send(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            subscriber(list(row.paths))

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
