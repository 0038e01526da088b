"""Packages arriving in a drop folder: import each micro-batch, refresh the versions it touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from duelstats.plans.store import Store
from duelstats.session import release
from duelstats.sources.packages import PATTERN, numbered, placed_lines


def arriving(spark: SparkSession, folder: str, pattern: str = PATTERN, files_per_batch: int | None = None) -> DataFrame:
    """Stream of package lines with the file and split they come from. A file always falls into one micro-batch."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return placed_lines(reader.load(folder))


def ingest(
    spark: SparkSession,
    folder: str,
    store_root: str,
    checkpoint: str,
    refresh: Callable[[Store, int], None] | None = None,
    pattern: str = PATTERN,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Import everything that has arrived, then stop; run again (or schedule) for what arrives later.

    Files are taken once by the stream's checkpoint; content is taken once by the registry, over any distance in
    time. A batch that is retried replaces its own partitions. ``refresh(store, generation)`` runs after every batch that
    changed matches; ``store.state.changes(generation)`` names the versions and buckets it touched, so that only their
    results are written anew (``VersionBoards.refresh``). Late matches count like any others.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        store = Store(spark, store_root)
        before = store.state.heads().generation
        lines = numbered(batch)
        store.add(lines, batch_id)
        release(lines)
        after = store.state.heads().generation
        if refresh is not None and after > before:
            refresh(store, after)

    stream = arriving(spark, folder, pattern, files_per_batch)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
