"""Incremental cleaning: new raw booking files are picked up, cleaned and added to the clean table, each exactly once.

This replaces a periodic full reload.  The stream carries file names only; each batch reads its files as the batch reader does, split
into many tasks and bound by each file's own header.  Which files a batch holds is fixed in the checkpoint folder before it runs, and a
batch is stored in folders of its own that a repeated attempt replaces, so a batch that failed half-way counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wayledger.operators.clean import clean_bookings
from wayledger.sources.bookings import SourceTableError, read_bookings_csv, write_clean

#: Files of one batch; their names pass through the driver, as any listing of files does.
BATCH_FILES = 1000


def new_files(spark: SparkSession, path: str, files: int = BATCH_FILES) -> DataFrame:
    """A stream of the names of files that arrive in a folder; their content is not read."""
    listing = "path string, modificationTime timestamp, length long, content binary"  # what this format always has
    return spark.readStream.format("binaryFile").schema(listing).option("maxFilesPerTrigger", files).load(path).select("path")


def batch_name(spark: SparkSession, batch: int) -> str:
    """Name of a batch that no other stream gives, the same at every attempt."""
    stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
    return f"{stream}-{batch:010d}"


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    line_breaks: str = "refuse",
    clean: Callable[[DataFrame], DataFrame] = clean_bookings,
) -> StreamingQuery:
    """Clean everything that arrived in ``source`` since the last run and store it in ``target``, then stop.

    ``target`` may hold a full load and stays readable by ``read_clean``.  A batch of files without a single row stores nothing."""

    def store(batch: DataFrame, number: int) -> None:
        names = [row.path for row in batch.collect()]
        try:
            raw = read_bookings_csv(batch.sparkSession, names, line_breaks)
        except SourceTableError as error:
            if "has no rows" not in str(error):
                raise
            return
        write_clean(clean(raw), target, batch_name(batch.sparkSession, number))

    return (
        new_files(spark, source)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
