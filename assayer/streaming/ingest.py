"""Ingestion as a stream: the batch rules over files as they arrive.

The state is the trace table itself. A micro-batch numbers the lines of its files as the batch
reader does, keeps the first row of each trace by file and line, leaves out what is stored, and
commits its dead letters and its traces in one change, which is named by the batch: a batch that
runs again after a failure finds its name and stores nothing twice. Traces that another writer stores
meanwhile are left out before the change is put.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.functions.shared import forget, written
from assayer.plans.store import Catalog
from assayer.sources.traces import IngestError, first_wins, numbered, parsed, rejects, valid


def stream_traces(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts ingesting the text files of a folder into the catalog's traces and rejects.

    Files arrive whole: a file's lines are in one batch. Bytes that aren't UTF-8 stop the query,
    and nothing of their batch is stored.
    """
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def write(batch: DataFrame, number: int) -> None:
        name = f"stream-{number}"
        if catalog.has("traces", name):
            return
        read = written(numbered(batch), "stream-lines")
        if not read.filter(~F.is_valid_utf8("value")).isEmpty():
            raise IngestError(f"batch {number} isn't UTF-8")
        rows = written(parsed(read), "stream-rows")
        with catalog.change() as change:
            change.add("rejects", rejects(rows))
            change.first("traces", "trace_id", first_wins(valid(rows)))
            change.name("traces", name)
        for used in (read, rows):
            forget(used)

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind; events later than the watermark are left out. Batch or stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
