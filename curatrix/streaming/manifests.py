"""Manifests as a stream of files into the catalog: what is taken in is what a batch would take in, once each.

A micro-batch is the files that have arrived, by name; its commit names the exports that it has merged. A micro-batch that is
repeated after a failure finds them in the ledger, so between the commit and the stream's own checkpoint nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from curatrix.plans.commands import ATTEMPTS, Catalog, Conflict, ingest_files


def ingest_stream(c: Catalog, folder: str, checkpoint: str, most: int = 1000, interval: str | None = None) -> StreamingQuery:
    """Take in the JSON files of a folder as they arrive, most of them at once; without an interval what is there now, and stop."""
    files = c.spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", most).load(folder)

    def take(batch: DataFrame, epoch: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").collect())  # most at once
        for attempt in range(ATTEMPTS):
            try:
                if paths:
                    ingest_files(c, paths)
                return
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise

    writer = files.select("path").writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
