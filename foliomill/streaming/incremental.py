"""Incremental ingestion of new files with Structured Streaming (additions only; changes and removals need a snapshot diff)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomill.sources.files import decode


def ingest_new_files(spark: SparkSession, root: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Decode every file below ``root`` that no earlier call has seen and hand each batch to ``sink``; returns when all are done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: sink(decode(batch), number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
