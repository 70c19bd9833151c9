"""Continuous ingestion of a folder of documents with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.store import Store
from quire.sources import files, router


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Index files as they appear; each micro-batch replaces its documents in the store, so that a batch
    that runs again changes nothing."""

    def index(batch: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        resources = batch.where(files.extension(F.col("path")).isin(*files.MEDIA_TYPES)).select(
            F.col("path").alias("source"), files.media_type_of(F.col("path")).alias("media_type"), F.col("content").alias("bytes"),
            F.create_map(F.lit("file_name"), name, F.lit("file_stem"), F.regexp_replace(name, r"\.[^.]+$", "")).alias("metadata"),
        )
        if not batch.isEmpty():
            store.put(router.parse(resources))

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
