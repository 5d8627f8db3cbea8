"""Incremental ingest: chart files as a stream, each micro-batch through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store

FILES = "path string, modificationTime timestamp, length long, content binary"


def chart_stream(spark: SparkSession, path: str) -> DataFrame:
    """chart_id, source_id, path, content of chart files as they come."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.osu").load(path)
    source = F.regexp_extract("path", r"/(\d+)\.osu$", 1).try_cast("long")
    return files.select(F.coalesce(source, F.xxhash64("path")).alias("chart_id"), source.alias("source_id"), "path", "content")


def ingest_stream(spark: SparkSession, path: str, store: Store, analyse: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Analyses what has come and adds it to the store, until no file is left.

    A batch that is run again after a failure adds nothing twice: the store goes by content.
    """

    def add(batch: DataFrame, _: int) -> None:
        fresh = store.pending(batch.withColumn("sha256", F.sha2("content", 256)))
        store.upsert_raw(analyse(fresh.drop("sha256")))

    return chart_stream(spark, path).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream (ts, event_type, value) by window and type; works on batches too."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
