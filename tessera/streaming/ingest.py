"""Incremental ingest: a stream of documents whose texts were not seen before, and windowed run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import text_hash
from tessera.operators.dedup import first_of_each
from tessera.sources.sinks import path_exists


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest_new(stream: DataFrame, registry: str, output: str, checkpoint: str) -> StreamingQuery:
    """Appends each text once: a batch is deduplicated and anti-joined with the registry of hashes.

    A batch writes below its own number, so a batch that is run again replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = first_of_each(batch, text_hash(F.col("text")), F.col("doc_id")).withColumn("text_hash", text_hash(F.col("text")))
        if path_exists(spark, registry):
            known = spark.read.option("basePath", registry).parquet(registry)
            rows = rows.join(known.where(F.col("batch") != number).select("text_hash"), "text_hash", "left_anti")
        rows.write.mode("overwrite").parquet(f"{output}/batch={number}")
        spark.read.parquet(f"{output}/batch={number}").select("text_hash").write.mode("overwrite").parquet(f"{registry}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows, for batches and, with late rows dropped beyond the watermark, for streams."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
