"""Arriving documents and events as streams: deduplicated against the history, chunked, stored per micro-batch; windows with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import chunk_hash
from ..operators import chunking
from ..session import shared_root
from ..store import Store


def stage_documents(docs: DataFrame) -> DataFrame:
    """Accepted documents as pages, with the digest of their text; blank texts are left out."""
    own = docs.where("text is not null and doc_id is not null")
    return own.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("file_name", F.lit("unnamed")).alias("filename"), F.lit(1).alias("page_number"), chunk_hash(F.col("text")).alias("digest"), "tenant_id", chunking.line_blocks(F.col("text")).alias("blocks"))


def unseen(pages: DataFrame, history: DataFrame | None) -> DataFrame:
    """The first record of each tenant and digest of a batch, if the ``history`` (tenant_id, digest) does not have it."""
    first = F.row_number().over(Window.partitionBy("tenant_id", "digest").orderBy("document_id"))
    own = pages.withColumn("n", first).where("n = 1").drop("n")
    if history is None:
        return own
    h = history.select(F.col("tenant_id").alias("t"), F.col("digest").alias("d")).distinct()
    return own.join(h, F.col("tenant_id").eqNullSafe(F.col("t")) & (F.col("digest") == F.col("d")), "left_anti")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1, cancelled: DataFrame | None = None, seconds: int | None = None) -> bool:
    """Run a stream over all files of ``source`` to its end, or for so many seconds; whether it came to its end.

    Each micro-batch writes its sections and digests under its own number, replacing what a failed attempt left, so that a
    batch counts once; its history are the digests of the batches before it. ``cancelled`` (document_id) are left out.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        pages = stage_documents(batch)
        if cancelled is not None:
            pages = pages.join(cancelled, "document_id", "left_anti")
        history = own.read.parquet(f"{target}-digests").where(F.col("batch") < number) if number else None
        digests = f"{target}-digests/batch={number}"
        unseen(pages, history).select("document_id", "tenant_id", "digest").write.mode("overwrite").parquet(digests)
        kept = pages.join(own.read.parquet(digests).select("document_id"), "document_id", "left_semi")
        sections = chunking.sections(kept).join(kept.select("document_id", "tenant_id"), "document_id")
        sections.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if seconds is None:
        query.awaitTermination()
        return True
    done = query.awaitTermination(seconds)
    if not done:
        query.stop()
    return done


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all different documents of each tenant by way of the stream."""
    at = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4).write.parquet(f"{at}/in")
    ingest(spark, f"{at}/in", f"{at}/out", f"{at}/state", 2)
    return spark.read.parquet(f"{at}/out").select("tenant_id", "content_hash", "section", "hierarchy_path")


def windowed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per type in tumbling ten-minute windows; of a stream, windows older than the watermark are closed."""
    kind = events.schema["ts"].dataType  # a watermark needs times with a zone
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").cast(kind).alias("start"), "event_type", "n", "total")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all events by way of a stream: each batch stores the windows it changed, a read takes the last of each."""
    at = f"{shared_root(spark)}/windows-{uuid.uuid4().hex}"
    source = f"{at}/in"  # a stream reads folders
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(source)
    store = Store(spark, at)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = windowed(stream).writeStream.outputMode("update").foreachBatch(lambda batch, number: store.append("windows", batch)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read("windows", "start", "event_type").select("start", "event_type", "n", F.round("total", 4).alias("total"))
