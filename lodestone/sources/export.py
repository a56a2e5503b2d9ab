"""Parsed documents and chunk texts as plain files by document, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import PAGES


def save_processed(parsed: DataFrame, folder: str) -> None:
    """Write (document_id, pages) as JSON, a folder a document; documents written again are replaced."""
    parsed.select("document_id", "pages").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("document_id").json(folder)


def load_processed(spark: SparkSession, folder: str, *documents: str) -> DataFrame:
    """(document_id, pages) of the named documents, all if none are named; only their folders are read."""
    got = spark.read.schema(f"document_id string, pages {PAGES}").json(folder)
    return got.where(F.col("document_id").isin(list(documents))) if documents else got


def save_chunk_texts(chunks: DataFrame, folder: str) -> None:
    """Write the contents of (document_id, chunk_id, content) as text, a folder a document and chunk."""
    name = F.regexp_replace("chunk_id", "[^A-Za-z0-9._-]", "_").alias("chunk")
    chunks.select("document_id", name, F.coalesce("content", F.lit("")).alias("value")).write.option("lineSep", "\n").mode("overwrite").partitionBy("document_id", "chunk").text(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
