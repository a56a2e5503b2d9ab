"""Helpers shared by the training-data operators: table access, shared-folder tables, Arrow plumbing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; fails off local mode where ``spark.checkpoint.dir`` is unset."""
    return shared_root(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back (survives the loss of executors)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def list_array(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from the flattened values and the length of each list."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=ends[1:])
    if len(flat) < 2**31:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, type=kind))
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece stay near ``most_bytes``; a single longer text forms its own piece."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def tokenizer_dir() -> str:
    """Where the vocabulary files of the public tokenizers lie; they are read there and never copied."""
    return os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
