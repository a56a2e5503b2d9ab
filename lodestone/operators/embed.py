"""Embedding with a cache: known texts are looked up, the rest is embedded once per different text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_hash, embedding_key, token_estimate_chars

SIZE = 64
Embedder = Callable[[list[str]], np.ndarray]


def feature_hashing(texts: list[str]) -> np.ndarray:
    """Deterministic stand-in for a model: signed hashed words, unit length."""
    import re
    from zlib import crc32

    out = np.zeros((len(texts), SIZE))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = crc32(w.encode())
            out[i, h % SIZE] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(out, axis=1)
    return out / np.where(n > 0, n, 1)[:, None]


def embed_texts(texts: DataFrame, embedder: Embedder = feature_hashing, batch: int = 32) -> DataFrame:
    """(content_hash, vector) of ``texts`` (content_hash, content), in batches of ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = embedder([t or "" for t in part.column(1).to_pylist()])
                if len(got) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts gave {len(got)} vectors")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.astype(np.float32).tolist(), pa.list_(pa.float32()))], ["content_hash", "vector"])

    return texts.select("content_hash", "content").mapInArrow(run, "content_hash string, vector array<float>")


def embed_mixed(chunks: DataFrame, embedder: Embedder = feature_hashing, image_embedder: Embedder | None = None, read: Callable[[str], bytes] | None = None) -> DataFrame:
    """(chunk_id, vector, way) of ``chunks`` (chunk_id, content, embedding_representation, image_path).

    Chunks represented by an image with a path go through the image model one by one, all others through the text model in
    batches; an image that fails is embedded by its text (way ``fallback``).
    """
    from .models import image_hashing, image_url

    images = image_embedder or image_hashing

    def opened(path: str) -> bytes:
        if read is not None:
            return read(path)
        with open(path, "rb") as f:
            return f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                ids, texts, kinds, paths = (c.to_pylist() for c in part.columns)
                vectors, way = [None] * len(ids), ["text"] * len(ids)
                for i, (kind, path) in enumerate(zip(kinds, paths)):
                    if kind == "image" and path:
                        try:
                            vectors[i], way[i] = images([image_url(path, opened(path))])[0], "image"
                        except Exception:
                            way[i] = "fallback"
                rest = [i for i, v in enumerate(vectors) if v is None]
                got = embedder([texts[i] or "" for i in rest]) if rest else []
                if len(got) != len(rest):
                    raise ValueError(f"{len(rest)} texts gave {len(got)} vectors")
                for i, v in zip(rest, got):
                    vectors[i] = v
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32())), pa.array(way)], ["chunk_id", "vector", "way"])

    return chunks.select("chunk_id", "content", "embedding_representation", "image_path").mapInArrow(run, "chunk_id string, vector array<float>, way string")


def probe(chunks: DataFrame, cache: DataFrame, model: str, version: str) -> DataFrame:
    """``chunks`` with content_hash, cache_key and the cached vector or null; ``cache`` has cache_key and vector."""
    keyed = chunks.withColumn("content_hash", F.coalesce("content_hash", chunk_hash(F.col("content"))))
    keyed = keyed.withColumn("cache_key", embedding_key(F.col("content_hash"), F.lit(model), F.lit(version)))
    return keyed.join(cache.select("cache_key", "vector").dropDuplicates(["cache_key"]), "cache_key", "left")


def embedded(chunks: DataFrame, cache: DataFrame, model: str, version: str, embedder: Embedder = feature_hashing) -> tuple[DataFrame, DataFrame]:
    """All chunks with a vector, and the new cache rows; each different text is embedded once."""
    seen = probe(chunks, cache, model, version)
    missing = seen.where("vector is null").select("content_hash", "content").dropDuplicates(["content_hash"])
    new = embed_texts(missing, embedder)
    filled = seen.join(new.withColumnRenamed("vector", "fresh"), "content_hash", "left")
    out = filled.withColumn("vector", F.coalesce("vector", "fresh")).drop("fresh")
    rows = new.select(embedding_key(F.col("content_hash"), F.lit(model), F.lit(version)).alias("cache_key"), "content_hash", F.lit(model).alias("model"), F.lit(version).alias("version"), "vector")
    return out, rows


def batch_tokens(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.sum(token_estimate_chars(F.col("content"))).alias("tokens"))
