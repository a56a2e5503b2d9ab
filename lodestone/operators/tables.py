"""Sinks as table operations: upserts, caches with expiry, the document graph, sink states, schema growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key, the latest; nulls come first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last()))
    return rows.withColumn("n", rank).where("n = 1").drop("n")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, changing: list[str]) -> DataFrame:
    """``existing`` with ``incoming`` merged in: on a key both have, only the ``changing`` columns are taken over."""
    new = incoming.select(key, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c != key], F.lit(True).alias("arrived"))
    old = existing.withColumn("there", F.lit(True))
    both = old.join(new, key, "full_outer")

    def pick(c: str) -> Column:
        if c in changing:
            return F.when(F.col("arrived"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("there"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c)

    return both.select(key, *[pick(c) for c in existing.columns if c != key])


def insert_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key isn't there yet, one each; to be appended."""
    return incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def alive(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def grow(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns with their type and default; what is there stays."""
    return rows.withColumns({c: F.lit(d).cast(t) for c, (t, d) in columns.items() if c not in rows.columns})


def graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, dst, type) of chunks (chunk_id, parent_id, document_id)."""
    c = chunks.select("chunk_id", "parent_id", "document_id").distinct()
    section, child = c.where("parent_id is null"), c.where("parent_id is not null")
    nodes = c.select(F.col("document_id").alias("id"), F.lit("Document").alias("label")).where("id is not null")
    nodes = nodes.unionByName(section.select(F.col("chunk_id").alias("id"), F.lit("Section").alias("label"))).unionByName(child.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label")))
    edges = section.where("document_id is not null").select(F.col("document_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_SECTION").alias("type"))
    held = child.join(section.select(F.col("chunk_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    edges = edges.unionByName(held.select(F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("CONTAINS_CHUNK").alias("type")))
    return nodes.distinct(), edges.distinct()


def supersede(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds SUPERSEDES edges for (new, old), each once."""
    return edges.unionByName(pairs.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.lit("SUPERSEDES").alias("type"))).distinct()


def cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the documents ``gone`` (id), their sections and chunks."""
    section = edges.where("type = 'HAS_SECTION'").join(gone.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    child = edges.where("type = 'CONTAINS_CHUNK'").join(section.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    out = gone.select("id").unionByName(section).unionByName(child).distinct()
    left = nodes.join(out, "id", "left_anti")
    kept = edges.join(out.select(F.col("id").alias("src")), "src", "left_anti").join(out.select(F.col("id").alias("dst")), "dst", "left_anti")
    return left, kept


def sink_state(flags: Column) -> Column:
    """COMPLETED if all sinks took the rows, PARTIAL if some did, else FAILED."""
    return F.when(F.forall(flags, lambda f: f), "COMPLETED").when(F.exists(flags, lambda f: f), "PARTIAL").otherwise("FAILED")
