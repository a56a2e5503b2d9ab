"""A stored search index: chunks once each, postings with their statistics, vectors and paths with their access columns.

What a query needs is computed when the index is built: each chunk once, the terms of all children, document frequencies and
lengths. A query then reads the postings of its own terms (the folder of a term's bucket, sorted by term), scores vectors of
its own tenants, and fetches contents for the few results. The channels give what the operators in ``search`` give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_terms
from . import search

BUCKETS = 16
#: Terms up to which a scan is told which ones it is for.
MOST_TERMS = 2000
ACCESS = ("tenant_id", "knowledge_base_id", "access_classification")


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._totals: tuple[int, float] | None = None
        self._frames: dict[str, DataFrame] = {}  # footers and folders are looked at once

    def read(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._frames[name]

    def _write(self, df: DataFrame, name: str, *by: str) -> None:
        self._frames.pop(name, None)
        out = df.write.option("compression", "zstd").mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{name}")

    def build(self, chunks: DataFrame, vectors: DataFrame) -> SearchIndex:
        """Index ``chunks``, each chunk_id once with the columns of results, and ``vectors`` (chunk_id, vector) of some of them."""
        level = F.coalesce("access_classification", F.lit("INTERNAL"))
        self._write(chunks.withColumn("access_classification", level).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id"), "chunks")
        own = self.read("chunks")
        child = own.where("parent_id is not null")
        terms = child.select("chunk_id", *ACCESS, search_terms(F.col("content")).alias("t"))
        flat = terms.select("chunk_id", *ACCESS, F.size("t").alias("size"), F.explode("t").alias("term"))
        tf = flat.groupBy("term", "chunk_id", *ACCESS, "size").agg(F.count("*").alias("tf"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        self._write(tf.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).sortWithinPartitions("bucket", "term"), "postings", "bucket")
        df = self.read("postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
        self._write(df.repartition(1, "bucket").sortWithinPartitions("bucket", "term"), "terms", "bucket")
        self._write(child.select("content").select(F.size(search_terms(F.col("content"))).alias("size")).agg(F.count("*").alias("n"), F.avg("size").alias("avg")), "totals")
        self._write(vectors.select("chunk_id", "vector").join(own.select("chunk_id", *ACCESS), "chunk_id").repartitionByRange("tenant_id", "chunk_id").sortWithinPartitions("tenant_id"), "vectors")
        self._write(child.select("chunk_id", "hierarchy_path", *ACCESS).repartitionByRange("tenant_id", "chunk_id").sortWithinPartitions("tenant_id", "chunk_id"), "paths")
        self._totals = None
        return self

    def totals(self) -> tuple[int, float]:
        """Children and their mean length; one row, read once."""
        if self._totals is None:
            row = self.read("totals").first()
            self._totals = row.n, row.avg or 1.0
        return self._totals

    def bm25(self, queries: DataFrame, k: int) -> DataFrame:
        """BM25 from the postings of the asked terms; ``queries`` has text, tenant_id, knowledge_base_id and levels."""
        asked = queries.select("query_id", "tenant_id", "knowledge_base_id", "levels", F.explode(F.array_distinct(search_terms(F.col("text")))).alias("term"))
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        few = asked.select("bucket", "term").distinct().limit(MOST_TERMS + 1).collect()
        if len(few) <= MOST_TERMS:  # the terms themselves reach the scan, of which the folders are sorted by term
            buckets = sorted({r.bucket for r in few})
            wanted = F.col("bucket").isin(buckets) & F.col("term").isin([r.term for r in few])
        else:
            wanted = F.lit(True)
        n, avg = self.totals()
        q = asked.select("query_id", "bucket", "term", F.col("tenant_id").alias("t"), F.col("knowledge_base_id").alias("kb"), "levels")
        df = self.read("terms").where(wanted).join(q.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        q = q.join(df.select("bucket", "term", idf), ["bucket", "term"])
        hit = self.read("postings").where(wanted).join(q, ["bucket", "term"])
        hit = hit.where((F.col("tenant_id") == F.col("t")) & (F.col("kb").isNull() | (F.col("kb") == F.col("knowledge_base_id"))) & F.array_contains("levels", F.col("access_classification")))
        part = F.col("idf") * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("size") / F.lit(avg)))
        return search.top(hit.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")), k)

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        """Exact cosine top-k per query over what it may see; queries travel in blocks, vectors are read once a block."""
        spark = self.spark
        own = queries.select("query_id", "tenant_id", "knowledge_base_id", "levels", "vector").where("vector is not null")
        few = own.limit(search.QUERY_BLOCK + 1).collect()
        blocks = 1 if len(few) <= search.QUERY_BLOCK else -(-own.count() // search.QUERY_BLOCK)
        own = own.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        out = None
        for block in range(blocks):
            got = few if blocks == 1 else own.where(F.col("b") == block).collect()  # QUERY_BLOCK rows or so
            by: dict[str, list] = {}
            for r in got:
                by.setdefault(r.tenant_id, []).append((r.query_id, r.knowledge_base_id, frozenset(r.levels or ()), np.array(r.vector, np.float64)))
            held = spark.sparkContext.broadcast(by)

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    tenant = np.array(b.column(2).to_pylist(), object)
                    for t in set(tenant.tolist()) & held.value.keys():
                        rows = b.take(pa.array(np.flatnonzero(tenant == t)))
                        x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                        x_norm = np.linalg.norm(x, axis=1)
                        kb, level = (np.array(rows.column(c).to_pylist(), object) for c in (3, 4))
                        for name, base, levels, v in held.value[t]:
                            n = x_norm * np.linalg.norm(v)
                            score = np.round((x @ v) / np.where(n > 0, n, 1), 6)
                            seen = np.isin(level, list(levels)) & ((base is None) | (kb == base))
                            at = np.flatnonzero(seen)
                            if len(at) > k:  # all that reach the k-th best, ties are left to the ranking
                                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
                            if len(at):
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), rows.column(0).take(pa.array(at)), pa.array(score[at])], ["query_id", "chunk_id", "score"])

            vectors = self.read("vectors")
            if len(by) <= 100:  # a filter on the sorted column; without it the map itself picks the tenants
                vectors = vectors.where(F.col("tenant_id").isin(list(by)))
            part = vectors.select("chunk_id", "vector", *ACCESS).mapInArrow(run, "query_id string, chunk_id string, score double")
            out = part if out is None else out.unionByName(part)
        return search.top(out, k)

    def graph(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """Children whose id or path holds the query's ``entity``; the queries without one ask nothing."""
        q = queries.where("entity is not null and entity <> ''").select("query_id", F.col("tenant_id").alias("t"), F.col("knowledge_base_id").alias("kb"), "levels", "entity")
        c = self.read("paths")
        seen = c.join(q, c.tenant_id == q.t).where((F.col("kb").isNull() | (F.col("kb") == F.col("knowledge_base_id"))) & F.array_contains("levels", F.col("access_classification")))
        hit = seen.where(F.contains("hierarchy_path", "entity") | F.contains("chunk_id", "entity"))
        return search.top(hit.select("query_id", "chunk_id", F.lit(0.8).alias("score")).distinct(), k)

    def contents(self, results: DataFrame, *columns: str) -> DataFrame:
        """``results`` with ``columns`` of their chunks."""
        return results.join(self.read("chunks").select("chunk_id", *columns), "chunk_id")
