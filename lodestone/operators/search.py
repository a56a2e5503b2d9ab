"""Dense, term and graph search, fusion, reranking and confidence, for many queries at once.

Queries: (query_id, text, tenant_id, knowledge_base_id, levels array<string>). Channels give (query_id, chunk_id, rank,
score); contents are joined after the top-k, so no text travels through scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_terms
from .policy import secured

K1, B = 1.2, 0.75
RRF_K = 60
QUERY_BLOCK = 4096


def top(scored: DataFrame, k: int, by: str = "score", key: str = "chunk_id") -> DataFrame:
    """The ``k`` best of each query, ties by key; Spark prunes within groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_topk(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, rank, score) of ``queries`` (query_id, vector) against all ``rows`` (id, vector), exactly.

    Queries go over the rows in blocks of ``QUERY_BLOCK``, whose size bounds what is broadcast; a task keeps the best of
    each Arrow batch only. Scores are rounded to six places before they are ranked.
    """
    spark = rows.sparkSession
    ids = rows.schema["id"].dataType.simpleString()
    blocks = -(-queries.count() // QUERY_BLOCK)
    numbered = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))).alias("b"))
    out = None
    for block in range(max(1, blocks)):
        got = numbered.where(F.col("b") == block).select("query_id", "vector").collect()
        names = [r.query_id for r in got]
        base = np.array([r.vector for r in got], np.float64).reshape(len(got), -1)
        norm = np.linalg.norm(base, axis=1)
        held = spark.sparkContext.broadcast((names, base / np.where(norm > 0, norm, 1)[:, None]))
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            if not names:
                return
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                n = np.linalg.norm(x, axis=1)
                score = np.round((x / np.where(n > 0, n, 1)[:, None]) @ q.T, 6).T
                own = batch.column(0).to_numpy(zero_copy_only=False)
                # all that reach the k-th best, so that ties are left to the ranking
                m = min(k + 1, score.shape[1])
                edge = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
                i, j = np.nonzero(score >= edge[:, None])
                yield pa.RecordBatch.from_arrays([pa.array([names[a] for a in i]), pa.array(own[j]), pa.array(score[i, j])], ["query_id", "id", "score"])

        part = rows.select("id", "vector").mapInArrow(run, f"query_id {kind}, id {ids}, score double")
        out = part if out is None else out.unionByName(part)
    if exclude_self:
        out = out.where(F.col("query_id") != F.col("id"))
    return top(out, k, key="id")


def dense(vectors: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``vectors`` (chunk_id, vector), ``queries`` with a vector: filtered by access first, then the exact top-k."""
    seen = secured(chunks.select("chunk_id", "tenant_id", "knowledge_base_id", "access_classification"), queries).select("query_id", "chunk_id")
    held = seen.join(vectors.select("chunk_id", "vector"), "chunk_id").join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, q = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) for i in (2, 3))
                n = np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1)
                score = np.round(np.einsum("ij,ij->i", x, q) / np.where(n > 0, n, 1), 6)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query_id", "chunk_id", "score"])

    return top(held.select("query_id", "chunk_id", "vector", "qv").mapInArrow(run, "query_id string, chunk_id string, score double"), k)


def postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, chunk_id, tf) and (chunk_id, size) of chunks (chunk_id, content)."""
    terms = chunks.select("chunk_id", search_terms(F.col("content")).alias("t"))
    sizes = terms.select("chunk_id", F.size("t").alias("size"))
    return terms.select("chunk_id", F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf")), sizes


def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 over all chunks' statistics; access is filtered before the top-k. Only the queries' terms are posted."""
    asked = queries.select("query_id", F.explode(F.array_distinct(search_terms(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    terms = chunks.select("chunk_id", search_terms(F.col("content")).alias("t"))
    sizes = terms.select("chunk_id", F.size("t").alias("size"))
    total = sizes.agg(F.struct(F.count("*").alias("n"), F.avg("size").alias("avg"))).scalar()
    n_all, avg = total["n"], total["avg"]
    posted = terms.select("chunk_id", F.size("t").alias("size"), F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    posted = posted.groupBy("term", "chunk_id", "size").agg(F.count("*").alias("tf"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_all - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / avg))
    scored = posted.join(df, "term").join(asked, "term")
    scored = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    seen = secured(chunks.select("chunk_id", "tenant_id", "knowledge_base_id", "access_classification"), queries).select("query_id", "chunk_id")
    return top(scored.join(seen, ["query_id", "chunk_id"]), k)


def graph(chunks: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Children whose id or path holds the query's ``entity``; constant score, ordered by id."""
    child = chunks.where("parent_id is not null").select("chunk_id", "hierarchy_path", "tenant_id", "knowledge_base_id", "access_classification")
    seen = secured(child, queries).join(queries.select("query_id", "entity"), "query_id").where("entity is not null and entity <> ''")
    hit = seen.where(F.contains("hierarchy_path", "entity") | F.contains("chunk_id", "entity"))
    return top(hit.select("query_id", "chunk_id", F.lit(0.8).alias("score")).distinct(), k)


def richest(*channels: DataFrame, prefix: str = "context_prefix") -> DataFrame:
    """Of the rows of all channels for a result, the first one with a prefix; the first of all where none has one."""
    rest = [c for c in channels[0].columns if c not in ("query_id", "chunk_id")]
    lists = None
    for i, c in enumerate(channels):
        own = c.where("chunk_id is not null and chunk_id <> ''").withColumn("list", F.lit(i))
        lists = own if lists is None else lists.unionByName(own)
    bare = F.coalesce(F.col(prefix), F.lit("")) == ""
    kept = lists.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct(*rest), F.struct(bare, "list", "rank")).alias("r"))
    return kept.select("query_id", "chunk_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def rrf(*channels: DataFrame, n: int = 30) -> DataFrame:
    """Reciprocal rank fusion; ties keep the order of the channels, then of their lists."""
    lists = None
    for i, c in enumerate(channels):
        own = c.where("chunk_id is not null and chunk_id <> ''").select("query_id", "chunk_id", "rank", F.lit(i).alias("list"))
        lists = own if lists is None else lists.unionByName(own)
    fused = lists.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("raw"), F.min(F.struct("list", "rank")).alias("first"))
    fused = fused.withColumn("score", F.round("raw", 5)).withColumn("key", F.round("raw", 12))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "first", "chunk_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "chunk_id", "rank", "score")


def coverage(query: Column, content: Column) -> Column:
    """Share of the query's different terms that the content has; the offline stand-in for a cross-encoder."""
    terms = F.array_distinct(search_terms(query))
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, search_terms(content))) / F.size(terms)).otherwise(0.0)


def rerank(fused: DataFrame, queries: DataFrame, contents: DataFrame, k: int, most: int = 50) -> DataFrame:
    """The first ``most`` of each fused list, reordered by coverage."""
    few = fused.where(F.col("rank") <= most).select("query_id", "chunk_id", F.col("rank").alias("fused_rank"))
    held = few.join(queries.select("query_id", "text"), "query_id").join(contents.select("chunk_id", "content"), "chunk_id")
    scored = held.select("query_id", "chunk_id", "fused_rank", F.round(coverage(F.col("text"), F.col("content")), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score")


def confidence_of(score: float | None) -> tuple[str, float, str]:
    """(level, score, reason) of the best result's score; null if there is no result."""
    if score is None:
        return "LOW", 0.0, "No evidence retrieved"
    level, word = ("HIGH", "Strong top") if score >= 0.75 else ("MEDIUM", "Moderate top") if score >= 0.45 else ("LOW", "Weak")
    return level, round(score, 3), f"{word} evidence score ({score:.2f})"


def confidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, level, score, reason) from the best result; LOW and 0 where there is none."""
    best = results.groupBy("query_id").agg(F.max("score").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    level = F.when(s >= 0.75, "HIGH").when(s >= 0.45, "MEDIUM").otherwise("LOW")
    word = F.when(s >= 0.75, "Strong top").when(s >= 0.45, "Moderate top").otherwise("Weak")
    reason = F.when(F.col("s").isNull(), "No evidence retrieved").otherwise(F.concat(word, F.lit(" evidence score ("), F.format_number(s, 2), F.lit(")")))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", level.alias("level"), F.round(s, 3).alias("score"), reason.alias("reason"))
