"""Job events, checkpoints, listings and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states of a job; any other is reported as FAILED.
JOB_STATES = (
    "RECEIVED", "VALIDATING", "CHECKING_DUPLICATE", "PARSING", "OCR", "VISION", "CHUNKING", "METADATA", "EMBEDDING", "WAITING_FOR_EMBEDDING_QUOTA",
    "INDEXING", "PARTIAL", "DUPLICATE", "COMPLETED", "FAILED", "CANCELLED", "QUARANTINED",
)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The state of each job after all its rows: most retries, then the latest start."""
    order = F.struct(
        F.coalesce("retry_count", F.lit(-1)).alias("r"), "started_at", "completed_at", F.upper("status").alias("status"), "current_stage", F.coalesce("progress_percent", F.lit(-1)).alias("p")
    )
    last = jobs.where("job_id is not null").groupBy("job_id").agg(F.max(order).alias("o"), F.max("document_id").alias("document_id"))
    known = F.when(F.col("o.status").isin(*JOB_STATES), F.col("o.status")).otherwise("FAILED")
    return last.select("job_id", "document_id", known.alias("status"), "o.current_stage", "o.started_at")


def checkpoints(jobs: DataFrame) -> DataFrame:
    """(job_id, stage_checkpoints, last_successful_stage) of each job: a stage is done if any row says so; the last stage is that of the latest row that names one."""
    own = jobs.where("job_id is not null")
    order = F.struct(F.coalesce("retry_count", F.lit(-1)), "started_at", "completed_at", "last_successful_stage")
    last = own.where("last_successful_stage is not null").groupBy("job_id").agg(F.max_by("last_successful_stage", order).alias("last_successful_stage"))
    flat = own.where("stage_checkpoints is not null").select("job_id", F.explode("stage_checkpoints").alias("stage", "done")).where("done is not null").groupBy("job_id", "stage").agg(F.max("done").alias("done"))
    done = flat.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "done"))).alias("stage_checkpoints"))
    return done.join(last, "job_id", "full_outer")


def listing(docs: DataFrame, tenant: str, status: str | None, limit: int, offset: int) -> DataFrame:
    """A page of a tenant's records, newest first."""
    own = docs.where(F.col("tenant_id") == tenant)
    if status:
        own = own.where(F.col("status") == status.upper())
    return own.orderBy(F.col("created_at").desc_nulls_last(), "doc_id").offset(offset).limit(min(limit, 100))


def base_versions(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(knowledge_base_id, tenant_id, version, document_count, chunk_count): one version step a completed record."""
    done = docs.where("status = 'COMPLETED' and knowledge_base_id is not null and tenant_id is not null")
    d = done.groupBy("knowledge_base_id", "tenant_id").agg(F.count("*").alias("version"), F.countDistinct("id").alias("document_count"))
    c = chunks.where("knowledge_base_id is not null and tenant_id is not null").groupBy("knowledge_base_id", "tenant_id").agg(F.countDistinct("chunk_id").alias("chunk_count"))
    return d.join(c, ["knowledge_base_id", "tenant_id"], "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def retrieval_metrics(results: DataFrame, k: int) -> DataFrame:
    """One row of recall@k (a hit at all), precision@k and mean reciprocal rank over results (query_id, rank, relevant)."""
    per = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("relevant").cast("int")).alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return per.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("recall_at_k"),
        F.round(F.avg(F.col("hits") / k), 6).alias("precision_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )
