"""Queries on jobs, versions, the document graph, caches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as T
from ..operators import control, tables
from ..store import Store
from ..streaming.ingest import event_windows, stream_ingest
from .common import CHUNKS_ONCE, chunks_once, table
from .etl import PARENTS


def job_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.latest_jobs(table(spark, sf_dir, "ingestion_jobs")).select("job_id", "status", "current_stage")


def kb_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.base_versions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunks"))


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = control.listing(table(spark, sf_dir, "documents"), "tn_orvane", "completed", 50, 5)
    return page.select("doc_id", "file_name", "status", "version", "created_at")


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look-up by id gives, for every record."""
    return table(spark, sf_dir, "documents").select("id", "status", "progress_percent", "created_at", "completed_at", "error_message")


def document_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the state of its latest job; without one the record's own."""
    jobs = control.latest_jobs(table(spark, sf_dir, "ingestion_jobs")).where("document_id is not null").groupBy("document_id").agg(F.max_by("status", F.struct("started_at", "job_id")).alias("job_status"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("id").alias("document_id"), "status")
    return d.join(jobs, "document_id", "left").select("doc_id", F.coalesce("job_status", F.upper("status")).alias("status"))


def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resuming needs of each job over all its rows: the stages with whether they are done, and the last one that was."""
    return control.checkpoints(table(spark, sf_dir, "ingestion_jobs")).select("job_id", F.array_join(F.transform(F.array_sort(F.map_entries("stage_checkpoints")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("checkpoints"), "last_successful_stage")


def indexing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sinks hold each completed record, chunks, vectors and graph, and the state that follows."""
    c = chunks_once(spark, sf_dir, "document_id", "parent_id")
    v = table(spark, sf_dir, "chunk_vectors").where("vector is not null").select("chunk_id").distinct().withColumn("v", F.lit(1))
    n = c.join(v, "chunk_id", "left").groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count("v").alias("vector_count"), F.count_if(F.col("parent_id").isNull()).alias("sections"))
    d = table(spark, sf_dir, "documents").where("status = 'COMPLETED'").select(F.col("id").alias("document_id"))
    flags = F.array(*[F.coalesce(F.col(x), F.lit(0)) > 0 for x in ("chunk_count", "vector_count", "sections")])
    return d.join(n, "document_id", "left").select("document_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("vector_count", F.lit(0)).alias("vector_count"), tables.sink_state(flags).alias("state"))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written in two batches, the later rows of a chunk taking the place of the earlier: what a read gives."""
    v = table(spark, sf_dir, "chunk_vectors").where("chunk_id is not null").select("chunk_id", "content_hash", "created_at", F.size("vector").alias("n_dims"))
    last = tables.latest(v, "chunk_id", "created_at")
    store = Store(spark)
    store.upsert("vectors", v.where("created_at is not null").groupBy("chunk_id").agg(F.min("created_at").alias("created_at"), F.lit("first").alias("content_hash"), F.lit(-1).alias("n_dims")), "chunk_id")
    store.upsert("vectors", last, "chunk_id")
    return store.read("vectors", "chunk_id").select("chunk_id", "n_dims")


def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left when a tenant's failed records are taken out of the index."""
    c = chunks_once(spark, sf_dir, "document_id", "tenant_id")
    gone = table(spark, sf_dir, "documents").where("status = 'FAILED'").select(F.col("id").alias("document_id"), "tenant_id").distinct()
    return c.join(gone, ["document_id", "tenant_id"], "left_anti").select("chunk_id")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after those still waiting have been cancelled and the failed ones have their error cut to 2,000 characters."""
    j = control.latest_jobs(table(spark, sf_dir, "ingestion_jobs"))
    store = Store(spark)
    store.append("jobs", j.select("job_id", "status", F.lit(None).cast("string").alias("error_message")))
    waiting = store.read("jobs", "job_id").where("status in ('RECEIVED', 'WAITING_FOR_EMBEDDING_QUOTA')")
    store.append("jobs", waiting.withColumn("status", F.lit("CANCELLED")))
    store.append("jobs", store.read("jobs", "job_id").where("status = 'FAILED'").withColumn("error_message", F.substring(F.repeat(F.col("job_id"), 99), 1, 2000)))
    return store.read("jobs", "job_id").select("job_id", "status", F.length("error_message").alias("error_chars"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cached per base version, asked with the version that holds now: hit, old version or expired."""
    b = table(spark, sf_dir, "knowledge_base_versions").where("knowledge_base_id is not null and tenant_id is not null").groupBy("knowledge_base_id", "tenant_id").agg(F.max("version").alias("version"))
    key = lambda v: T.security_key(F.col("tenant_id"), F.lit("a"), F.col("knowledge_base_id"), v, F.lit("INTERNAL"), F.lit(" Query "), "rag_resp")
    k = F.pmod(F.length(F.concat("tenant_id", "knowledge_base_id")), F.lit(3))
    rows = b.select("*", k.alias("k"), key(F.when(k == 1, F.col("version") - 1).otherwise(F.col("version"))).alias("cached"))
    store = Store(spark)
    store.put("responses", rows.where("k < 2").select(F.col("cached").alias("key"), F.lit("yes").alias("value")), 3600)
    store.put("responses", rows.where("k = 2").select(F.col("cached").alias("key"), F.lit("old").alias("value")), -1)
    alive = tables.alive(store.read("responses", "key"), F.current_timestamp()).select("key", "value")
    asked = b.select("tenant_id", "knowledge_base_id", key(F.col("version")).alias("key"))
    return asked.join(alive, "key", "left").select("tenant_id", "knowledge_base_id", F.col("value").isNotNull().alias("hit"))


def ingest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the whole pipeline: how many end in which state, per tenant."""
    e = Engine(spark)
    d = table(spark, sf_dir, "documents")
    e.upload(d.select("tenant_id", F.col("file_name").alias("filename"), "industry", F.encode("text", "UTF-8").alias("content")))
    return e.ingest().join(e.store.read("documents", "document_id").select("document_id", "tenant_id"), "document_id").groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.graph(chunks_once(spark, sf_dir, "parent_id", "document_id"))[1]


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes left when the failed records are gone."""
    nodes, edges = tables.graph(chunks_once(spark, sf_dir, "parent_id", "document_id"))
    gone = table(spark, sf_dir, "documents").where("status = 'FAILED'").select("id")
    return tables.cascade(nodes, edges, gone)[0]


def supersedes_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pairs = d.where("supersedes is not null").select(F.col("id").alias("new"), F.lower("supersedes").alias("old")).join(d.select(F.col("id").alias("old")), "old", "left_semi")
    return tables.supersede(spark.createDataFrame([], "src string, dst string, type string"), pairs)


def cache_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cached for 30 days that are alive at the time of the latest one."""
    v = table(spark, sf_dir, "chunk_vectors").where("chunk_id is not null")
    v = v.groupBy("chunk_id").agg(F.max("created_at").alias("created_at")).withColumn("expires_at", F.col("created_at") + F.expr("interval 30 days"))
    return tables.alive(v, v.agg(F.max("created_at")).scalar()).select("chunk_id")


def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.grow(table(spark, sf_dir, "documents").select("doc_id", "version"), {"version": ("int", 1), "retry_count": ("int", 0), "region": ("string", None)})
    return d.select("doc_id", "version", "retry_count", "region")


QUERIES = {f.__name__: f for f in (job_latest_status, kb_versions, list_documents, document_status, document_jobs, checkpoint_state, indexing_state, vector_upsert, vector_delete, job_events, cache_lookup, ingest_states, graph_edges, cascade_delete, supersedes_edges, cache_alive, migrated, stream_ingest, event_windows)}
_STATES = ",".join(f"'{s}'" for s in control.JOB_STATES)
JOBS = f"""jobs AS (SELECT job_id, started_at, CASE WHEN st IN ({_STATES}) THEN st ELSE 'FAILED' END AS status, current_stage, doc FROM (SELECT job_id, started_at, upper(status) AS st, current_stage, max(document_id) OVER (PARTITION BY job_id) AS doc,
  row_number() OVER (PARTITION BY job_id ORDER BY coalesce(retry_count, -1) DESC, started_at DESC NULLS LAST, completed_at DESC NULLS LAST, upper(status) DESC NULLS LAST, current_stage DESC NULLS LAST) AS n FROM ingestion_jobs WHERE job_id IS NOT NULL) WHERE n = 1)"""
GRAPH = """c AS (SELECT DISTINCT chunk_id, parent_id, document_id FROM chunks_once), edges AS (SELECT DISTINCT document_id AS src, chunk_id AS dst, 'HAS_SECTION' AS type FROM c WHERE parent_id IS NULL AND document_id IS NOT NULL
  UNION SELECT DISTINCT k.parent_id, k.chunk_id, 'CONTAINS_CHUNK' FROM c k WHERE k.parent_id IN (SELECT chunk_id FROM c WHERE parent_id IS NULL))"""
SQL = {
    "job_latest_status": f"WITH {JOBS} SELECT job_id, status, current_stage FROM jobs",
    "kb_versions": """WITH d AS (SELECT knowledge_base_id, tenant_id, count(*) AS version, count(DISTINCT id) AS document_count FROM documents WHERE status = 'COMPLETED' AND knowledge_base_id IS NOT NULL AND tenant_id IS NOT NULL GROUP BY ALL),
      c AS (SELECT knowledge_base_id, tenant_id, count(DISTINCT chunk_id) AS chunk_count FROM chunks WHERE knowledge_base_id IS NOT NULL AND tenant_id IS NOT NULL GROUP BY ALL)
      SELECT d.*, coalesce(c.chunk_count, 0) AS chunk_count FROM d LEFT JOIN c USING (knowledge_base_id, tenant_id)""",
    "list_documents": "SELECT doc_id, file_name, status, version, created_at FROM documents WHERE tenant_id = 'tn_orvane' AND status = 'COMPLETED' ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 50 OFFSET 5",
    "document_status": "SELECT id, status, progress_percent, created_at, completed_at, error_message FROM documents",
    "document_jobs": f"WITH {JOBS}, j AS (SELECT doc AS document_id, status AS js FROM jobs WHERE doc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY started_at DESC NULLS LAST, job_id DESC) = 1) SELECT d.doc_id, coalesce(j.js, upper(d.status)) AS status FROM documents d LEFT JOIN j ON d.id = j.document_id",
    "checkpoint_state": """WITH f AS (SELECT job_id, unnest(map_keys(stage_checkpoints)) AS stage, unnest(map_values(stage_checkpoints)) AS done FROM ingestion_jobs WHERE job_id IS NOT NULL AND stage_checkpoints IS NOT NULL),
      g AS (SELECT job_id, stage, bool_or(done) AS done FROM f WHERE done IS NOT NULL GROUP BY ALL), m AS (SELECT job_id, string_agg(stage || '=' || CASE WHEN done THEN 'true' ELSE 'false' END, ',' ORDER BY stage) AS checkpoints FROM g GROUP BY job_id),
      l AS (SELECT job_id, last_successful_stage FROM ingestion_jobs WHERE job_id IS NOT NULL AND last_successful_stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY coalesce(retry_count, -1) DESC, started_at DESC NULLS LAST, completed_at DESC NULLS LAST, last_successful_stage DESC) = 1)
      SELECT coalesce(m.job_id, l.job_id) AS job_id, m.checkpoints, l.last_successful_stage FROM m FULL JOIN l ON m.job_id = l.job_id""",
    "indexing_state": f"""WITH {CHUNKS_ONCE}, v AS (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE vector IS NOT NULL), n AS (SELECT c.document_id, count(*) AS chunk_count, count(v.chunk_id) AS vector_count, count(*) FILTER (c.parent_id IS NULL) AS sections FROM chunks_once c LEFT JOIN v ON c.chunk_id = v.chunk_id GROUP BY c.document_id)
      SELECT d.id AS document_id, coalesce(chunk_count, 0) AS chunk_count, coalesce(vector_count, 0) AS vector_count, CASE WHEN chunk_count > 0 AND vector_count > 0 AND sections > 0 THEN 'COMPLETED' WHEN chunk_count > 0 OR vector_count > 0 OR sections > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS state FROM documents d LEFT JOIN n ON d.id = n.document_id WHERE d.status = 'COMPLETED'""",
    "vector_upsert": "SELECT chunk_id, CAST(len(vector) AS INTEGER) AS n_dims FROM chunk_vectors WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST) = 1",
    "vector_delete": f"WITH {CHUNKS_ONCE} SELECT chunk_id FROM chunks_once c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.status = 'FAILED' AND d.id = c.document_id AND d.tenant_id = c.tenant_id)",
    "job_events": f"WITH {JOBS} SELECT job_id, CASE WHEN status IN ('RECEIVED','WAITING_FOR_EMBEDDING_QUOTA') THEN 'CANCELLED' ELSE status END AS status, CASE WHEN status = 'FAILED' THEN CAST(least(2000, 99 * length(job_id)) AS INTEGER) END AS error_chars FROM jobs",
    "cache_lookup": "SELECT tenant_id, knowledge_base_id, length(tenant_id || knowledge_base_id) % 3 = 0 AS hit FROM knowledge_base_versions WHERE knowledge_base_id IS NOT NULL AND tenant_id IS NOT NULL GROUP BY ALL",
    "ingest_states": """WITH d AS (SELECT coalesce(tenant_id, 'default') AS tenant_id, text, CAST(text AS BLOB) AS b FROM documents),
      s AS (SELECT tenant_id, CASE WHEN text IS NULL OR text = '' THEN 'FAILED' WHEN row_number() OVER (PARTITION BY tenant_id, text) > 1 THEN 'DUPLICATE' ELSE 'COMPLETED' END AS status FROM d) SELECT tenant_id, status, count(*) AS n FROM s GROUP BY ALL""",
    "graph_edges": f"WITH {CHUNKS_ONCE}, {GRAPH} SELECT src, dst, type FROM edges",
    "cascade_delete": f"""WITH {CHUNKS_ONCE}, {GRAPH}, nodes AS (SELECT DISTINCT document_id AS id, 'Document' AS label FROM c WHERE document_id IS NOT NULL UNION SELECT chunk_id, CASE WHEN parent_id IS NULL THEN 'Section' ELSE 'Chunk' END FROM c),
      gone AS (SELECT id FROM documents WHERE status = 'FAILED'), sec AS (SELECT dst AS id FROM edges WHERE type = 'HAS_SECTION' AND src IN (SELECT id FROM gone)), kid AS (SELECT dst AS id FROM edges WHERE type = 'CONTAINS_CHUNK' AND src IN (SELECT id FROM sec))
      SELECT id, label FROM nodes WHERE id NOT IN (SELECT id FROM gone UNION SELECT id FROM sec UNION SELECT id FROM kid)""",
    "supersedes_edges": "SELECT DISTINCT id AS src, lower(supersedes) AS dst, 'SUPERSEDES' AS type FROM documents WHERE lower(supersedes) IN (SELECT id FROM documents)",
    "cache_alive": "WITH v AS (SELECT chunk_id, max(created_at) AS t FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id) SELECT chunk_id FROM v WHERE t + INTERVAL 30 DAY > (SELECT max(t) FROM v)",
    "migrated": "SELECT doc_id, version, CAST(0 AS INTEGER) AS retry_count, CAST(NULL AS VARCHAR) AS region FROM documents",
    "stream_ingest": f"WITH {PARENTS.replace('FROM documents WHERE text IS NOT NULL', 'FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT min(doc_id) FROM documents GROUP BY tenant_id, text)')} SELECT d.tenant_id, sha256(n.content) AS content_hash, n.section, n.hierarchy_path FROM named n JOIN documents d ON d.doc_id = CAST(n.document_id AS BIGINT)",
    "event_windows": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
