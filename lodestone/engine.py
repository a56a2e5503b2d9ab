"""The entry points: upload, ingest, search, chat, states; over a ``Store`` and a stored ``SearchIndex``.

Ingestion takes a batch of documents through its stages as DataFrames. What a stage gives is written to the run's folder
before the next begins, so a run that broke off goes on where it stopped; a document that fails leaves the batch with its
error and the others go on. Chat is a bounded loop over retrieval, generation and verification.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import answer, chunking, control, dedup, embed, metadata, models, policy, search, tables
from .operators.index import SearchIndex
from .sources import files, parse
from .store import Store

#: Stages in order: name, progress when done, state of the job while it runs.
STAGES = (
    ("validate", 10, "VALIDATING"), ("duplicate", 15, "CHECKING_DUPLICATE"), ("parse", 35, "PARSING"), ("vision", 50, "VISION"), ("chunk", 65, "CHUNKING"),
    ("incremental", 70, "CHUNKING"), ("metadata", 75, "METADATA"), ("embed", 90, "EMBEDDING"), ("index", 100, "INDEXING"),
)
STAGE_SECONDS = 300.0
#: How a batch is worked on and cut; other ways are not known.
STRATEGIES = {"processing": "sequential", "chunking": "hierarchical"}
Step = Callable[[dict, str], dict]
RESPONSE_SECONDS, VECTOR_SECONDS = 3600, 86400
NOT_ENOUGH = "I don't have enough verified information in the knowledge base to answer this question."


class Cancelled(RuntimeError):
    pass


class AccessDenied(RuntimeError):
    pass


@dataclass(frozen=True)
class Tenant:
    tenant_id: str = "default"
    assistant_id: str = "default"
    knowledge_base_id: str = "default"
    access_level: str = "INTERNAL"
    user_id: str | None = None
    claims: dict = field(default_factory=dict)

    @classmethod
    def from_headers(cls, headers: dict[str, str]) -> Tenant:
        h = {k.lower(): v for k, v in headers.items()}
        return cls(h.get("x-tenant-id", "default"), h.get("x-assistant-id", "default"), h.get("x-knowledge-base-id", "default"), h.get("x-access-level", "INTERNAL"), h.get("x-user-id"))


@dataclass
class Answer:
    answer: str
    citations: list[dict]
    sources: list[dict]
    evidence: list[dict]
    confidence: str
    confidence_score: float
    verification_status: str
    retrieval_strategy: str
    trace_id: str
    latency_ms: int
    cached: bool = False
    retries: int = 0


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, services: models.Services | None = None, config_dir: str | None = None) -> None:
        self.spark, self.store, self.services = spark, Store(spark, root), services or models.Services()
        self.config_dir = config_dir
        self.index = SearchIndex(spark, f"{self.store.root}/index")
        #: Stages in order; ``steps`` holds those of another make by name: (parts held, folder) -> parts changed.
        self.stages: list[tuple[str, int, str]] = list(STAGES)
        self.steps: dict[str, Step] = {}

    def register(self, name: str, step: Step, progress: int, state: str, after: str | None = None) -> None:
        """Put a stage in the place of the one of its name, or behind the stage ``after``."""
        self.steps[name] = step
        names = [s[0] for s in self.stages]
        if name in names:
            self.stages[names.index(name)] = (name, progress, state)
        else:
            self.stages.insert(names.index(after) + 1 if after else len(names), (name, progress, state))

    # documents in

    def upload(self, uploads: DataFrame, ctx: Tenant | None = None, industry: str = "manufacturing") -> DataFrame:
        """Register ``uploads`` (filename, content): raw bytes, a PENDING record and a RECEIVED job each; (document_id, job_id, status).

        A column tenant_id, assistant_id, knowledge_base_id or industry of ``uploads`` takes the place of what the caller says.
        """
        ctx = ctx or Tenant()
        given = lambda c, x: (F.coalesce(c, F.lit(x)) if c in uploads.columns else F.lit(x)).alias(c)
        own = uploads.select(
            F.uuid().alias("document_id"), F.uuid().alias("job_id"), F.coalesce("filename", F.lit("upload.pdf")).alias("filename"), "content", given("tenant_id", ctx.tenant_id),
            given("assistant_id", ctx.assistant_id), given("knowledge_base_id", ctx.knowledge_base_id), given("industry", industry), F.current_timestamp().alias("created_at"),
        )
        run = uuid.uuid4().hex
        path = f"{self.store.root}/raw/{run}"
        own.withColumn("storage_name", F.concat("document_id", F.lit("_"), "filename")).write.parquet(path)
        kept = self.spark.read.parquet(path)
        self.store.append("documents", kept.select("document_id", F.lit("").alias("sha256"), "filename", F.concat(F.lit(path + "/"), "storage_name").alias("storage_path"), "industry", "tenant_id", "assistant_id", "knowledge_base_id", F.lit("PENDING").alias("status"), F.lit(0).alias("progress_percent"), F.lit(None).cast("string").alias("canonical_document_id"), F.lit(None).cast("int").alias("page_count"), "created_at", F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error_message")))
        self.store.append("jobs", kept.select("job_id", "document_id", "tenant_id", "assistant_id", "knowledge_base_id", F.lit("RECEIVED").alias("status"), F.lit(None).cast("string").alias("current_stage"), F.lit(0).alias("progress_percent"), F.lit(None).cast("string").alias("error_message"), "created_at"))
        return kept.select("document_id", "job_id", F.lit("RECEIVED").alias("status"))

    def raw(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/raw/*")

    def pending(self) -> DataFrame:
        docs = self.store.read("documents", "document_id").where("status = 'PENDING'").select("document_id")
        return self.raw().join(docs, "document_id", "left_semi")

    def cancel(self, job_id: str) -> None:
        """Cancel a job in whatever state it is."""
        self._job_state(self.store.read("jobs", "job_id").where(F.col("job_id") == job_id).select("document_id"), "CANCELLED", None, None)

    def _cancelled(self) -> DataFrame:
        return self.store.read("jobs", "job_id").where("status = 'CANCELLED'").select("document_id")

    def _job_state(self, ids: DataFrame, status: str, stage: str | None, progress: int | None) -> None:
        """Rows of records and jobs of ``ids`` (document_id, perhaps error) in a new state."""
        error = F.col("error") if "error" in ids.columns else F.lit(None).cast("string")
        own = ids.select("document_id", error.alias("e")).dropDuplicates(["document_id"])
        done = F.when(F.lit(status).isin("COMPLETED", "PARTIAL"), F.current_timestamp())
        for name, key in (("documents", "document_id"), ("jobs", "job_id")):
            rows = self.store.read(name, key)
            new = {"status": F.lit(status), "error_message": F.coalesce(F.substring("e", 1, 2000), "error_message")}
            if progress is not None:
                new["progress_percent"] = F.lit(progress)
            if name == "documents":
                new["completed_at"] = F.coalesce(done, "completed_at")
            elif stage:
                new["current_stage"] = F.lit(stage)
            self.store.append(name, rows.join(own, "document_id").withColumns(new).select(rows.columns))

    def checkpoint(self, ids: DataFrame, stage: str, done: dict[str, bool]) -> None:
        flags = F.create_map(*[F.lit(x) for kv in done.items() for x in kv])
        jobs = self.store.read("jobs", "job_id").join(ids.select("document_id"), "document_id", "left_semi")
        self.store.append("checkpoints", jobs.select("job_id", F.lit(stage).alias("last_successful_stage"), flags.alias("stage_checkpoints")))

    def ingest(self, docs: DataFrame | None = None, run: str | None = None, seconds: float = STAGE_SECONDS) -> DataFrame:
        """Take documents (those pending if none are given) through all stages; (document_id, status, progress_percent, error_message).

        ``run`` names the run: under a name used before, stages that are done are not done again.
        """
        run = run or uuid.uuid4().hex
        base = f"runs/{run}"
        if not self.store.exists(f"{base}/start/docs"):
            given = docs if docs is not None else self.pending()
            self.store.append(f"{base}/start/docs", given.select("document_id", "filename", "content", "tenant_id", "assistant_id", "knowledge_base_id", "industry"))
        held = {"docs": self._part(f"{base}/start/docs")}
        done: dict[str, bool] = {}
        for name, progress, state in self.stages:
            stop = self._cancelled() if self.store.exists("jobs") else None
            if stop is not None:
                held["docs"] = held["docs"].join(stop, "document_id", "left_anti")
            if not self.store.exists(f"{base}/{name}/_done"):
                self._job_state(held["docs"], state, name, progress)
                got = self._timed(lambda name=name, held=held: self.steps.get(name, getattr(self, f"_stage_{name}", None))(held, f"{base}/{name}"), name, seconds, held["docs"])
                for part, df in got.items():
                    if df is not None:
                        self.store.append(f"{base}/{name}/{part}", df)
                if "failed" in got:
                    self._job_state(self._part(f"{base}/{name}/failed"), "FAILED", name, None)
                done[name] = True
                self.checkpoint(held["docs"], name, done)
                self.spark.range(1).write.mode("overwrite").parquet(self.store.path(f"{base}/{name}/_done"))
            done[name] = True
            for part in ("docs", "pages", "chunks", "vectors"):
                if self.store.exists(f"{base}/{name}/{part}"):
                    held[part] = self._part(f"{base}/{name}/{part}")
        ids = self._part(f"{base}/start/docs").select("document_id")
        return self.store.read("documents", "document_id").join(ids, "document_id", "left_semi").select("document_id", "status", "progress_percent", "error_message")

    def _part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.store.path(name)).drop("written_at_", "gone_")

    def _timed(self, work: Callable[[], dict], name: str, seconds: float, docs: DataFrame) -> dict:
        """``work`` within so many seconds; a stage that takes longer, or breaks, fails its documents."""
        tag = f"stage-{name}-{uuid.uuid4().hex[:8]}"

        def tagged() -> dict:
            self.spark.sparkContext.addJobTag(tag)
            return {k: v for k, v in work().items()}

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(tagged).result(seconds)
        except (FutureTimeout, TimeoutError) as e:
            self.spark.sparkContext.cancelJobsWithTag(tag)
            said = f"Step '{name}' timed out after {seconds:g}s"
            self._job_state(docs.withColumn("error", F.lit(said)), "FAILED", name, None)
            raise TimeoutError(said) from e
        except Exception as e:
            self._job_state(docs.withColumn("error", F.lit(str(e)[:2000])), "FAILED", name, None)
            raise
        finally:
            pool.shutdown(wait=False)

    # the stages; each gives what it changes, written by the caller

    def _stage_validate(self, held: dict, at: str) -> dict:
        kind = parse.sniffed(F.col("content"))
        reason = F.when(F.col("content").isNull(), "missing").when(F.length("content") > files.MOST_BYTES, "too large").when(~kind.isin("application/pdf", "text/html", "text/plain"), "kind not supported")
        d = held["docs"].withColumn("error", reason)
        return {"docs": d.where("error is null").drop("error"), "failed": d.where("error is not null").select("document_id", "error")}

    def _stage_duplicate(self, held: dict, at: str) -> dict:
        """Digests; a record whose file its tenant already has, in the store or earlier in the batch, is a DUPLICATE of the newest, or the first here."""
        d = held["docs"].withColumn("sha256", F.sha2("content", 256))
        stored = self.store.read("documents", "document_id").where("status <> 'FAILED' and sha256 <> ''")
        old = stored.join(d.select("document_id"), "document_id", "left_anti").groupBy("tenant_id", "sha256").agg(F.max_by("document_id", F.struct("created_at", "document_id")).alias("canonical"))
        first = F.first("document_id").over(Window.partitionBy("tenant_id", "sha256").orderBy("document_id"))
        d = d.withColumn("f", first).join(old, ["tenant_id", "sha256"], "left").withColumn("canonical", F.coalesce("canonical", F.when(F.col("f") != F.col("document_id"), F.col("f"))))
        self.store.append(f"{at}/digests", d.select("document_id", F.col("sha256").alias("digest"), "canonical"))
        d = d.join(self._part(f"{at}/digests").select("document_id", F.col("canonical").alias("c")), "document_id")
        rows = self.store.read("documents", "document_id")
        new = rows.join(self._part(f"{at}/digests"), "document_id").withColumns({"sha256": F.col("digest"), "canonical_document_id": F.col("canonical"), "status": F.when(F.col("canonical").isNotNull(), "DUPLICATE").otherwise(F.col("status")), "progress_percent": F.when(F.col("canonical").isNotNull(), 100).otherwise(F.col("progress_percent"))})
        self.store.append("documents", new.select(rows.columns))
        jobs = self.store.read("jobs", "job_id")
        gone = self._part(f"{at}/digests").where("canonical is not null").select("document_id")
        self.store.append("jobs", jobs.join(gone, "document_id", "left_semi").withColumns({"status": F.lit("DUPLICATE"), "progress_percent": F.lit(100)}).select(jobs.columns))
        return {"docs": d.where("c is null").drop("f", "canonical", "c", "sha256")}

    def _stage_parse(self, held: dict, at: str) -> dict:
        got = parse.parsed(held["docs"])
        self.store.append(f"{at}/read", got)
        got = self._part(f"{at}/read")
        fine = got.where("error is null")
        names = held["docs"].select("document_id", "filename")
        rows = self.store.read("documents", "document_id")
        self.store.append("documents", rows.join(parse.counts(fine).select("document_id", F.col("page_count").alias("n")), "document_id").withColumn("page_count", F.col("n")).select(rows.columns))
        return {"docs": held["docs"].drop("content").join(fine.select("document_id"), "document_id", "left_semi"), "pages": parse.paged(fine.join(names, "document_id")), "failed": got.where("error is not null").select("document_id", "error")}

    def _stage_vision(self, held: dict, at: str) -> dict:
        """Figures with what the model sees in them; without a model or a path there is no analysis, a failure is an empty one."""
        pages, look = held["pages"], self.services.look
        raw = F.lit(None).cast("string")
        if look is not None:
            run = models.analysed(look, lambda p: open(p, "rb").read())
            seen = F.udf(run, "string")
            raw = seen(F.col("f.image_path"))
        flat = pages.select("document_id", "page_number", F.posexplode("figures").alias("k", "f")).withColumn("raw", raw)
        v = T.vision_json(F.col("raw"))
        full = F.struct(F.col("f.image_path"), F.col("f.caption"), F.when(F.col("raw").isNotNull(), v["functional_summary"]).alias("summary"), v["components"].alias("components"), F.col("f.bbox"))
        figures = flat.groupBy("document_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", full.alias("f")))), lambda x: x["f"]).alias("seen"))
        return {"pages": pages.join(figures, ["document_id", "page_number"], "left").withColumn("figures", F.col("seen")).drop("seen")}

    def _stage_chunk(self, held: dict, at: str) -> dict:
        owner = held["docs"].select("document_id", "tenant_id", "assistant_id", "knowledge_base_id", "industry")
        return {"chunks": chunking.all_chunks(held["pages"]).join(owner, "document_id")}

    def _stage_incremental(self, held: dict, at: str) -> dict:
        """Chunks whose text the tenant already holds are reusable."""
        if not self.store.exists("chunks"):
            return {"chunks": held["chunks"].withColumn("reusable", F.lit(False))}
        return {"chunks": dedup.reusable(held["chunks"], self.store.read("chunks", "chunk_id"))}

    def _stage_metadata(self, held: dict, at: str) -> dict:
        kinds = [r[0] for r in held["docs"].select("industry").distinct().collect()]  # one a configuration
        configs = {k: metadata.load_config(self.config_dir, k) for k in kinds}
        own = held["chunks"].withColumns({"access_classification": F.lit("INTERNAL"), "metadata": F.lit(None).cast("string")})
        return {"chunks": metadata.enrich_all(own, configs).drop("metadata")}

    def _stage_embed(self, held: dict, at: str) -> dict:
        """Cached vectors and new ones; a used-up quota is waited for once, with the jobs saying so."""
        try:
            return self._embedded(held, at)
        except Exception as e:
            found = re.search(r"quota used up, again in ([\d.]+) s", str(e))
            if not found:
                raise
        self._job_state(held["docs"], "WAITING_FOR_EMBEDDING_QUOTA", None, None)
        time.sleep(float(found[1]))
        self._job_state(held["docs"], "EMBEDDING", None, None)
        return self._embedded(held, f"{at}/again")

    def _embedded(self, held: dict, at: str) -> dict:
        cache = self.store.read("embedding_cache", "cache_key") if self.store.exists("embedding_cache") else self.spark.createDataFrame([], "cache_key string, vector array<float>")
        embedder = self.services.embedder
        out, new = embed.embedded(held["chunks"], cache, "default", "1", embedder)
        self.store.append(f"{at}/new", new)
        self.store.insert_missing("embedding_cache", self._part(f"{at}/new"), "cache_key")
        fresh = self.store.read("embedding_cache", "cache_key")
        key = T.embedding_key(F.col("content_hash"), F.lit("default"), F.lit("1"))
        vectors = held["chunks"].select("chunk_id", "document_id", "tenant_id", key.alias("cache_key")).join(fresh.select("cache_key", "vector"), "cache_key", "left").drop("cache_key")
        return {"vectors": vectors}

    def _stage_index(self, held: dict, at: str) -> dict:
        """Three sinks, each on its own: chunks, vectors, graph. All taken COMPLETED, some PARTIAL, none an error."""
        chunks, vectors = held["chunks"], held["vectors"]
        n, m = chunks.count(), vectors.where("vector is not null").count()
        if n != m:
            raise ValueError(f"{n} chunks, {m} vectors")
        said: dict[str, str] = {}

        def sink(name: str, work: Callable[[], Any]) -> bool:
            try:
                work()
                return True
            except Exception as e:
                said[name] = str(e)[:500]
                return False

        def graph() -> None:
            nodes, edges = tables.graph(chunks)
            self.store.append("nodes", nodes)
            self.store.append("edges", edges)

        stored = chunks.drop("bounding_box") if "bounding_box" in chunks.columns else chunks
        ok = {
            "chunks": sink("chunks", lambda: self.store.upsert("chunks", stored, "chunk_id", ["content", "content_hash", "context_prefix"])),
            "vectors": sink("vectors", lambda: self.store.upsert("vectors", vectors, "chunk_id")),
            "graph": sink("graph", graph),
        }
        if not any(ok.values()):
            raise RuntimeError(f"no sink took the chunks: {said}")
        state = "COMPLETED" if all(ok.values()) else "PARTIAL"
        ids = held["docs"].select("document_id")
        flags = [F.when(F.lit(v), "COMPLETED").otherwise("FAILED").alias(f"{k}_status") for k, v in ok.items()]
        self.store.append("indexing_state", ids.join(chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count")), "document_id", "left").select("document_id", *flags, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(json.dumps(said) if said else None).cast("string").alias("last_error")))
        if state == "COMPLETED":
            self.store.append("base_versions", held["docs"].groupBy("knowledge_base_id", "tenant_id").agg(F.count("*").alias("steps")))
        self._job_state(ids.withColumn("error", F.lit(json.dumps(said) if said else None).cast("string")), state, "index", 100 if state == "COMPLETED" else 95)
        return {"docs": held["docs"]}

    def reindex(self) -> SearchIndex:
        """Build the search index anew from the store."""
        chunks = self.store.read("chunks", "chunk_id")
        return self.index.build(chunks, self.store.read("vectors", "chunk_id").select("chunk_id", "vector"))

    def delete(self, document_id: str, tenant_id: str) -> None:
        """Take a tenant's document out of the chunks, vectors and graph."""
        for name in ("chunks", "vectors"):
            self.store.delete(name, "chunk_id", (F.col("document_id") == document_id) & (F.col("tenant_id") == tenant_id))
        if self.store.exists("nodes"):
            nodes, edges = self.graph()
            left = tables.cascade(nodes, edges, self.spark.createDataFrame([(document_id,)], "id string"))[0]
            self.store.append("nodes", nodes.join(left.select("id"), "id", "left_anti"), gone=True)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes = self.store.read("nodes", "id", "label")
        ids = nodes.select(F.col("id"))
        edges = self.store.read("edges", "src", "dst", "type")
        return nodes, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    # states

    def status(self, document_id: str) -> dict:
        if not self.spark.range(1).select(T.is_uuid(F.lit(document_id))).first()[0]:
            raise ValueError(f"no document id: {document_id}")
        row = self.store.read("documents", "document_id").where(F.col("document_id") == document_id).select("document_id", "status", "progress_percent", "created_at", "completed_at", "error_message").first()
        if row is None:
            raise KeyError(document_id)
        return row.asDict()

    def documents(self, ctx: Tenant, status: str | None = None, limit: int = 20, offset: int = 0) -> dict:
        rows = control.listing(self.store.read("documents", "document_id").withColumn("doc_id", F.col("document_id")), ctx.tenant_id, status, limit, offset).collect()
        return {"documents": [r.asDict() for r in rows], "count": len(rows), "limit": min(limit, 100), "offset": offset}

    def job(self, job_id: str) -> dict | None:
        row = self.store.read("jobs", "job_id").where(F.col("job_id") == job_id).first()
        return None if row is None else row.asDict() | {"status": row.status if row.status in control.JOB_STATES else "FAILED"}

    def base_version(self, ctx: Tenant) -> int:
        """Steps of the tenant's base; 1 before the first."""
        if not self.store.exists("base_versions"):
            return 1
        mine = (F.col("knowledge_base_id") == ctx.knowledge_base_id) & (F.col("tenant_id") == ctx.tenant_id)
        return self.store.log("base_versions").where(mine).agg(F.sum("steps")).first()[0] or 1

    # questions

    def _key(self, ctx: Tenant, query: str, prefix: str) -> str:
        lit = lambda x: F.lit(x)
        return self.spark.range(1).select(T.security_key(lit(ctx.tenant_id), lit(ctx.assistant_id), lit(ctx.knowledge_base_id), lit(self.base_version(ctx)), lit(ctx.access_level), lit(query), prefix)).first()[0]

    def query_vector(self, ctx: Tenant, query: str) -> list[float]:
        key = self._key(ctx, query, "query_vec")
        if (held := self.store.get("query_vectors", key)) is not None:
            return json.loads(held)
        vector = [float(x) for x in self.services.embedder([query])[0]]
        self.store.put("query_vectors", self.spark.createDataFrame([(key, json.dumps(vector))], "key string, value string"), VECTOR_SECONDS)
        return vector

    def retrieve(self, query: str, ctx: Tenant, top_k: int = 10, levels: list[str] | None = None) -> dict:
        """Three channels by intent, fused and reranked; a channel that fails counts as empty."""
        levels = policy.levels_of(ctx.access_level) if levels is None else levels
        clean = " ".join(query.split())
        row = self.spark.range(1).select(T.intent(F.lit(clean)).alias("intent"), T.entities(F.lit(clean)).alias("entities")).first()
        entity = (row.entities[0] if row.entities else clean[:30]) if row.intent in ("RELATIONSHIP", "TECHNICAL") else None
        if not clean:
            return {"intent": row.intent, "results": [], "strategy": "dense+bm25_rrf_rerank", "confidence": "LOW", "score": 0.0, "reason": "No evidence retrieved"}
        schema = "query_id string, text string, tenant_id string, knowledge_base_id string, levels array<string>, entity string, vector array<double>"
        q = self.spark.createDataFrame([("q", clean, ctx.tenant_id, ctx.knowledge_base_id, levels, entity, self.query_vector(ctx, clean))], schema)
        got = {}
        for name, ask in (("dense", lambda: self.index.dense(q, 2 * top_k)), ("bm25", lambda: self.index.bm25(q, 2 * top_k)), ("graph", lambda: self.index.graph(q))):
            if name != "graph" or entity:
                try:
                    got[name] = ask().select("query_id", "chunk_id", "rank").collect()  # at most 2 top_k, 20 for the graph
                except Exception:
                    got[name] = []
        lists = [self.spark.createDataFrame(got[n], "query_id string, chunk_id string, rank int") for n in ("dense", "bm25") if got.get(n)] + ([self.spark.createDataFrame(got["graph"], "query_id string, chunk_id string, rank int")] if got.get("graph") else [])
        fused = [] if not lists else self.index.contents(search.rrf(*lists), "content", "document_id", "page_number", "section", "content_hash", "context_prefix").orderBy("rank").collect()
        best = models.reranked(clean, [r.asDict() for r in fused], top_k, self.services.rerank)
        level, score, reason = search.confidence_of(best[0]["score"] if best else None)
        return {"intent": row.intent, "results": best, "strategy": f"dense+bm25{'+graph' if got.get('graph') else ''}_rrf_rerank", "confidence": level, "score": score, "reason": reason}

    def search(self, query: str, ctx: Tenant | None = None, top_k: int = 10) -> dict:
        """Results without an answer."""
        began = time.time()
        got = self.retrieve(query, ctx or Tenant(), top_k)
        return {"query": query, "results": got["results"], "confidence": got["confidence"], "strategy": got["strategy"], "latency_ms": int((time.time() - began) * 1000)}

    def chat(self, query: str, ctx: Tenant | None = None, top_k: int = 10) -> Answer:
        """Policy, cache, retrieval, answer, verification. A weak result is asked once more with a wider query, an answer
        that is only partly supported at most twice."""
        if not 1 <= top_k <= 50:
            raise ValueError("top_k must be 1 to 50")
        ctx, began, trace = ctx or Tenant(), time.time(), f"tr_{uuid.uuid4().hex[:12]}"
        allowed, levels, why = policy.decide(ctx.access_level, self.services.policy, vars(ctx))
        if not allowed:
            raise AccessDenied(f"Access denied: {why}")
        ms = lambda: int((time.time() - began) * 1000)
        key = self._key(ctx, query, "rag_resp")
        if (held := self.store.get("responses", key)) is not None:
            c = json.loads(held)
            return Answer(c["answer"], c["citations"], [], [], c["confidence"], c["confidence_score"], c["verification_status"], c["retrieval_strategy"], trace, ms(), cached=True)
        asked, retries = query, 0
        while True:
            got = self.retrieve(asked, ctx, top_k, levels)
            if got["confidence"] == "LOW" and retries < 1:
                asked, retries = f"{asked} explain details", retries + 1
                continue
            evidence = answer.distinct_rows(got["results"])
            if not evidence:
                said, status, cites, sources = NOT_ENOUGH, "UNSUPPORTED", [], []
                break
            said = models.generated(asked, evidence, self.services.generate)
            cites, sources = answer.cited(evidence)
            text = " ".join(e["content"] or "" for e in evidence)
            status = answer.grounded(self.spark.createDataFrame([(said, text)], "answer string, evidence string")).first().verification_status
            if status != "PARTIALLY_SUPPORTED" or retries >= 2:
                break
            retries += 1
        out = Answer(said, cites, sources, [{k: e[k] for k in ("chunk_id", "content", "page_number", "score")} for e in evidence], got["confidence"], got["score"], status, got["strategy"], trace, ms(), retries=retries)
        if status == "SUPPORTED":
            value = json.dumps({"answer": said, "citations": cites, "confidence": out.confidence, "confidence_score": out.confidence_score, "verification_status": status, "retrieval_strategy": out.retrieval_strategy})
            self.store.put("responses", self.spark.createDataFrame([(key, value)], "key string, value string"), RESPONSE_SECONDS)
        return out

    def health(self) -> dict:
        """Whether the session answers, and which tables are there."""
        return {"spark": self.spark.range(1).count() == 1, "tables": {n: self.store.exists(n) for n in ("documents", "jobs", "chunks", "vectors", "nodes")}}
