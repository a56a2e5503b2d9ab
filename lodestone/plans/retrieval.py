"""Queries on search, fusion, answers and policy."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import answer, control, policy, search
from ..operators.index import SearchIndex
from ..session import shared_root
from .common import CHUNKS_ONCE, QUERIES as ASKED, TOP_K, USABLE, chunks_once, intent_sql, kept, queries_for, table, usable_vectors

ACCESS = ("tenant_id", "knowledge_base_id", "access_classification", "parent_id")


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, chunks and queries; a tenant's query vector is that of its first chunk with a usable one."""
    chunks, vectors = chunks_once(spark, sf_dir, *ACCESS), usable_vectors(spark, sf_dir)
    first = chunks.join(vectors, "chunk_id").groupBy("tenant_id").agg(F.min_by("vector", "chunk_id").alias("vector"))
    return vectors, chunks, queries_for(spark, sf_dir).join(first, "tenant_id")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search.cosine_topk(e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", "score")


_INDEXES: dict[tuple[str, str], tuple[SearchIndex, DataFrame]] = {}


def indexed(spark: SparkSession, sf_dir: str) -> tuple[SearchIndex, DataFrame]:
    """The search index of a data folder and its questions with vectors, built once by an application and kept in the shared folder.

    Building is what ingestion does in the engine; the queries below answer from what it stored.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        vectors, _, queries = _with_vectors(spark, sf_dir)
        chunks = chunks_once(spark, sf_dir, "content", "hierarchy_path", "document_id", "page_number", "section", "content_hash", "context_prefix", *ACCESS)
        index = SearchIndex(spark, f"{shared_root(spark)}/lodestone/index-{uuid.uuid4().hex}").build(chunks, vectors)
        every = queries_for(spark, sf_dir).join(queries.select("query_id", "vector"), "query_id", "left")
        _INDEXES[key] = index, kept(every, "questions")
    return _INDEXES[key]


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of the index."""
    return indexed(spark, sf_dir)[0].read("terms").select("term", "df")


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = indexed(spark, sf_dir)
    return index.dense(q, 2 * TOP_K).select("query_id", "chunk_id", "rank", "score")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = indexed(spark, sf_dir)
    return index.bm25(q, 2 * TOP_K).select("query_id", "chunk_id", "rank", "score")


def graph_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = indexed(spark, sf_dir)
    return index.graph(q).select("query_id", "chunk_id", "rank", "score")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rrf(dense_search(spark, sf_dir), bm25_search(spark, sf_dir), graph_match(spark, sf_dir))


def richest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fused result the row with a context prefix, though the dense channel has it for even pages only."""
    index, _ = indexed(spark, sf_dir)
    with_prefix = lambda c: index.contents(c.select("query_id", "chunk_id", "rank"), "context_prefix", "page_number")
    dense = with_prefix(dense_search(spark, sf_dir)).withColumn("context_prefix", F.when(F.col("page_number") % 2 == 0, F.col("context_prefix"))).withColumn("channel", F.lit("dense"))
    others = [with_prefix(c).withColumn("channel", F.lit(n)) for n, c in (("bm25", bm25_search(spark, sf_dir)), ("graph", graph_match(spark, sf_dir)))]
    return search.richest(dense, *others).select("query_id", "chunk_id", "context_prefix", "channel", "rank")


def retrieval_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each question was routed: its intent, what the graph was asked, and the channels that gave anything."""
    _, q = indexed(spark, sf_dir)
    hit = graph_match(spark, sf_dir).select("query_id").distinct().withColumn("g", F.lit("+graph"))
    return q.join(hit, "query_id", "left").select("query_id", "intent", "entity", F.concat(F.lit("dense+bm25"), F.coalesce("g", F.lit("")), F.lit("_rrf_rerank")).alias("strategy"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels, fused and reranked: the flagship query."""
    index, q = indexed(spark, sf_dir)
    return search.rerank(rrf_fusion(spark, sf_dir), q, index.read("chunks").select("chunk_id", "content"), TOP_K)


def hybrid_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question alone, the first: what a user waits for."""
    index, q = indexed(spark, sf_dir)
    one = spark.createDataFrame([q.orderBy("query_id").first()], q.schema)
    fused = search.rrf(index.dense(one, 2 * TOP_K), index.bm25(one, 2 * TOP_K), index.graph(one))
    return search.rerank(fused, one, index.read("chunks").select("chunk_id", "content"), TOP_K)


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.confidence(hybrid_search(spark, sf_dir), indexed(spark, sf_dir)[1])


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir)[0].contents(hybrid_search(spark, sf_dir), "content", "document_id", "page_number", "section", "content_hash", "context_prefix")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.citations(_evidence(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.sources(_evidence(spark, sf_dir))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct evidence, context, offline answer and its groundedness for every query."""
    ev, q = answer.distinct_evidence(_evidence(spark, sf_dir)), indexed(spark, sf_dir)[1]
    text = ev.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), " ").alias("evidence"))
    got = answer.extractive_answer(ev, q).join(text, "query_id", "left").join(answer.context(ev), "query_id", "left")
    return answer.grounded(got).select("query_id", F.md5("answer").alias("answer_md5"), F.length("context").alias("context_chars"), "verification_status", "score")


def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child held against its section."""
    c = chunks_once(spark, sf_dir, "content", "parent_id")
    parent = c.where("parent_id is null").select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("evidence"))
    rows = c.where("parent_id is not null").select("chunk_id", "parent_id", F.col("content").alias("answer")).join(parent, "parent_id", "left")
    return answer.grounded(rows).select("chunk_id", "verification_status", "score")


def intent_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = [("probe_1", "  how to read   the diagram "), ("probe_2", "P2001 wired to AB-12?"), ("probe_3", "repair steps"), ("probe_4", "E-104"), ("probe_5", "hello")]
    rows = chunks_once(spark, sf_dir, "content").select("chunk_id", "content").unionByName(spark.createDataFrame(probes, "chunk_id string, content string"))
    clean = T.squeeze(F.col("content"))
    return rows.select("chunk_id", T.intent(clean).alias("intent"), F.array_join(T.entities(clean), ",").alias("entities"))


def policy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in ("RESTRICTED", "INTERNAL", "PUBLIC", "other", "")], "level string")
    return rows.select("level", F.array_join(policy.permitted(F.col("level")), ",").alias("permitted"))


def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by a policy's answer: a boolean, an object, a broken one, or none."""
    rows = [(x, s) for x in ("RESTRICTED", "INTERNAL", "PUBLIC") for s in ("true", "false", '{"allowed":true,"permitted_access_levels":["PUBLIC"]}', '{"allowed":true}', "{}", None)]
    d = spark.createDataFrame(rows, "level string, said string").withColumn("d", policy.decided(F.col("level"), F.col("said")))
    return d.select("level", "said", "d.allowed", F.array_join("d.levels", ",").alias("levels"))


def acl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = policy.secured(chunks_once(spark, sf_dir, *ACCESS), queries_for(spark, sf_dir))
    return seen.groupBy("query_id", "access_classification").agg(F.count("*").alias("n"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = lambda n: F.coalesce(n, F.lit(""))
    return d.select("doc_id", T.security_key(c("tenant_id"), c("assistant_id"), c("knowledge_base_id"), F.coalesce("version", F.lit(1)), F.lit("INTERNAL"), c("file_name")).alias("key"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search over the labelled vectors; a result of the query's label is relevant."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    found = dense_topk(spark, sf_dir).where("query_id <> vec_id")
    lab = e.select("vec_id", "label")
    both = found.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return control.retrieval_metrics(both.select("query_id", "rank", (F.col("label") == F.col("ql")).alias("relevant")), 5)


TOK = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}_]+')"
SEEN = "seen AS (SELECT q.query_id, c.chunk_id FROM chunks_once c JOIN queries q ON c.tenant_id = q.tenant_id AND list_contains(q.levels, coalesce(c.access_classification, 'INTERNAL')))"
QV = "qv AS (SELECT q.query_id, (SELECT arg_min(u.vector, c.chunk_id) FROM chunks_once c JOIN usable u USING (chunk_id) WHERE c.tenant_id = q.tenant_id) AS v FROM queries q)"
STRATEGY = "SELECT q.query_id, q.intent, q.entity, 'dense+bm25' || CASE WHEN q.query_id IN (SELECT query_id FROM gr) THEN '+graph' ELSE '' END || '_rrf_rerank' AS strategy FROM queries q"
RICHEST = """r AS (SELECT l.query_id, l.chunk_id, l.rank, l.l, CASE WHEN l.l > 0 OR c.page_number % 2 = 0 THEN c.context_prefix END AS p FROM lists l JOIN chunks_once c USING (chunk_id))
SELECT query_id, chunk_id, p AS context_prefix, ['dense','bm25','graph'][l + 1] AS channel, rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY coalesce(p, '') = '', l, rank) = 1"""
ANSWERS = rf"""dist AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS no FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN coalesce(content_hash, '') = '' THEN chunk_id ELSE content_hash END, coalesce(content_hash, '') = '' ORDER BY rank) = 1)),
ctx AS (SELECT query_id, string_agg('[Source ' || no || ' - Chunk ' || chunk_id || ' - Page ' || coalesce(CAST(page_number AS VARCHAR), 'None') || CASE WHEN coalesce(context_prefix, '') <> '' THEN ' [' || context_prefix || ']' ELSE '' END || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY no) AS context, string_agg(content, ' ' ORDER BY no) AS evidence, arg_min(content, no) AS best FROM dist GROUP BY query_id),
an AS (SELECT q.query_id, coalesce(x.best, 'No relevant evidence was found to answer your question.') AS a, x.context, lower(x.evidence) AS ev FROM queries q LEFT JOIN ctx x USING (query_id)),
aw AS (SELECT *, lower(a) AS low, list_filter(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 3) AS ws FROM an), ar AS (SELECT *, contains(low, 'no relevant evidence') OR contains(low, 'insufficient evidence') OR len(ws) = 0 AS easy, len(list_filter(ws, lambda x: contains(ev, x))) / len(ws) AS ratio FROM aw)
SELECT query_id, md5(a) AS answer_md5, CAST(length(context) AS INTEGER) AS context_chars, CASE WHEN ev IS NULL THEN 'UNSUPPORTED' WHEN easy OR ratio >= 0.6 THEN 'SUPPORTED' WHEN ratio >= 0.35 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS verification_status, CASE WHEN ev IS NULL THEN 0.0 WHEN easy THEN 1.0 ELSE round(ratio, 2) END AS score FROM ar"""
DENSE = """dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
  (SELECT s.query_id, s.chunk_id, round(list_cosine_similarity(u.vector, qv.v), 6) AS score FROM seen s JOIN usable u USING (chunk_id) JOIN qv USING (query_id) WHERE qv.v IS NOT NULL) QUALIFY rank <= 20)"""
BM = f"""kids AS (SELECT * FROM chunks_once WHERE parent_id IS NOT NULL), toks AS (SELECT chunk_id, {TOK % 'content'} AS t FROM kids), tot AS (SELECT count(*) AS n, avg(len(t)) AS a FROM toks),
tf AS (SELECT term, chunk_id, sz, count(*) AS tf FROM (SELECT chunk_id, len(t) AS sz, unnest(t) AS term FROM toks) GROUP BY ALL), ask AS (SELECT DISTINCT query_id, unnest({TOK % 'text'}) AS term FROM queries),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sc AS (SELECT a.query_id, f.chunk_id, round(sum(ln(1 + ((SELECT n FROM tot) - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.sz / (SELECT a FROM tot)))), 6) AS score
  FROM tf f JOIN dfs d USING (term) JOIN ask a USING (term) GROUP BY ALL),
bm AS (SELECT sc.query_id, sc.chunk_id, sc.score, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.chunk_id) AS rank FROM sc JOIN seen USING (query_id, chunk_id) QUALIFY rank <= 20)"""
GRAPH = """gr AS (SELECT s.query_id, s.chunk_id, 0.8::DOUBLE AS score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.chunk_id) AS rank FROM seen s JOIN kids k USING (chunk_id) JOIN queries q USING (query_id)
  WHERE contains(k.hierarchy_path, q.entity) OR contains(k.chunk_id, q.entity) QUALIFY rank <= 20)"""
FUSED = """lists AS (SELECT query_id, chunk_id, rank, 0 AS l FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bm UNION ALL SELECT query_id, chunk_id, rank, 2 FROM gr),
agg AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS raw, min(l * 1000 + rank) AS first FROM lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, first, chunk_id) AS rank, round(raw, 5) AS score FROM agg QUALIFY rank <= 30)"""
HYBRID = f"""cov AS (SELECT f.query_id, f.chunk_id, f.rank AS fr, list_distinct({TOK % 'q.text'}) AS qt, {TOK % 'c.content'} AS ct FROM fused f JOIN queries q USING (query_id) JOIN chunks_once c USING (chunk_id)),
hyb AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr) AS rank, score FROM (SELECT query_id, chunk_id, fr, round(len(list_filter(qt, lambda x: list_contains(ct, x))) / len(qt), 4) AS score FROM cov) QUALIFY rank <= 10)"""
HEAD = f"WITH {CHUNKS_ONCE}, {ASKED}, {USABLE}, {SEEN}, {QV}, {DENSE}, {BM}, {GRAPH}, {FUSED}, {HYBRID}"
EVID = "ev AS (SELECT h.query_id, h.rank, c.* EXCLUDE (created_at) FROM hyb h JOIN chunks_once c USING (chunk_id))"
TOPK = """s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
top AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, score FROM s QUALIFY rank <= 10)"""
GROUND = rf"""list_filter({TOK % 'a'}, lambda w: length(w) > 3)"""


def _sql() -> dict[str, str]:
    from .etl import SQUEEZE

    intents = f"""WITH {CHUNKS_ONCE}, r AS (SELECT chunk_id, content FROM chunks_once UNION ALL VALUES ('probe_1','  how to read   the diagram '),('probe_2','P2001 wired to AB-12?'),('probe_3','repair steps'),('probe_4','E-104'),('probe_5','hello')),
      c AS (SELECT chunk_id, {SQUEEZE % 'content'} AS q FROM r) SELECT chunk_id, {intent_sql("q")} AS intent, array_to_string(regexp_extract_all(q, '{T.ENTITY}'), ',') AS entities FROM c"""
    grounded = f"""WITH {CHUNKS_ONCE}, p AS (SELECT chunk_id AS parent_id, lower(content) AS ev FROM chunks_once WHERE parent_id IS NULL), k AS (SELECT c.chunk_id, c.content AS a, p.ev FROM chunks_once c LEFT JOIN p USING (parent_id) WHERE c.parent_id IS NOT NULL),
      w AS (SELECT chunk_id, ev, lower(a) AS low, {GROUND} AS ws FROM k), r AS (SELECT *, contains(low, 'no relevant evidence') OR contains(low, 'insufficient evidence') OR len(ws) = 0 AS easy, len(list_filter(ws, lambda x: contains(ev, x))) / len(ws) AS ratio FROM w)
      SELECT chunk_id, CASE WHEN ev IS NULL THEN 'UNSUPPORTED' WHEN easy OR ratio >= 0.6 THEN 'SUPPORTED' WHEN ratio >= 0.35 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS verification_status,
      CASE WHEN ev IS NULL THEN 0.0 WHEN easy THEN 1.0 ELSE round(ratio, 2) END AS score FROM r"""
    return {
        "dense_topk": f"WITH {TOPK} SELECT query_id, vec_id, rank, score FROM top",
        "dense_search": f"{HEAD} SELECT query_id, chunk_id, rank, score FROM dense",
        "bm25_search": f"{HEAD} SELECT query_id, chunk_id, rank, score FROM bm",
        "graph_match": f"{HEAD} SELECT query_id, chunk_id, rank, score FROM gr",
        "rrf_fusion": f"{HEAD} SELECT query_id, chunk_id, rank, score FROM fused",
        "hybrid_search": f"{HEAD} SELECT query_id, chunk_id, rank, score FROM hyb",
        "hybrid_single": f"{HEAD} SELECT query_id, chunk_id, rank, score FROM hyb WHERE query_id = (SELECT min(query_id) FROM queries)",
        "search_index": f"WITH {CHUNKS_ONCE}, t AS (SELECT DISTINCT chunk_id, unnest({TOK % 'content'}) AS term FROM chunks_once WHERE parent_id IS NOT NULL) SELECT term, count(*) AS df FROM t GROUP BY term",
        "retrieval_strategy": f"{HEAD} {STRATEGY}",
        "richest_evidence": f"{HEAD}, {RICHEST}",
        "answers": f"{HEAD}, {EVID}, {ANSWERS}",
        "policy_decisions": """WITH l(level) AS (VALUES ('RESTRICTED'),('INTERNAL'),('PUBLIC')), s(said) AS (VALUES ('true'),('false'),('{"allowed":true,"permitted_access_levels":["PUBLIC"]}'),('{"allowed":true}'),('{}'),(NULL))
          SELECT level, said, said IS NULL OR said = 'true' OR contains(said, '"allowed":true') AS allowed, CASE WHEN said IS NULL AND level = 'PUBLIC' OR contains(said, '["PUBLIC"]') THEN 'PUBLIC' WHEN level = 'RESTRICTED' AND (said IS NULL OR said IN ('true', 'false')) THEN 'PUBLIC,INTERNAL,RESTRICTED' ELSE 'PUBLIC,INTERNAL' END AS levels FROM l, s""",
        "confidence": f"{HEAD} SELECT q.query_id, CASE WHEN coalesce(max(h.score), 0) >= 0.75 THEN 'HIGH' WHEN coalesce(max(h.score), 0) >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level, round(coalesce(max(h.score), 0), 3) AS score, CASE WHEN max(h.score) IS NULL THEN 'No evidence retrieved' ELSE printf('%s evidence score (%.2f)', CASE WHEN max(h.score) >= 0.75 THEN 'Strong top' WHEN max(h.score) >= 0.45 THEN 'Moderate top' ELSE 'Weak' END, max(h.score)) END AS reason FROM queries q LEFT JOIN hyb h USING (query_id) GROUP BY q.query_id",
        "citations": f"{HEAD}, {EVID} SELECT query_id, rank, document_id, page_number, section, chunk_id, CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS snippet FROM ev",
        "sources": f"{HEAD}, {EVID} SELECT query_id, document_id, page_number, row_number() OVER (PARTITION BY query_id ORDER BY first) AS source_no FROM (SELECT query_id, document_id, page_number, min(rank) AS first FROM ev GROUP BY ALL)",
        "groundedness": grounded,
        "intent_entities": intents,
        "policy_levels": "SELECT * FROM (VALUES ('RESTRICTED','PUBLIC,INTERNAL,RESTRICTED'),('INTERNAL','PUBLIC,INTERNAL'),('PUBLIC','PUBLIC'),('other','PUBLIC'),('','PUBLIC')) v(level, permitted)",
        "acl_visible": f"WITH {CHUNKS_ONCE}, {ASKED}, {SEEN} SELECT s.query_id, coalesce(c.access_classification, 'INTERNAL') AS access_classification, count(*) AS n FROM seen s JOIN chunks_once c USING (chunk_id) GROUP BY ALL",
        "cache_keys": f"SELECT doc_id, sha256('query_res::' || coalesce(tenant_id, '') || '::' || coalesce(assistant_id, '') || '::' || coalesce(knowledge_base_id, '') || '::v' || coalesce(version, 1) || '::INTERNAL::' || substr(sha256(trim(lower(coalesce(file_name, '')))), 1, 16)) AS key FROM documents",
        "eval_metrics": f"""WITH {TOPK}, r AS (SELECT t.query_id, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank) AS rank, a.label = b.label AS relevant FROM top t JOIN embeddings a ON a.vec_id = t.vec_id JOIN embeddings b ON b.vec_id = t.query_id WHERE t.query_id <> t.vec_id),
          p AS (SELECT query_id, count(*) FILTER (relevant) AS hits, min(rank) FILTER (relevant) AS first FROM r WHERE rank <= 5 GROUP BY query_id)
          SELECT count(*) AS queries, round(avg((hits > 0)::INT), 6) AS recall_at_k, round(avg(hits / 5.0::DOUBLE), 6) AS precision_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM p""",
    }


QUERIES = {f.__name__: f for f in (dense_topk, dense_search, bm25_search, graph_match, rrf_fusion, richest_evidence, retrieval_strategy, search_index, hybrid_search, hybrid_single, confidence, citations, sources, answers, groundedness, intent_entities, policy_levels, policy_decisions, acl_visible, cache_keys, eval_metrics)}
SQL = _sql()
