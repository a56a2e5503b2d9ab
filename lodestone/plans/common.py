"""Tables of a data folder and the batch of queries that the retrieval plans ask."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.policy import permitted
from ..operators.tables import latest
from ..session import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: ``df`` written to the folder all executors share and read back, so that it is computed once."""
    path = f"{shared_root(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunks with each chunk_id once, as stored last."""
    rows = table(spark, sf_dir, "chunks").where("chunk_id is not null")
    return latest(rows.select("chunk_id", "created_at", *[c for c in columns if c not in ("chunk_id", "created_at")]), "chunk_id", "created_at")


CHUNKS_ONCE = "chunks_once AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST) = 1)"

TEXTS = ("drain plug of the feed pump under pressure", "Welche Schmierleitung hat das Getriebegehäuse in der Lackiererei")
#: Words that stand after the id of a record in the questions of every third tenant.
ABOUT = " seal ring error"
TOP_K = 10


def routed(queries: DataFrame) -> DataFrame:
    """``queries`` with their intent and the ``entity`` that the graph is asked for: the first one named, else the first 30 characters;
    none unless a question is about relations or technical terms."""
    q = queries.withColumn("clean", T.squeeze(F.col("text"))).withColumn("intent", T.intent(F.col("clean")))
    first = F.coalesce(F.try_element_at(T.entities(F.col("clean")), F.lit(1)), F.substring("clean", 1, 30))
    return q.withColumn("entity", F.when(F.col("intent").isin("RELATIONSHIP", "TECHNICAL"), first)).drop("clean")


def queries_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each tenant: (query_id, text, tenant_id, knowledge_base_id, level, levels, intent, entity)."""
    t = table(spark, sf_dir, "documents").where("tenant_id is not null").groupBy("tenant_id").agg(F.min("id").alias("first"))
    k = F.length("tenant_id") % 3
    text = F.when(k == 0, F.concat("first", F.lit(ABOUT))).when(k == 1, TEXTS[0]).otherwise(TEXTS[1])
    level = F.when(k == 0, "RESTRICTED").when(k == 1, "INTERNAL").otherwise("PUBLIC")
    q = t.select(F.concat(F.lit("q_"), "tenant_id").alias("query_id"), text.alias("text"), "tenant_id", F.lit(None).cast("string").alias("knowledge_base_id"), level.alias("level"))
    return routed(q).withColumn("levels", permitted(F.col("level")))


def intent_sql(q: str) -> str:
    cases = []
    for name, needles in T.INTENTS:
        test = " OR ".join(f"contains(lower({q}), '{n}')" for n in needles)
        cases.append(f"WHEN {test}" + (f" OR regexp_matches(lower({q}), '{T.TECHNICAL_TERM}')" if name == "TECHNICAL" else "") + f" THEN '{name}'")
    return "CASE " + " ".join(cases) + " ELSE 'FACTUAL' END"


QUERIES = f"""asked AS (SELECT 'q_' || tenant_id AS query_id, CASE length(tenant_id) % 3 WHEN 0 THEN first || '{ABOUT}' WHEN 1 THEN '{TEXTS[0]}' ELSE '{TEXTS[1]}' END AS text, tenant_id,
  CASE length(tenant_id) % 3 WHEN 0 THEN ['PUBLIC','INTERNAL','RESTRICTED'] WHEN 1 THEN ['PUBLIC','INTERNAL'] ELSE ['PUBLIC'] END AS levels FROM (SELECT tenant_id, min(id) AS first FROM documents WHERE tenant_id IS NOT NULL GROUP BY tenant_id)),
queries AS (SELECT *, CASE WHEN intent IN ('RELATIONSHIP','TECHNICAL') THEN coalesce(regexp_extract_all(text, '{T.ENTITY}')[1], substr(text, 1, 30)) END AS entity FROM (SELECT *, {intent_sql('text')} AS intent FROM asked))"""


def usable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, vector) of the vectors that can be compared, each chunk once."""
    rows = table(spark, sf_dir, "chunk_vectors").where("chunk_id is not null and vector is not null and size(vector) = 64")
    fine = rows.where("not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)")
    return latest(fine.select("chunk_id", "created_at", "vector"), "chunk_id", "created_at").drop("created_at")


USABLE = """usable AS (SELECT chunk_id, vector::DOUBLE[] AS vector FROM chunk_vectors WHERE chunk_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(vector, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST) = 1)"""
