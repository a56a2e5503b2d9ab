"""What is made of retrieved evidence: citations, sources, prompt context, groundedness, an offline answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_terms, snippet


def citations(evidence: DataFrame) -> DataFrame:
    """One row for each result (query_id, rank, document_id, page_number, section, chunk_id, content), with a snippet."""
    return evidence.select("query_id", "rank", "document_id", "page_number", "section", "chunk_id", snippet(F.col("content")).alias("snippet"))


def sources(evidence: DataFrame) -> DataFrame:
    """Different documents and pages in the order in which they are first seen."""
    seen = evidence.groupBy("query_id", "document_id", "page_number").agg(F.min("rank").alias("first"))
    return seen.withColumn("source_no", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """The first result of each content hash; results without a hash all stay."""
    blank = F.coalesce("content_hash", F.lit("")) == ""
    rank = F.row_number().over(Window.partitionBy("query_id", F.when(blank, F.col("chunk_id")).otherwise(F.col("content_hash")), blank).orderBy("rank"))
    return evidence.withColumn("n", rank).where("n = 1").drop("n")


def context(evidence: DataFrame) -> DataFrame:
    """(query_id, context): the evidence as numbered blocks, in order; top-k bounds each group."""
    prefix = F.when(F.coalesce("context_prefix", F.lit("")) != "", F.concat(F.lit(" ["), F.col("context_prefix"), F.lit("]"))).otherwise("")
    block = F.concat(F.lit("[Source "), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")), F.lit(" - Chunk "), F.col("chunk_id"), F.lit(" - Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("None")), prefix, F.lit("]\n"), F.col("content"))
    listed = F.sort_array(F.collect_list(F.struct("rank", "b")))
    return evidence.withColumn("b", block).groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("context"))


def distinct_rows(results: list[dict]) -> list[dict]:
    """``distinct_evidence`` for the few results of one question."""
    seen: set[str] = set()
    out = []
    for r in results:
        h = r.get("content_hash") or ""
        if not h or h not in seen:
            out.append(r)
        seen.add(h)
    return out


def cited(results: list[dict]) -> tuple[list[dict], list[dict]]:
    """``citations`` and ``sources`` for the few results of one question."""
    cut = lambda t: t[:150] + "..." if len(t or "") > 150 else t
    cites = [{k: r.get(k) for k in ("document_id", "page_number", "section", "chunk_id")} | {"snippet": cut(r["content"])} for r in results]
    pages = dict.fromkeys((r.get("document_id"), r.get("page_number")) for r in results)
    return cites, [{"document_id": d, "page_number": p, "source_no": i} for i, (d, p) in enumerate(pages, 1)]


NO_EVIDENCE = "No relevant evidence was found to answer your question."


def extractive_answer(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer): the best result's content, or the fixed sentence; stands in for a language model."""
    best = evidence.groupBy("query_id").agg(F.min_by("content", "rank").alias("answer"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NO_EVIDENCE)).alias("answer"))


def ratio(answer: Column, evidence: Column) -> Column:
    """Share of the answer's words of more than three letters that the evidence contains; null if it has none."""
    w = F.filter(search_terms(answer), lambda x: F.length(x) > 3)
    # one element arrays bind the words and the lower-cased evidence once, outside the loop over words
    held = F.array(F.struct(w.alias("w"), F.lower(evidence).alias("ev")))
    share = F.transform(held, lambda h: F.when(F.size(h["w"]) > 0, F.size(F.filter(h["w"], lambda x: F.contains(h["ev"], x))) / F.size(h["w"])))
    return F.element_at(share, 1)


def grounded(rows: DataFrame) -> DataFrame:
    """``rows`` (answer, evidence) with verification_status and score."""
    low = F.lower("answer")
    admits = F.contains(low, F.lit("no relevant evidence")) | F.contains(low, F.lit("insufficient evidence"))
    r = ratio(F.col("answer"), F.col("evidence"))
    status = F.when(F.col("evidence").isNull(), "UNSUPPORTED").when(admits | r.isNull() | (r >= 0.6), "SUPPORTED").when(r >= 0.35, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    score = F.when(F.col("evidence").isNull(), 0.0).when(admits | r.isNull(), 1.0).otherwise(F.round(r, 2))
    return rows.withColumn("verification_status", status).withColumn("score", score)
