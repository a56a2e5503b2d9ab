"""Hierarchical chunking: lines packed into sections, sections cut into children, tables and figures of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, chunk_hash, strip, word_count

PARENT_WORDS = 768  # a section is closed when it has as many words
CHILD_WORDS = 144


def line_blocks(text: Column) -> Column:
    """The trimmed non-blank lines of a text."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def pack(blocks: Column, most: int = PARENT_WORDS) -> Column:
    """Sections of a page as strings: blocks are added until ``most`` words are reached; the block that crosses stays.

    The accumulator holds the numbers of the blocks that close a section, not their texts, so a page costs what it is long.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("ends"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def add(acc: Column, w: Column) -> Column:
        full = acc["n"] + w >= most
        return F.struct(F.when(full, F.concat(acc["ends"], F.array(acc["i"] + 1))).otherwise(acc["ends"]).alias("ends"), (acc["i"] + 1).alias("i"), F.when(full, F.lit(0)).otherwise(acc["n"] + w).alias("n"))

    def close(acc: Column) -> Column:
        return F.when(F.coalesce(F.try_element_at(acc["ends"], F.lit(-1)), F.lit(0)) < acc["i"], F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"])

    ends = F.aggregate(F.transform(blocks, word_count), start, add, close)
    # ends is bound once, as the only element of an array
    held = F.array(F.struct(ends.alias("e")))
    cut = lambda e, k: F.array_join(F.slice(blocks, F.when(k == 0, F.lit(0)).otherwise(F.element_at(e, F.greatest(k, F.lit(1)))) + 1, F.element_at(e, k + 1) - F.when(k == 0, F.lit(0)).otherwise(F.element_at(e, F.greatest(k, F.lit(1))))), " ")
    return F.element_at(F.transform(held, lambda h: F.transform(h["e"], lambda _, k: cut(h["e"], k))), 1)


def sections(pages: DataFrame) -> DataFrame:
    """Parents of ``pages`` (document_id, filename, page_number, blocks)."""
    cut = pages.select("*", F.posexplode(pack(F.col("blocks"))).alias("i", "content"))
    page = F.concat(F.col("document_id"), F.lit("::p"), F.col("page_number"))
    return cut.select(
        "document_id",
        F.concat(page, F.lit("::s"), F.col("i")).alias("chunk_id"),
        F.lit(None).cast("string").alias("parent_id"),
        "content",
        chunk_hash(F.col("content")).alias("content_hash"),
        F.concat(F.lit("Section "), F.col("i") + 1).alias("section"),
        F.concat(F.col("filename"), F.lit(" > Page "), F.col("page_number"), F.lit(" > Section "), F.col("i") + 1).alias("context_prefix"),
        "page_number",
        F.concat(F.lit("doc.page"), F.col("page_number"), F.lit(".section"), F.col("i")).alias("hierarchy_path"),
        F.lit("TEXT").alias("chunk_type"),
    )


def children(parents: DataFrame, size: int = CHILD_WORDS) -> DataFrame:
    """Windows of ``size`` words of each parent, without overlap."""
    w = F.filter(F.split("content", f"{SPACE}+"), lambda x: x != "")
    cut = parents.withColumn("w", w).where(F.size("w") > 0)
    window = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), lambda j: F.array_join(F.slice(F.col("w"), j * size + 1, size), " "))
    cut = cut.select("*", F.posexplode(window).alias("j", "child"))
    return cut.select(
        "document_id",
        F.concat(F.col("chunk_id"), F.lit("::c"), F.col("j")).alias("chunk_id"),
        F.col("chunk_id").alias("parent_id"),
        F.col("child").alias("content"),
        chunk_hash(F.col("child")).alias("content_hash"),
        "section",
        F.concat(F.col("context_prefix"), F.lit(" > Chunk "), F.col("j")).alias("context_prefix"),
        "page_number",
        F.concat(F.col("hierarchy_path"), F.lit(".child"), F.col("j")).alias("hierarchy_path"),
        "chunk_type",
    )


def all_chunks(pages: DataFrame) -> DataFrame:
    """Sections, children, tables and figures of ``pages`` (document_id, filename, page_number, blocks, tables, figures)."""
    # sections are needed twice, children come from their contents
    parents = sections(pages.select("document_id", "filename", "page_number", "blocks"))
    own = ("document_id", "chunk_id", "parent_id", "content", "content_hash", "section", "context_prefix", "page_number", "hierarchy_path", "chunk_type")
    out = parents.select(*own).unionByName(children(parents).select(*own)).withColumn("embedding_representation", F.lit("text"))
    none = F.lit(None).cast("string").alias("parent_id")
    media = [c.withColumn("parent_id", none).withColumn("embedding_representation", F.lit("text") if "embedding_representation" not in c.columns else F.col("embedding_representation")) for c in (table_chunks(pages), figure_chunks(pages))]
    for c in media:
        out = out.unionByName(c.select(*own, "embedding_representation"))
    return out.dropDuplicates(["chunk_id"])


def table_chunks(pages: DataFrame) -> DataFrame:
    """One chunk for each table of ``pages`` (document_id, filename, page_number, tables array<struct<markdown,bbox>>)."""
    cut = pages.select("*", F.explode("tables").alias("t")).withColumn("md", F.coalesce(F.col("t.markdown"), F.lit("")))
    digest = chunk_hash(F.col("md"))
    short = F.substring(digest, 1, 12)
    return cut.select(
        "document_id",
        F.concat(F.col("document_id"), F.lit("::p"), F.col("page_number"), F.lit("::t"), short).alias("chunk_id"),
        F.col("md").alias("content"),
        digest.alias("content_hash"),
        F.concat(F.lit("Table Page "), F.col("page_number")).alias("section"),
        F.concat(F.col("filename"), F.lit(" > Page "), F.col("page_number"), F.lit(" > Table "), short).alias("context_prefix"),
        "page_number",
        F.concat(F.lit("doc.page"), F.col("page_number"), F.lit(".table_"), short).alias("hierarchy_path"),
        F.lit("TABLE").alias("chunk_type"),
    )


def figure_chunks(pages: DataFrame) -> DataFrame:
    """One chunk for each figure that has a caption, an analysis or at least an image.

    ``figures``: array<struct<image_path,caption,summary,components array<string>>>; a null summary is no analysis.
    """
    cut = pages.select("*", F.explode("figures").alias("f"))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    seen = F.col("f.summary").isNotNull() | (F.size("f.components") > 0)
    parts = F.array_compact(
        F.array(
            F.when(some(F.col("f.caption")), F.concat(F.lit("Caption: "), F.col("f.caption"))),
            F.when(some(F.col("f.summary")), F.concat(F.lit("Description: "), F.col("f.summary"))),
            F.when(F.size("f.components") > 0, F.concat(F.lit("Components: "), F.array_join("f.components", ", "))),
        )
    )
    cut = cut.withColumn("parts", parts).where((F.size("parts") > 0) | some(F.col("f.image_path")))
    cut = cut.withColumn("content", F.when(F.size("parts") > 0, F.array_join("parts", "\n")).otherwise(F.concat(F.lit("Figure from page "), F.col("page_number"))))
    digest = chunk_hash(F.col("content"))
    short = F.substring(digest, 1, 12)
    return cut.select(
        "document_id",
        F.concat(F.col("document_id"), F.lit("::p"), F.col("page_number"), F.lit("::f"), short).alias("chunk_id"),
        "content",
        digest.alias("content_hash"),
        F.concat(F.lit("Figure Page "), F.col("page_number")).alias("section"),
        F.concat(F.col("filename"), F.lit(" > Page "), F.col("page_number"), F.lit(" > Figure "), short).alias("context_prefix"),
        "page_number",
        F.when(seen, "DIAGRAM").otherwise("IMAGE").alias("chunk_type"),
        F.when(some(F.col("f.image_path")), "image").otherwise("text_summary_of_image").alias("embedding_representation"),
        F.concat(F.lit("doc.page"), F.col("page_number"), F.lit(".figure_"), short).alias("hierarchy_path"),
    )


def box_union(boxes: Column) -> Column:
    """Union of the boxes with four coordinates or more; null when there is none."""
    good = F.filter(boxes, lambda b: F.size(b) >= 4)
    side = lambda k, f: f(F.transform(good, lambda b: F.element_at(b, k)))
    return F.when(F.size(good) > 0, F.array(side(1, F.array_min), side(2, F.array_min), side(3, F.array_max), side(4, F.array_max)))
