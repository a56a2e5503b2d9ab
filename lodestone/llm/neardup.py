"""Problem 5: near-duplicate chunks with small edits.

Tensored banding: two small collections of hash values, each value made of ``ROWS`` minhashes, are computed for each
text, and a table key is formed for every pair of one value from either collection. ``LEFT`` x ``RIGHT`` tables thus cost
``(LEFT + RIGHT) * ROWS`` minhashes instead of ``LEFT * RIGHT * 2 * ROWS``. Two texts of likeness j share a key with
probability (1 - (1 - j^ROWS)^LEFT) * (1 - (1 - j^ROWS)^RIGHT). Pairs of a bucket are first held against each
other by a sketch of their minhashes, then by bounds that lose none (sizes and parities of the sets of word pairs), and
verified exactly on the whole texts; keys of very many classes go through an exact prefix join instead of all their pairs.

Defined cases: null contents and contents of fewer than 40 words are in no pair; equal contents count as likeness 1;
a chunk stored several times counts once; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table
from .shingle import LIKENESS, candidates, enough_words, minhash, mixed, possible, sketched, verified

ROWS, LEFT, RIGHT = 2, 8, 8
#: Copies of a content on average beyond which contents are made distinct before they get keys; members in one list.
COPIES, LISTED = 2, 1024


def tensor_keys(pairs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sig = minhash(pairs, starts, (LEFT + RIGHT) * ROWS)
    with np.errstate(over="ignore"):
        value = mixed(sig[:, ::2] * np.uint64(3) + sig[:, 1::2] + np.arange(LEFT + RIGHT, dtype=np.uint64))
        keys = (value[:, :LEFT, None] * np.uint64(5) + value[:, None, LEFT:]).reshape(len(sig), -1)
    return keys, sketched(sig)


def near_classes(chunks: DataFrame, likeness: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """Members (chunk_id, cls, several) of the classes of equal content, and pairs (a, b, likeness) of near classes.

    ``several``: the chunk is stored with different contents, so it is in several classes.
    """
    child = chunks.where(F.col("parent_id").isNotNull() & F.col("content").isNotNull() & F.col("chunk_id").isNotNull())
    child = child.select("chunk_id", F.xxhash64("content").alias("cls"), F.col("content").alias("text"))
    own = child.where(enough_words(F.col("text"))).select("chunk_id", "cls").repartition("chunk_id").dropDuplicates(["chunk_id", "cls"])
    members = stored(own.withColumn("several", F.count("*").over(Window.partitionBy("chunk_id")) > 1), "p5-members")
    texts = child.select(F.lit(0).cast("bigint").alias("scope"), "cls", "text")
    n, different = members.agg(F.count("*"), F.approx_count_distinct("cls")).first()
    if n > COPIES * different:  # else sending all texts costs more than the keys of the copies
        texts = stored(texts.dropDuplicates(["cls"]), "p5-contents")
    close, own = possible(candidates(texts, tensor_keys, "p5", likeness), texts, "p5", likeness)
    return members, verified(close, own, likeness)


def near_pairs(chunks: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(chunk_id_a, chunk_id_b, likeness) of different chunks, copies included.

    Classes of many copies make far more pairs of chunks than of classes: these are written as they come, from lists of
    ``LISTED`` members, and only those of chunks in several classes are made distinct.
    """
    members, near = near_classes(chunks, likeness)
    copies = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("likeness"))
    every = stored(near.unionByName(copies), "p5-near")
    part = F.floor((F.row_number().over(Window.partitionBy("cls").orderBy("chunk_id")) - 1) / LISTED)
    lists = members.withColumn("part", part).groupBy("cls", "part").agg(F.collect_list(F.struct("chunk_id", "several")).alias("m"))
    both = every.join(lists.select(F.col("cls").alias("a"), F.col("m").alias("xs")), "a").join(lists.select(F.col("cls").alias("b"), F.col("m").alias("ys")), "b")
    out = both.withColumn("x", F.explode("xs")).drop("xs").withColumn("y", F.explode("ys"))
    x, y = F.col("x.chunk_id"), F.col("y.chunk_id")
    out = out.where((x < y) | ((F.col("a") != F.col("b")) & (x > y)))
    pair = [F.least(x, y).alias("chunk_id_a"), F.greatest(x, y).alias("chunk_id_b"), "likeness"]
    several = F.col("x.several") | F.col("y.several")
    again = out.where(several).select(*pair).groupBy("chunk_id_a", "chunk_id_b").agg(F.max("likeness").alias("likeness"))
    return out.where(~several).select(*pair).unionByName(again)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "chunks")).select("chunk_id_a", "chunk_id_b")
