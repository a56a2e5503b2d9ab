"""Problem 7: new batches against everything already accepted, by a prefix-tree hash forest.

Each text has a label of ``DEPTH`` levels in each of ``TREES`` trees; a level is a 16-bit hash of the path of minhashes down
to it, so the labels of a tree are its nodes written as sorted numbers and a prefix of a label is a node above. The forest
persists them as runs sorted by (tree, label), one run a batch. A new batch is located by range search: a node of depth d
covers the labels that share the d leading levels. The search starts at whole labels and widens, level by level, until
nodes of that depth find a pair of the likeness asked for with at least the wanted recall; whole labels are stored, so an
index can be asked at any likeness later. Runs are merged ``FAN`` at a time, so a label is rewritten a logarithmic number
of times, and the folder itself is the manifest: a run is named after the batches it covers and counts once its _SUCCESS is there.

A batch costs its own texts, one narrow scan of the stored labels (never of texts) and the verification of its candidates.
What the scan keeps is what a bitmap of the batch's nodes lets through; the bitmap has 16 bits a node and ``MOST_BITS`` at
most, and a batch with more nodes is searched in several passes, each over its own trees of the sorted runs, so that
the bitmap stays sparse. Only what it lets through is shuffled; the join on the node is one that adaptive execution splits
where a node is hot. Candidates are held against each other by a sketch inside that join.

Defined cases: null tenants, batches and texts take part in nothing; texts of fewer than 40 words match by file digest
only; digests count as equal in any letter case, with blanks around or the prefix ``sha256:``; anything that is not 64
hexadecimal digits is no digest; FAILED records of an earlier batch are not matched, a null status is accepted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, shared_dir, slices, stored, table
from .shingle import LIKENESS, NIBBLES, bigrams, minhash, mixed, sketched, verified

TREES, DEPTH, RECALL = 20, 4, 0.99
#: Runs of one level that are merged into one of the next.
FAN = 4
#: Bits of the bitmap of nodes: so many a node, at least, at most (32 MB).
BITS_A_NODE, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Nibbles of two sketches that must agree: of 32, 21.5 +- 2.6 agree at likeness 0.6.
AGREE = 14
_LEVEL = 64 // DEPTH
ENTRY = "tree tinyint, label bigint, cls bigint, s0 bigint, s1 bigint"


def depth_for(likeness: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Widens from whole labels until ``trees`` trees find a pair of the likeness with at least the wanted probability."""
    while depth > 1 and 1 - (1 - likeness**depth) ** trees < recall:
        depth -= 1
    return depth


def labels(pairs: np.ndarray, starts: np.ndarray, scope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, TREES) labels, and sketches; a scope has nodes of its own."""
    sig = minhash(pairs, starts, TREES * DEPTH, seed=11)
    own = sig.reshape(len(sig), TREES, DEPTH)
    path = mixed(scope.astype(np.int64).view(np.uint64))[:, None] + np.arange(TREES, dtype=np.uint64)
    out = np.zeros((len(sig), TREES), np.uint64)
    with np.errstate(over="ignore"):
        for d in range(DEPTH):
            path = mixed(path * np.uint64(31) + own[:, :, d])
            out = out << np.uint64(_LEVEL) | path >> np.uint64(64 - _LEVEL)
    return out.view(np.int64), sketched(sig[:, :: max(1, TREES * DEPTH // NIBBLES)])


def digest(col: Column) -> Column:
    """The 64 hexadecimal digits of a SHA-256 however it is written, else null."""
    bare = F.regexp_replace(F.lower(F.trim(col)), "^sha-?256[:=]\\s*", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def records(docs: DataFrame) -> DataFrame:
    kept = docs.where(F.col("tenant_id").isNotNull() & F.col("batch_no").isNotNull() & F.col("doc_id").isNotNull())
    return kept.select("doc_id", "tenant_id", F.xxhash64("tenant_id").alias("scope"), "batch_no", (F.coalesce("status", F.lit("")) != "FAILED").alias("accepted"), digest(F.col("sha256")).alias("digest"), F.xxhash64("tenant_id", "text").alias("cls"), "text")


def labelled(own: DataFrame) -> DataFrame:
    """``records`` without their texts, with cls null for short texts, labels array<bigint> and the sketch; one narrow pass."""
    names = ("doc_id", "tenant_id", "batch_no", "accepted", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cls, scope = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            _, first, back = np.unique(cls, return_index=True, return_inverse=True)  # copies are labelled once
            pairs, starts, which = bigrams([t or "" for t in b.column(7).take(pa.array(first)).to_pylist()])
            at = np.full(len(first), -1)
            at[which] = np.arange(len(which))
            at = at[back]
            long = at >= 0
            made, sketch = labels(pairs, starts, scope[first][which]) if len(which) else (np.zeros((0, TREES), np.int64), np.zeros((0, 2), np.uint64))
            sketch = sketch.view(np.int64)
            ends = np.where(long, TREES, 0)
            two = [np.where(long, sketch[np.maximum(at, 0), i], 0) if len(sketch) else np.zeros(len(at), np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(cls, mask=~long), list_array(made[at[long]].ravel(), ends, pa.int64()), pa.array(two[0]), pa.array(two[1])], [*names, "cls", "labels", "s0", "s1"])

    kinds = ", ".join(f"{n} {own.schema[n].dataType.simpleString()}" for n in names)
    return own.select(*names, "cls", "scope", "text").mapInArrow(run, f"{kinds}, cls bigint, labels array<bigint>, s0 bigint, s1 bigint")


def entries(rows: DataFrame) -> DataFrame:
    """The labels of each class of ``rows`` (cls, labels, s0, s1) as entries of the forest."""
    one = rows.where("cls is not null").groupBy("cls").agg(F.first("labels").alias("labels"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    return one.select(F.posexplode("labels").alias("tree", "label"), "cls", "s0", "s1").select(F.col("tree").cast("tinyint"), "label", "cls", "s0", "s1")


def _agreeing(a: str, b: str) -> Column:
    """Nibbles that agree in two words of sketches."""
    x = F.col(a).bitwiseXOR(F.col(b))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.lit(16) - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))


class HashForest:
    """The forest in a folder that all executors share; opening the same folder again gives the same index."""

    def __init__(self, spark: SparkSession, path: str | None = None, likeness: float = LIKENESS, recall: float = RECALL) -> None:
        self.spark, self.likeness, self.recall = spark, likeness, recall
        self.path = path or f"{shared_dir(spark)}/lodestone/forest-{uuid.uuid4().hex}"
        #: Bytes of stored labels that the last search read.
        self.read_bytes = 0

    def _folder(self, name: str = ""):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def runs(self) -> list[tuple[int, int]]:
        """First and last batch of the finished runs, without those that a merged run covers."""
        fs, at = self._folder()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        spans = sorted((int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"run-(\d+)-(\d+)", n)) and fs.exists(self._folder(f"{n}/_SUCCESS")[1]))
        return [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]

    def name(self, span: tuple[int, int]) -> str:
        return f"{self.path}/run-{span[0]:06d}-{span[1]:06d}"

    def read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*map(self.name, runs))

    def _write(self, rows: DataFrame, span: tuple[int, int]) -> None:
        rows.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label").write.mode("overwrite").option("compression", "zstd").parquet(self.name(span))

    def append(self, new: DataFrame) -> None:
        """Store the entries of one more batch, then merge the last runs while FAN of them are of one size."""
        runs = self.runs()
        k = runs[-1][1] + 1 if runs else 0
        self._write(new, (k, k))
        runs.append((k, k))
        while len(runs) >= FAN and len({b - a for a, b in runs[-FAN:]}) == 1:
            self.merge(runs[-FAN:])
            runs = self.runs()

    def merge(self, runs: list[tuple[int, int]]) -> None:
        """Adjacent runs as one; the old ones go when the new one is finished."""
        self._write(self.read(runs), (runs[0][0], runs[-1][1]))
        for span in runs:
            fs, at = self._folder(self.name(span).rpartition("/")[2])
            fs.delete(at, True)

    def search(self, new: DataFrame, likeness: float | None = None, size: int | None = None) -> DataFrame:
        """(new, old) classes that share a node of the depth the recall needs and agree in their sketches, to be verified.

        ``size`` is the number of entries or more, for the size of the bitmap; they are counted where it is not given.
        """
        runs = self.runs()
        self.read_bytes = 0
        out = self.spark.createDataFrame([], "new bigint, old bigint")
        if not runs:
            return out
        shift = _LEVEL * (DEPTH - depth_for(likeness or self.likeness, self.recall))
        node = F.shiftright("label", shift).alias("node")
        self.read_bytes = sum(fs.getContentSummary(at).getLength() for fs, at in (self._folder(self.name(s).rpartition("/")[2]) for s in runs))
        n = new.count() if size is None else size
        passes = min(TREES, max(1, -(-n * BITS_A_NODE // MOST_BITS)))
        bits = LEAST_BITS
        while bits < min(MOST_BITS, n // passes * BITS_A_NODE):
            bits *= 2
        bit = F.pmod(F.xxhash64("tree", "node"), F.lit(bits))
        for p in range(passes):
            trees = F.col("tree").between(p * TREES // passes, (p + 1) * TREES // passes - 1)
            mine = new.where(trees).select("tree", node, "cls", "s0", "s1")
            marks = mine.groupBy(F.bitmap_bucket_number(bit + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("m"))
            field = np.zeros(bits // 8, np.uint8)
            for r in marks.toLocalIterator():  # at most MOST_BITS / 32,768 rows of 4 KB
                part = np.frombuffer(bytes(r.m), np.uint8)
                field[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(part)] = part[: len(field) - (r.k - 1) * 4096]
            held = self.spark.sparkContext.broadcast(field)

            def marked(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                own = held.value
                for b in batches:
                    at = b.column(0).to_numpy()
                    few = np.flatnonzero(own[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    if len(few):
                        yield pa.RecordBatch.from_arrays([c.take(pa.array(few)) for c in b.columns[1:]], b.schema.names[1:])

            theirs = self.read(runs).where(trees).select("tree", node, "cls", "s0", "s1").select(bit.alias("bit"), "tree", "node", F.col("cls").alias("old"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
            theirs = theirs.mapInArrow(marked, "tree tinyint, node bigint, old bigint, t0 bigint, t1 bigint")
            met = mine.join(theirs, ["tree", "node"]).where((F.col("cls") != F.col("old")) & (_agreeing("s0", "t0") + _agreeing("s1", "t1") >= AGREE))
            out = out.unionByName(met.select(F.col("cls").alias("new"), "old"))
        return out.distinct()


def repeats(docs: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(earlier, later): for the records of every batch the accepted earlier records that they repeat.

    The batches go through a forest one after the other: searched, then appended. What a batch finds is stored; the texts of
    the candidates of all batches are verified together, and classes become records at last.
    """
    spark = docs.sparkSession
    own = records(docs)
    base = f"{shared_dir(spark)}/lodestone/p7-{uuid.uuid4().hex}"
    made = labelled(own)
    made.write.partitionBy("batch_no").option("compression", "zstd").parquet(f"{base}/arrived")
    arrived = spark.read.schema(made.schema).parquet(f"{base}/arrived")
    forest = HashForest(spark, f"{base}/forest", likeness)
    pairs = spark.createDataFrame([], "new bigint, old bigint")
    found = []
    for r in arrived.groupBy("batch_no").agg(F.count("cls").alias("n")).orderBy("batch_no").collect():  # one row a batch
        batch = arrived.where(F.col("batch_no") == r.batch_no)
        if forest.runs():
            found.append(f"{base}/found/{r.batch_no}")
            forest.search(entries(batch), size=r.n * TREES).write.parquet(found[-1])
        forest.append(entries(batch.where("accepted")))
    if found:
        pairs = spark.read.schema(pairs.schema).parquet(*found)
    near = pairs.select(F.least("new", "old").alias("a"), F.greatest("new", "old").alias("b")).distinct()
    near = stored(verified(near, own.where(F.col("text").isNotNull()), likeness).select("a", "b"), "p7-near")
    member = arrived.where("cls is not null").select("doc_id", "cls", "batch_no", "accepted")
    copies = member.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(copies)
    one = member.where("accepted").select(F.col("cls").alias("a"), F.col("doc_id").alias("p"), F.col("batch_no").alias("pb"))
    two = member.select(F.col("cls").alias("b"), F.col("doc_id").alias("q"), F.col("batch_no").alias("qb"))
    by_text = ways.join(one, "a").join(two, "b").where("pb < qb").select("p", "q")
    files = arrived.where("digest is not null").select("doc_id", "tenant_id", "digest", "batch_no", "accepted")
    first = files.where("accepted").select("tenant_id", "digest", F.col("doc_id").alias("p"), F.col("batch_no").alias("pb"))
    then = files.select("tenant_id", "digest", F.col("doc_id").alias("q"), F.col("batch_no").alias("qb"))
    by_file = first.join(then, ["tenant_id", "digest"]).where("pb < qb").select("p", "q")
    return by_text.unionByName(by_file).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = repeats(table(spark, sf_dir, "documents"))
    return pairs.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()
