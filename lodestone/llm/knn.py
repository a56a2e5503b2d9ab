"""Problem 4: most similar vectors for every vector, by a permutation index.

A bounded sample of the vectors serves as pivots. Each vector is represented by the ordered list of its ``LENGTH``
nearest pivots and posted in the inverted files of the first ``POSTED`` of them. Within an inverted file candidates are
ranked by the footrule distance of their pivot lists (location parameter ``LENGTH``), and those near enough are reranked
by their cosine. Lists of the queries and of the index are the same, so a search of all vectors costs one shuffle of
``POSTED`` postings a vector. The number of pivots grows with the collection up to ``MOST_PIVOTS``, which keeps the
inverted files short; a file longer than ``BLOCK`` is read in blocks, each against itself and all blocks before it, and a
file of more than ``MOST_BLOCKS`` is cut into salted cells of which every two meet in one task. Vectors travel as 16-bit integers with a scale, which keeps cosines to about five digits.

Defined cases: a vector that is null, all zero, not of 64 components or with a component that is null or no finite
number is left out; equal vectors under several chunk ids are searched once and all count; a chunk stored twice counts
once; ties go to the smaller chunk_id; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, stored, table

SIZE, LENGTH, POSTED = 64, 8, 4
ROWS_A_PIVOT, MOST_PIVOTS, BLOCK, MOST_BLOCKS = 104, 8192, 2048, 64
#: Classes of which a task that posts remembers that they are posted.
SEEN = 200_000
#: Of 36 points of agreement of two pivot lists, this many make a candidate.
AGREEMENT = 6
PAYLOAD = 2 * LENGTH + 4 + 2 * SIZE


def usable(vectors: DataFrame) -> DataFrame:
    """(chunk_id, cls, vector): the rows with a vector that can be compared; cls is the same for equal vectors."""
    v = F.col("vector")
    fine = (F.size(v) == SIZE) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("chunk_id").isNotNull() & v.isNotNull()).where(fine).select("chunk_id", F.xxhash64(v).alias("cls"), v.alias("vector"))


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(col), SIZE)
    return x / np.linalg.norm(x, axis=1)[:, None]


def pivots(own: DataFrame, rows: int) -> np.ndarray:
    """At most ``MOST_PIVOTS`` vectors, those whose hash is least: a sample that no order of rows changes."""
    most = int(min(MOST_PIVOTS, max(16, rows // ROWS_A_PIVOT)))
    part = min(1.0, 2.0 * most / max(1, rows))
    low = F.xxhash64(F.lit(17), "cls")
    few = own.select("cls", "vector", low.alias("h")).where(F.col("h") <= int(-(2**63) + part * (2**64 - 2**40)) if part < 1 else F.lit(True))
    got = few.dropDuplicates(["cls"]).orderBy("h", "cls").limit(most).select("vector").collect()
    x = np.array([r.vector for r in got], np.float64).reshape(-1, SIZE)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32) if len(x) else x.astype(np.float32)


def postings(own: DataFrame, base: np.ndarray, posted: int = POSTED) -> DataFrame:
    """(pivot, payload, cls): payload is the pivot list, the scale and the 16-bit components."""
    held = own.sparkSession.sparkContext.broadcast(base)
    length, posted = min(LENGTH, len(base)), min(posted, len(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                fresh = []
                for i, c in enumerate(b.column(0).to_pylist()):
                    if c not in seen:
                        seen.add(c)
                        fresh.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if not fresh:
                    continue
                b = b.take(pa.array(fresh)) if len(fresh) < b.num_rows else b
                x = matrix(b.column(1))
                near = x.astype(np.float32) @ p.T
                top = np.argpartition(-near, length - 1, axis=1)[:, :length] if length < len(p) else np.tile(np.arange(len(p)), (len(x), 1))
                order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                top = np.take_along_axis(top, order, 1)
                perm = np.full((len(x), LENGTH), 65535, ">u2")
                perm[:, :length] = top
                scale = np.abs(x).max(axis=1) / 32767
                packed = np.rint(x / scale[:, None]).astype("<i2")
                data = np.concatenate([perm.view(np.uint8), scale.astype("<f4")[:, None].view(np.uint8), packed.view(np.uint8)], axis=1)
                data = np.repeat(data, posted, axis=0)
                ends = np.arange(len(data) + 1, dtype=np.int32) * PAYLOAD
                payload = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(top[:, :posted].astype(np.int32).ravel()), payload, pa.array(np.repeat(b.column(0).to_numpy(), posted))], ["pivot", "payload", "cls"])

    return own.select("cls", "vector").mapInArrow(run, "pivot int, payload binary, cls bigint")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points of agreement: the sum of LENGTH - max(i, j) over the pivots at place i of one and j of the other list.

    With location parameter LENGTH the footrule distance is LENGTH * (LENGTH + 1) less twice the agreement.
    """
    out = np.zeros((len(a), len(b)), np.uint8)
    for i in range(LENGTH):
        for j in range(LENGTH):
            own = a[:, i]
            out += (own[:, None] == b[None, :, j]) * np.uint8(LENGTH - max(i, j))
    return out


def unpack(payload: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """Classes, pivot lists and unit vectors, each class once."""
    _, first = np.unique(cls, return_index=True)
    first.sort()
    payload, cls = payload[first], cls[first]
    perm = np.ascontiguousarray(payload[:, : 2 * LENGTH]).view(">u2").astype(np.uint16)
    perm[perm == 65535] = 0
    scale = np.ascontiguousarray(payload[:, 2 * LENGTH : 2 * LENGTH + 4]).view("<f4")
    x = np.ascontiguousarray(payload[:, 2 * LENGTH + 4 :]).view("<i2").astype(np.float32) * scale
    return cls, perm, x / np.linalg.norm(x, axis=1)[:, None]


def payloads(data: pa.Array) -> np.ndarray:
    """The bytes of a binary column whose values all have the length of a payload."""
    start = int(np.frombuffer(data.buffers()[1], np.int32, count=1, offset=4 * data.offset)[0])
    return np.frombuffer(data.buffers()[2], np.uint8, count=len(data) * PAYLOAD, offset=start).reshape(-1, PAYLOAD)


def neighbours(posted: DataFrame, least: float, agree: int = AGREEMENT, blocks: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) of different classes found in one inverted file, each pair both ways; (pivot, null, null) for the files of more than ``blocks``."""

    def within(rows: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...] | None) -> Iterator[pa.RecordBatch]:
        cls, perm, x = rows
        cls2, perm2, x2 = other or rows
        for at in range(0, len(cls), 512):
            i, j = np.nonzero(agreement(perm[at : at + 512], perm2) >= agree)
            i += at
            keep = (cls[i] != cls2[j]) if other else (i < j) & (cls[i] != cls2[j])
            i, j = i[keep], j[keep]
            for part in range(0, len(i), 200_000):
                p, q = i[part : part + 200_000], j[part : part + 200_000]
                cosine = np.einsum("ij,ij->i", x[p], x2[q]).astype(np.float64)
                ok = cosine >= least
                p, q, cosine = cls[p[ok]], cls2[q[ok]], cosine[ok]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p, q])), pa.array(np.concatenate([q, p])), pa.array(np.concatenate([cosine, cosine]))], ["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        before: list[tuple[np.ndarray, ...]] = []
        last, previous, size, over = None, None, 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = unpack(*(np.concatenate(c) for c in zip(*held)))
            yield from within(rows, None)
            for other in before:
                yield from within(rows, other)
            before.append(rows)

        for b in batches:
            if not b.num_rows:
                continue
            key, cls = b.column(0).to_numpy(), b.column(2).to_numpy()
            payload = payloads(b.column(1))
            ends = np.concatenate((np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            s = 0
            for e in ends:
                if last is not None and key[s] != last:
                    yield from close()
                    held, before, size, previous, over = [], [], 0, None, False
                last = key[s]
                # copies of a class stand side by side and count once
                own = np.flatnonzero(np.concatenate(([previous is None or cls[s] != previous], cls[s + 1 : e] != cls[s : e - 1]))) + s
                previous = cls[e - 1]
                while len(own) and not over:
                    if size == block:
                        yield from close()
                        held, size = [], 0
                        if blocks and len(before) >= blocks:
                            over = True
                            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64())], ["a", "b", "cosine"])
                            break
                    some, own = own[: block - size], own[block - size :]
                    held.append((payload[some], cls[some]))
                    size += len(some)
                s = e
        yield from close()

    n = shuffle_width(posted.sparkSession)
    key = posted.columns[0]
    return posted.repartition(n, key).sortWithinPartitions(key, "payload", "cls").mapInArrow(run, "a bigint, b bigint, cosine double")


def cells(posted: DataFrame, long: DataFrame, rows_a_cell: int) -> DataFrame:
    """(key, payload, cls): the files ``long`` (pivot) cut into cells by class, one key for every two cells of a file."""
    own = posted.join(F.broadcast(long), "pivot")
    many = own.groupBy("pivot").agg(F.ceil(F.count("*") / rows_a_cell).alias("m"))
    cell = own.join(F.broadcast(many), "pivot").withColumn("i", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("m")))
    cell = cell.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    # a cell meets itself with each of the others, and alone if there is no other
    cell = cell.where((F.col("i") != F.col("j")) | (F.col("m") == 1))
    return cell.select(F.xxhash64("pivot", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "payload", "cls")


def compared(posted: DataFrame, least: float, agree: int = AGREEMENT, blocks: int = MOST_BLOCKS, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) of all pairs of classes of each inverted file (pivot, payload, cls), however long."""
    found = stored(neighbours(posted, least, agree, blocks, block), "p4-candidates")
    long = found.where(F.col("b").isNull()).select(F.col("a").cast("int").alias("pivot"))
    pairs = found.where(F.col("b").isNotNull())
    if not long.isEmpty():
        pairs = pairs.unionByName(neighbours(cells(posted, long, max(1, blocks * block // 4)), least, agree, None, block))
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def expanded(own: DataFrame, found: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """Ranked neighbours of chunks from pairs of classes; of the chunks ``asked`` alone if they are given."""
    member = own.select("chunk_id", "cls").distinct()
    # of a class of equal vectors, only the first k + 1 members can be among the k nearest of any chunk
    first = member.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("chunk_id"))).where(F.col("n") <= k + 1).select("cls", "chunk_id")
    shared = member.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("cosine"))
    to = found.unionByName(shared).join(first.select(F.col("cls").alias("b"), F.col("chunk_id").alias("neighbour_id")), "b")
    ranked = to.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour_id"))).where(F.col("r") <= k + 1)
    wanted = member if asked is None else member.join(asked, "chunk_id", "left_semi")
    own_lists = wanted.select("chunk_id", F.col("cls").alias("a")).join(ranked.select("a", "neighbour_id", "cosine", "r"), "a").where("chunk_id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy("r"))
    return own_lists.withColumn("rank", rank).where(F.col("rank") <= k).select("chunk_id", "neighbour_id", "rank", "cosine")


def nearest(vectors: DataFrame, k: int = 10, least: float = -1.0, agree: int = AGREEMENT) -> DataFrame:
    """(chunk_id, neighbour_id, rank, cosine): up to ``k`` most similar other chunks with a cosine of at least ``least``."""
    own = usable(vectors)
    base = pivots(own, vectors.count())
    schema = "chunk_id string, neighbour_id string, rank int, cosine double"
    if not len(base):
        return vectors.sparkSession.createDataFrame([], schema)
    found = compared(postings(own, base), least, agree)
    return expanded(own, found, k)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "chunk_vectors"), 10, 0.85)
    both = near.groupBy(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).agg(F.count("*").alias("n"))
    return both.where("n = 2").select("chunk_id_a", "chunk_id_b")


#: The wide index, for neighbours that are hardly nearer than the rest: few pivots, long lists, many of them probed.
WIDE_PIVOTS, WIDE_POSTED, WIDE_AGREEMENT = 96, 8, 1
CELL = 16_384


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(chunk_id, neighbour_id, rank, cosine): the ``k`` nearest of all ``vectors`` for each of ``queries``.

    The wide index: every vector is posted in the inverted files of its ``WIDE_POSTED`` nearest of ``WIDE_PIVOTS``
    pivots, every query probes as many. A file is cut into cells of about ``CELL`` vectors by hash, and a query goes to
    all cells of its files, so no task holds more than a cell and its queries. Within a cell candidates are those whose
    pivot lists agree, and the best by cosine stay.
    """
    spark = vectors.sparkSession
    own, asked = usable(vectors), usable(queries)
    rows = vectors.count()
    base = pivots(own, min(rows, WIDE_PIVOTS * ROWS_A_PIVOT))
    schema = "chunk_id string, neighbour_id string, rank int, cosine double"
    if not len(base):
        return spark.createDataFrame([], schema)
    cells = max(1, round(rows * WIDE_POSTED / len(base) / CELL))
    posted = postings(own, base, WIDE_POSTED).withColumn("cell", F.pmod(F.xxhash64("cls"), F.lit(cells))).withColumn("query", F.lit(False))
    probes = postings(asked.dropDuplicates(["cls"]), base, WIDE_POSTED).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("query", F.lit(True))
    both = posted.unionByName(probes.withColumn("cell", F.col("cell").cast("bigint")).select(posted.columns)).select(F.xxhash64("pivot", "cell").alias("key"), "query", "payload", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            flag, payload, cls = (np.concatenate(c) for c in zip(*held))
            if not flag.any() or flag.all():
                return
            qc, qp, qx = unpack(payload[flag], cls[flag])
            ic, ip, ix = unpack(payload[~flag], cls[~flag])
            for at in range(0, len(qc), 256):
                score = qx[at : at + 256] @ ix.T
                score[agreement(qp[at : at + 256], ip) < WIDE_AGREEMENT] = -2
                score[qc[at : at + 256, None] == ic[None, :]] = -2
                m = min(k + 1, score.shape[1])
                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                best = np.take_along_axis(score, top, 1)
                i, j = np.nonzero(best > -1.5)
                yield pa.RecordBatch.from_arrays([pa.array(qc[at + i]), pa.array(ic[top[i, j]]), pa.array(best[i, j].astype(np.float64))], ["a", "b", "cosine"])

        for b in batches:
            if not b.num_rows:
                continue
            key, flag, cls = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
            payload = payloads(b.column(2))
            s = 0
            for e in np.concatenate((np.flatnonzero(np.diff(key)) + 1, [len(key)])):
                if last is not None and key[s] != last:
                    yield from close()
                    held = []
                last = key[s]
                held.append((flag[s:e].copy(), payload[s:e].copy(), cls[s:e].copy()))
                s = e
        if held:
            yield from close()

    found = both.repartition(shuffle_width(spark), "key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return expanded(own, found, k, asked.select("chunk_id").distinct())


def p4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest for the query set: every chunk whose hashed id is divisible by 20, against all vectors."""
    v = table(spark, sf_dir, "chunk_vectors")
    return search(v, v.where(F.pmod(F.xxhash64("chunk_id"), F.lit(20)) == 0))
