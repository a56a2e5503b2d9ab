"""Problem 9: filling containers of fixed capacity with texts, sized in tokens of a public tokenizer.

Large-item matching. Items above a third of the capacity share a container with one other such item at most; they are
matched greedily, the largest first, each with the largest partner that still fits. The smaller items then go, the
largest first, into the container with the least gap that holds them (best fit), and into new containers when none does.

The plan is made from the histogram of sizes alone, whose length is bounded by the capacity, in runs: "of the items of
size s, those of rank r to r' go q at a time into containers b, b+1, ...". A run ends when a size or a class of equal
gaps is used up, and a touched gap shrinks to less than half, so there are O(capacity * log capacity) runs however many
items there are. Items find their container by their rank among the items of their size; ranks are taken within salted
groups plus an offset, so that a size shared by a third of all rows is never one group; the salts grow with the rows.

Defined cases: a null or empty text has 0 tokens, takes no room and is dealt over the containers in turn; a text above
the capacity is cut into full pieces and a rest (piece_no 0, 1, ...), all others are whole (piece_no 0); limits that are
null, not positive or named twice are ignored (the smallest of one name holds); no rows or no limits give no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table
from .encode import token_sizes

Run = tuple[int, int, int, int, int]
#: Least number of salts, and how many texts a salt is for.
SALTS, ROWS_A_SALT = 64, 2_000_000
Plan = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def arranged(runs: list[Run]) -> Plan:
    """Runs to look items up in: sizes, the place of the first item of each, and of each run its first place, rank, items a container and container.

    The place of an item is its rank plus the number of all smaller items, so one sorted list holds the runs of all sizes.
    """
    runs = sorted(runs)
    sizes, first = np.unique(np.array([r[0] for r in runs], np.int64), return_index=True)
    held = np.array([r[2] for r in runs], np.int64)
    places = np.concatenate(([0], np.cumsum(held)))[:-1].astype(np.int64)
    return sizes, places[first], places, *(np.array([r[k] for r in runs], np.int64) for k in (1, 3, 4))


def placed(plan: Plan, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The container of each item of its size and rank among the items of that size."""
    sizes, start, places, firsts, each, bins_at = plan
    if not len(sizes):
        return np.zeros(len(size), np.int64)
    k = np.minimum(np.searchsorted(sizes, size), len(sizes) - 1)
    at = np.searchsorted(places, start[k] + rank, side="right") - 1
    return bins_at[at] + (rank - firsts[at]) // each[at]


def plan_runs(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs (size, first rank, items, items a container, first container) and the number of containers."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def take(size: int, items: int, each: int, first: int) -> None:
        runs.append((size, used[size], items, each, first))
        used[size] += items
        left[size] -= items

    def free(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            n, gap = left[a], capacity - a
            take(a, n, 1, bins)
        elif b == a:
            n, gap = left[a] // 2, capacity - 2 * a
            if n:
                take(a, 2 * n, 2, bins)
            elif len(large) > 1 and 3 * large[at - 1] > capacity and at:
                n, b = 1, large[at - 1]
                gap = capacity - a - b
                take(a, 1, 1, bins)
                take(b, 1, 1, bins)
            else:
                n, gap = 1, capacity - a
                take(a, 1, 1, bins)
        else:
            n, gap = min(left[a], left[b]), capacity - a - b
            take(a, n, 1, bins)
            take(b, n, 1, bins)
        free(gap, bins, n)
        bins += n
        for s in {a, b} - {None}:
            if not left[s]:
                large.pop(bisect_left(large, s))
    small = [-s for s in left if 3 * s <= capacity]
    heapq.heapify(small)
    while small:
        s = -heapq.heappop(small)
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):
                each = capacity // s
                full, rest = divmod(left[s], each)
                if full:
                    take(s, full * each, each, bins)
                    free(capacity - each * s, bins, full)
                    bins += full
                if rest:
                    take(s, rest, rest, bins)
                    free(capacity - rest * s, bins, 1)
                    bins += 1
                break
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // s
            full = min(count, left[s] // each)
            if full:
                take(s, full * each, each, first)
                free(gap - each * s, first, full)
            if full < count and (rest := min(left[s], each)) and rest < each:
                take(s, rest, rest, first + full)
                free(gap - rest * s, first + full, 1)
                full += 1
            free(gap, first + full, count - full)
    return runs, bins


def containers(spark: SparkSession, limits: DataFrame) -> list[tuple[str, int]]:
    """(name, capacity) of the limits named container_*; the table is a fixed list of settings."""
    rows = limits.where(F.col("limit_name").startswith("container_") & (F.col("max_size") > 0)).groupBy("limit_name").agg(F.min("max_size").alias("m")).collect()
    return sorted((r.limit_name, r.m) for r in rows)


def pack(sizes: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """(container, doc_id, piece_no, n_tokens, bin_no) of ``sizes`` (doc_id, n_tokens), which must be stored."""
    spark = sizes.sparkSession
    caps = {k: c for k, (_, c) in enumerate(limits)}
    kind = sizes.schema["doc_id"].dataType.simpleString()
    schema = f"container string, doc_id {kind}, piece_no int, n_tokens int, bin_no bigint"
    if not caps:
        return spark.createDataFrame([], schema)
    salts = max(SALTS, sizes.count() // ROWS_A_SALT)
    limit = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.lit(c).alias("cap")) for k, c in caps.items()])).alias("l")
    items = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"), limit).select("doc_id", "n", "l.c", "l.cap")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("cap"))).cast("int")
    items = items.select("doc_id", "c", "n", "cap", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    items = items.select("doc_id", "c", "piece_no", F.least(F.col("cap"), F.col("n") - F.col("piece_no") * F.col("cap")).alias("size"), F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int").alias("salt"))

    counts = items.groupBy("c", "size", "salt").agg(F.count("*").alias("n"))
    histogram: dict[int, dict[int, int]] = {k: {} for k in caps}
    for r in counts.groupBy("c", "size").agg(F.sum("n").alias("n")).toLocalIterator():  # at most capacity + 1 rows a container
        histogram[r.c][r.size] = r.n
    plans, total = {}, {}
    for k, cap in caps.items():
        runs, total[k] = plan_runs(histogram[k], cap)
        plans[k] = arranged(runs)
    plan = spark.sparkContext.broadcast(plans)
    names = [n for n, _ in limits]

    offsets = counts.select("c", "size", "salt", (F.sum("n").over(Window.partitionBy("c", "size").orderBy("salt")) - F.col("n")).alias("base"))
    local = F.row_number().over(Window.partitionBy("c", "size", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = items.withColumn("r", local).join(offsets.hint("merge"), ["c", "size", "salt"]).select("doc_id", "c", "piece_no", "size", (F.col("r") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, size, rank = (b.column(i).to_numpy().astype(np.int64) for i in (1, 3, 4))
            bins = np.zeros(len(c), np.int64)
            for k in np.unique(c).tolist():
                own = np.flatnonzero(c == k)
                bins[own] = np.where(size[own] == 0, rank[own] % max(1, total[k]), placed(plan.value[k], size[own], rank[own]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[c], pa.string()), b.column(0), b.column(2), pa.array(size.astype(np.int32)), pa.array(bins)], ["container", "doc_id", "piece_no", "n_tokens", "bin_no"])

    return ranked.mapInArrow(place, schema)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(token_sizes(table(spark, sf_dir, "documents")), "p9-sizes")
    return pack(sizes, containers(spark, table(spark, sf_dir, "size_limits")))
