"""Problem 1: splitting oversized items at natural boundaries.

The cut positions of a text are found by dynamic programming over its boundaries, all of them: each cut costs the penalty of
its kind (paragraph < line < sentence < word < none) and each piece the square of its distance from the even share, subject
to the limit; piece k + 1 starts the stated overlap before the end of piece k. The worst kind on the way counts before all
costs: the programme runs over the boundaries of the coarsest kind first and takes in finer ones while there is no way.
The kind at which the text without overlap gets through is its ``boundary``. Inside words too long for any piece, places
without a boundary are offered, so that every text can be cut.

Defined cases: null contents and contents within the limit give no pieces; a chunk stored twice is cut once; a blank text
above the limit is cut at white space and its boundary is ``paragraph``, since no trimmed segment is too long; an overlap
that is not below the limit raises ValueError; where ``size_limits`` has no ``chunk_piece`` the limit is the 2,400
characters of the problem's statement, without overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, slices, table

KINDS = ("paragraph", "line", "sentence", "word", "none")
_CUTS = (re.compile(r"\r?\n(?:[^\S\n]*\r?\n)+"), re.compile(r"\r?\n"), re.compile(r"\r?\n|(?<=[.!?])\s+"), re.compile(r"\s+"))
PENALTY = (0.0, 0.4, 1.0, 3.0, 12.0)


def cut_places(text: str, limit: int, overlap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All positions at which a piece may end and the kind of each; places without a boundary only inside words too long."""
    kind: dict[int, int] = {}
    for k, cut in reversed(list(enumerate(_CUTS))):
        for m in cut.finditer(text):
            kind[m.end()] = k
    step = max(1, min(limit // 8, limit - overlap))
    places = sorted({0, len(text)} | {p for p in kind if 0 < p < len(text)})
    for a, b in zip(places, places[1:]):
        if b - a > step:
            for p in range(a + step, b, step):
                kind[p] = 4
    kind[len(text)] = 0
    at = np.array(sorted(p for p in kind if 0 < p <= len(text)), np.int64)
    return at, np.array([kind[p] for p in at.tolist()], np.int64)


def cheapest(end: np.ndarray, begin: np.ndarray, first: int, pen: np.ndarray, limit: int, even: float) -> list[int] | None:
    """Indexes of the cuts of least cost, the last one included; None if no way keeps every piece within the limit.

    A piece from cut j to cut i goes from ``begin[j]`` (``first`` for the first piece) to ``end[i]``; both grow.
    """
    if end[0] - first > limit or (len(end) > 1 and (end[1:] - begin[:-1]).max() > limit):
        return None  # two neighbouring boundaries are too far apart, so any piece over them is too long
    n = len(end)
    cost, back = np.full(n, np.inf), np.full(n, -1)
    lows = np.searchsorted(begin, end - limit)
    least = int(np.searchsorted(begin, first, "right"))  # a piece starts after the text's own start
    alone = np.where(end - first <= limit, ((end - first - even) / limit) ** 2 * 4, np.inf) + pen
    for i in range(n):
        cost[i] = alone[i]
        lo = max(int(lows[i]), least)
        if lo < i:
            way = cost[lo:i] + ((end[i] - begin[lo:i] - even) / limit) ** 2 * 4
            j = int(way.argmin())
            if way[j] + pen[i] < cost[i]:
                cost[i], back[i] = way[j] + pen[i], lo + j
    if not np.isfinite(cost[-1]):
        return None
    cuts, i = [], n - 1
    while i >= 0:
        cuts.append(i)
        i = int(back[i])
    return cuts[::-1]


def trimmed(text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ends of pieces and begins after cuts without the white space around, and where the trimmed text begins."""
    gaps = [(m.start(), m.end()) for m in _CUTS[3].finditer(text)]
    starts, ends = (np.array([g[k] for g in gaps], np.int64) for k in (0, 1))
    first = gaps[0][1] if gaps and gaps[0][0] == 0 else 0
    if not gaps:
        return at, at, first
    # the gap that a position ends or lies in
    before = np.searchsorted(starts, at, "left") - 1
    inside = (before >= 0) & (ends[before] >= at)
    after = np.searchsorted(starts, at, "right") - 1
    within = (after >= 0) & (ends[after] > at)
    return np.where(inside, starts[before], at), np.where(within, ends[after], at), first


def split(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The coarsest sufficient kind of boundary, and (start, end, kind of the cut at the end) of the pieces of ``text``.

    One dynamic programme, first over the boundaries of the coarsest kind and over more kinds while it finds no way. Without
    overlap and white space around the pieces this gives the kind; with them, the pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} does not fit pieces of {limit}")
    n = len(text)
    at, kinds = cut_places(text, limit, overlap)
    pen = np.array(PENALTY)[kinds]
    pen[-1:] = 0.0
    tail, head, first = trimmed(text, at)
    least, coarse = 4, KINDS[4]
    for k in range(4):
        own = np.flatnonzero(kinds <= k)
        if not n or cheapest(tail[own], head[own], first, pen[own], limit, limit) is not None:
            least, coarse = k, KINDS[k]
            break
    if n <= limit:
        return coarse, [(0, n, 0)]
    share = -(-(n - overlap) // (limit - overlap))  # least number of pieces
    even = (n - overlap) / share + overlap
    for k in range(least, 5):
        own = np.flatnonzero(kinds <= k)
        if (way := cheapest(at[own], at[own] - overlap, 0, pen[own], limit, even)) is not None:
            break
    out, start = [], 0
    for i in own[way].tolist():
        out.append((start, int(at[i]), int(kinds[i])))
        start = int(at[i]) - overlap
    return coarse, out


def split_chunks(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(chunk_id, parent_id, section, page_number, piece_no, start, end, piece, cut_kind, boundary) of oversized chunks."""
    large = chunks.where(F.length("content") > limit).select("chunk_id", "parent_id", "section", "page_number", "content")
    # a fixed number of partitions, since adaptive execution would put these few rows into one task
    large = large.repartition(shuffle_width(chunks.sparkSession), "chunk_id", "content").dropDuplicates(["chunk_id", "content"])
    schema = "chunk_id string, parent_id string, section string, page_number int, piece_no int, start int, end int, piece string, cut_kind string, boundary string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            rows = []
            for cid, parent, section, page, text in zip(*(c.to_pylist() for c in b.columns)):
                whole, pieces = split(text, limit, overlap)
                for k, (s, e, kind) in enumerate(pieces):
                    rows.append((cid, parent, section, page, k, s, e, text[s:e], KINDS[kind], whole))
            cols = list(zip(*rows))
            kinds = [pa.string()] * 3 + [pa.int32()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return large.mapInArrow(run, schema)


def limit_of(limits: DataFrame, name: str = "chunk_piece") -> tuple[int, int]:
    row = limits.where(F.col("limit_name") == name).agg(F.min("max_size").alias("m"), F.min("overlap_size").alias("o")).first()
    return (row.m or 2400, row.o or 0)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(table(spark, sf_dir, "chunks"), *limit_of(table(spark, sf_dir, "size_limits")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id", "boundary").distinct()
