"""Problem 8: encoding the whole corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens by the tokenizer's own pattern; each different pre-token is encoded once per Python
worker. A pre-token is merged with a rank queue over hierarchical bitmaps: every merge rank that occurs has a bucket of
linked-list positions, one bit per rank tells which buckets are filled, and the bits of the words above tell which words
are filled, so that find-first-set gives the next rank in a fixed number of steps. Entries that a later merge has made
stale are skipped when they come up. The cost is O(n) queue steps for a pre-token of n bytes, however long.

Defined cases: a null and an empty text give an empty list; a text that spells a special token is plain text; lone
surrogates cannot occur in Spark strings; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import list_array, slices, table, tokenizer_dir

_SPACE = "\t-\r \x85\xa0  -     　"


def _ranges(chars: list[int]) -> str:
    out, k = [], 0
    while k < len(chars):
        j = k
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(re.escape(chr(chars[k])) + (("-" + re.escape(chr(chars[j]))) if j > k else ""))
        k = j + 1
    return "".join(out)


@lru_cache(1)
def pretoken_pattern() -> re.Pattern:
    """The byte-level BPE pattern in the syntax of ``re``.

    ``\\p{N}`` is the decimal digits plus the letter-like and other numbers; ``\\p{L}`` is what is left of word
    characters; ``\\s`` is spelled out since ``re`` counts four control characters as white space.
    """
    other = _ranges([c for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")])
    letter, number = rf"[^\W\d_{other}]", rf"[\d{other}]"
    rest = rf"(?:[^\w{_SPACE}{other}]|_)"
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?{rest}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@lru_cache(1)
def latin_pattern() -> re.Pattern:
    """The same for texts of Latin-1 characters alone, with character classes that are plain bitmaps."""
    letter, number, space = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{letter}{number}{space}]+|[{space}]+(?![^{space}])|[{space}]+")


class RankQueue:
    """Set of merge ranks with find-first-set in three levels of 64-bit words; a bucket of positions for each rank."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        if (own := self.buckets.get(rank)) is not None:
            own.append(at)
            return
        self.buckets[rank] = [at]
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[block] = self.mid.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions, which leave the queue."""
        block = (self.top & -self.top).bit_length() - 1
        word = (block << 6) + (self.mid[block] & -self.mid[block]).bit_length() - 1
        rank = (word << 6) + (self.low[word] & -self.low[word]).bit_length() - 1
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.mid[block] &= self.mid[block] - 1
            if not self.mid[block]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class _Memo(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, token: str) -> list[int]:
        got = self[token] = self.make(token.encode())
        return got


class Encoder:
    """Byte-level BPE with a memo of pre-tokens, emptied when it holds ``memo`` entries (memory only, not results)."""

    def __init__(self, path: str, memo: int = 400_000) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.memo, self.most = _Memo(self.merge), memo
        self.find, self.find_latin = pretoken_pattern().findall, latin_pattern().findall

    def pieces(self, text: str):
        """An iterator over the ids of each pre-token."""
        if len(self.memo) > self.most:
            self.memo.clear()
        try:
            text.encode("latin-1")
            tokens = self.find_latin(text)
        except UnicodeEncodeError:
            tokens = self.find(text)
        return map(self.memo.__getitem__, tokens)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                queue.push(r, i)
        while queue.top:
            rank, positions = queue.pop()
            positions.sort()
            for i in positions:
                j = after[i]
                if part[i] is None or j >= n or ranks.get(both := part[i] + part[j]) != rank:
                    continue  # stale
                part[i], part[j] = both, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := ranks.get(both + part[k])) is not None:
                        queue.push(r, i)
                if (p := before[i]) >= 0 and (r := ranks.get(part[p] + both)) is not None:
                    queue.push(r, p)
        return [ranks[x] for x in part if x is not None]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of each row of ``docs``; one narrow pass, no shuffle."""
    path = vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches, "t"):
            ids = [e.encode(t) for t in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(flat, sizes, pa.int32())], [key, "ids"])

    src = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    return src.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens int) of each row of ``docs``."""
    path = vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.count(t) for t in b.column(1).to_pylist()], pa.int32())], [key, "n_tokens"])

    src = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    return src.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens int")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
