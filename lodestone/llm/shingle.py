"""Word pairs, minhash signatures, pair making from sorted keys and exact verification, for problems 5 and 7.

Words are the longest runs of letters and digits of the lower-cased text; a text is the set of its pairs of consecutive
words; the likeness of two texts is the Jaccard index of these sets. Texts travel as classes of equal text (a 64-bit
hash), so exact copies cost nothing beyond the first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices, stored

WORDS = re.compile(r"[^\W_]+")
MIN_WORDS = 40
LIKENESS = 0.6
#: Keys shared by more classes than this are not paired as they are; their classes go through the exact prefix join.
BUCKET_CAP = 4096


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_HASH = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigrams(texts: list[str], least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word pairs of the texts of ``least`` words or more: the values, where each text starts, which texts."""
    words = [WORDS.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    which = np.flatnonzero(sizes >= max(least, 2))
    flat = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(words[i] for i in which)), np.uint64, int(sizes[which].sum()))
    if not len(flat):
        return flat, which, which
    ends = np.cumsum(sizes[which])
    with np.errstate(over="ignore"):
        pairs = mixed(flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:])
    keep = np.ones(len(pairs), bool)
    keep[ends[:-1] - 1] = False  # pairs over the end of a text
    return pairs[keep], np.concatenate(([0], ends[:-1])) - np.arange(len(which)), which


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(pairs: np.ndarray, starts: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """(texts, n) minima."""
    out = np.empty((len(starts), n), np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(multipliers(n, seed)):
            out[:, k] = np.minimum.reduceat(pairs * m, starts)
    return mixed(out)


def enough_words(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+")) >= MIN_WORDS


#: Nibbles of the minhashes in a sketch, and how many must agree for a pair to be verified. Of 32 nibbles, 4 agree by the
#: shared key; a pair of likeness 0.6 has 21.5 +- 2.6 in common, one of 0.25 has 12.3 +- 2.4.
NIBBLES, AGREE = 32, 14

Keys = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sketched(sig: np.ndarray) -> np.ndarray:
    """(texts, 2): four bits of each of the first 32 minhashes."""
    out = np.zeros((len(sig), 2), np.uint64)
    for k in range(min(NIBBLES, sig.shape[1])):
        out[:, k // 16] |= (sig[:, k] & np.uint64(15)) << np.uint64(4 * (k % 16))
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nibbles that agree, for rows of two sketch words."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return NIBBLES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1).astype(int)


def keyed(texts: DataFrame, make: Keys) -> DataFrame:
    """(key, cls, s0, s1) of ``texts`` (scope bigint, cls bigint, text): ``make`` gives (texts, keys) and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            scope, cls = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            _, first = np.unique(cls ^ scope, return_index=True)
            b = b.take(pa.array(np.sort(first)))
            scope, cls = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            pairs, starts, which = bigrams(b.column(2).to_pylist())
            if not len(which):
                continue
            keys, sketch = make(pairs, starts)
            with np.errstate(over="ignore"):
                keys = mixed(keys + mixed(scope[which].astype(np.uint64))[:, None])
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(cls[which], n)), *(pa.array(np.repeat(sketch[:, i].copy().view(np.int64), n)) for i in (0, 1))], ["key", "cls", "s0", "s1"])

    return texts.mapInArrow(run, "key bigint, cls bigint, s0 bigint, s1 bigint")


def pairs_of_runs(keys: DataFrame, cap: int | None = BUCKET_CAP, agree: int = AGREE, test: Test | None = None) -> DataFrame:
    """(a, b) with a < b of classes that share a key and ``agree`` nibbles; (cls, null) for classes of a key with more than ``cap``.

    A ``test`` of the columns after the class takes the place of the nibbles. One shuffle on the key, one sort; the runs of equal keys are read off the sorted stream. With a cap a task holds the rows
    of one key up to it; without one the keys must be small (``split_hot``).
    """

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = a[:, 0] != b[:, 0]
        if test:
            ok[ok] = test(a[ok, 1:], b[ok, 1:])
        elif agree:
            ok[ok] = agreeing(a[ok, 1:].view(np.uint64), b[ok, 1:].view(np.uint64)) >= agree
        return ok

    def emit(rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(ends, prepend=0)
        end_of = np.repeat(ends, sizes)
        long = np.repeat(sizes > 16, sizes)
        at, step = np.flatnonzero((end_of - np.arange(len(rows)) > 1) & ~long), 1
        while len(at):
            ok = at[alike(rows[at], rows[at + step])]
            yield from send(rows[ok, 0], rows[ok + step, 0])
            step += 1
            at = at[at + step < end_of[at]]
        for e in np.flatnonzero(sizes > 16):
            own = rows[ends[e] - sizes[e] : ends[e]]
            own = own[np.unique(own[:, 0], return_index=True)[1]]
            if cap and len(own) > cap:
                yield from send(own[:, 0], None)
                continue
            for k in range(len(own) - 1):
                ok = alike(np.broadcast_to(own[k], (len(own) - k - 1, own.shape[1])), own[k + 1 :])
                yield from send(np.full(ok.sum(), own[k, 0]), own[k + 1 :][ok, 0])

    def send(a: np.ndarray, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if len(a):
            both = [pa.array(a), pa.nulls(len(a), pa.int64())] if b is None else [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
            yield pa.RecordBatch.from_arrays(both, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key, which may go on in the next batch
        last, over = None, False  # over: the last key has more classes than the cap, which are passed on as they come

        def close() -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(held)
            yield from emit(whole, np.array([len(whole)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            rows = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            ends = np.concatenate((np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            if last is not None and key[0] == last:
                if over:
                    yield from send(np.unique(rows[: ends[0], 0]), None)
                else:
                    held.append(rows[: ends[0]])
                if len(held) > 8:  # copies of few classes
                    whole = np.concatenate(held)
                    held = [whole[np.unique(whole[:, 0], return_index=True)[1]]]
                    if cap and len(held[0]) > cap:
                        yield from send(held[0][:, 0], None)
                        held, over = [], True
                if len(ends) == 1:
                    continue
                rows, ends = rows[ends[0] :], ends[1:] - ends[0]
            if held:
                yield from close()
            over = False
            tail = ends[-2] if len(ends) > 1 else 0
            if tail:
                yield from emit(rows[:tail], ends[:-1])
            held, last = [rows[tail:]], key[-1]
        if held:
            yield from close()

    n = shuffle_width(keys.sparkSession)
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def split_hot(keys: DataFrame, most: int = BUCKET_CAP) -> DataFrame:
    """``keys`` (key, cls, ...) with every key of more than ``most`` rows cut into cells by class, and a key for every two cells.

    Each two classes of a key still share one, and no key holds many more than ``most`` rows.
    """
    count = keys.groupBy("key").agg(F.ceil(F.count("*") / (most / 2)).alias("m")).where(F.col("m") > 2)
    hot = keys.join(count, "key").withColumn("i", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("m")))
    hot = hot.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).where("i <> j")
    hot = hot.withColumn("key", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))).select(keys.columns)
    return keys.join(count, "key", "left_anti").select(keys.columns).unionByName(hot)


#: Counters of the word pairs that order the prefixes, and words of the parities of a set.
COUNTERS, PARITIES = 1 << 21, 4


def sets(b: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """The different word pairs of each text of a batch that has enough words, and which texts these are."""
    pairs, starts, which = bigrams(b.column(b.schema.get_field_index("text")).to_pylist())
    return [np.unique(pairs[s:e]) for s, e in zip(starts, [*starts[1:], len(pairs)])], which


def parities(own: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITIES): 64 bits a word, each the parity of the number of elements that fall on it.

    Two sets differ in at least as many elements as their parities in bits.
    """
    flat = np.concatenate(own)
    starts = np.cumsum([0, *map(len, own[:-1])])
    bit, word = np.uint64(1) << (flat & np.uint64(63)), (flat >> np.uint64(6)) % np.uint64(PARITIES)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, 0), starts) for w in range(PARITIES)], axis=1).view(np.int64)


def counted(texts: DataFrame) -> np.ndarray:
    """How often the word pairs of each of ``COUNTERS`` hash ranges occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in slices(batches, "text"):
            n += np.bincount(counter(bigrams(b.column(b.schema.get_field_index("text")).to_pylist())[0]), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["at", "n"])

    got = texts.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint32)
    out[got["at"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**32 - 1)
    return out


def counter(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_keys(texts: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """(key, cls, size, place, p0, ...): the rarest word pairs of each class, as many as two texts of the likeness must have in common one.

    Any order of all word pairs gives exact prefixes; this one is by the counters, so that it needs no shuffle of the sets.
    """
    held = texts.sparkSession.sparkContext.broadcast(counted(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            scope, cls = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("scope", "cls"))
            own, which = sets(b)
            if not len(which):
                continue
            size = np.fromiter(map(len, own), np.int64, len(own))
            most = size - np.ceil(size * likeness - 1e-9).astype(np.int64) + 1
            first = [x[np.lexsort((x, held.value[counter(x)]))[:n]] for x, n in zip(own, most)]
            n = np.fromiter(map(len, first), np.int64, len(first))
            with np.errstate(over="ignore"):
                key = mixed(np.concatenate(first) + np.repeat(mixed(scope[which].astype(np.uint64)), n))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            rest = [np.repeat(x, n) for x in parities(own).T]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), np.repeat(cls[which], n), np.repeat(size, n), place, *rest)], ["key", "cls", "size", "place", *(f"p{k}" for k in range(PARITIES))])

    return texts.mapInArrow(run, "key bigint, cls bigint, size bigint, place bigint, " + ", ".join(f"p{k} bigint" for k in range(PARITIES)))


def reachable(likeness: float) -> Test:
    """Whether two sets (size, place, p0, ...) whose first common pair is at these places can have the likeness; loses none.

    What both have lies at these places and after them, and they differ in no fewer elements than their parities in bits.
    """

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a[:, 0] + b[:, 0]
        need = np.ceil(both * (likeness / (1 + likeness)) - 1e-9)
        ok = 1 + np.minimum(a[:, 0] - a[:, 1], b[:, 0] - b[:, 1]) >= need
        ok[ok] = both[ok] - np.bitwise_count((a[ok, 2:] ^ b[ok, 2:]).view(np.uint64)).sum(axis=1, dtype=np.int64) >= 2 * need[ok]
        return ok

    return test


def candidates(texts: DataFrame, make: Keys, name: str, likeness: float = LIKENESS, cap: int = BUCKET_CAP) -> DataFrame:
    """Distinct (a, b) of classes that share a key of ``make`` or, for the keys above ``cap``, a rare word pair."""
    found = stored(pairs_of_runs(keyed(texts, make), cap), f"{name}-candidates")
    texts.sparkSession.sparkContext._jvm.System.gc()  # what the keys took in the shuffle is free from here on
    over = found.where(F.col("b").isNull()).select(F.col("a").alias("cls")).distinct()
    pairs = found.where(F.col("b").isNotNull())
    if not over.isEmpty():
        some = stored(texts.join(over, "cls", "left_semi").select("scope", "cls", "text").dropDuplicates(["scope", "cls"]), f"{name}-hot")
        pairs = pairs.unionByName(pairs_of_runs(split_hot(stored(prefix_keys(some, likeness), f"{name}-prefixes")), None, 0, reachable(likeness)))
    return pairs.distinct()


def possible(pairs: DataFrame, texts: DataFrame, name: str, likeness: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """The ``pairs`` (a, b) that can have the likeness by size and parities, and the texts (cls, text) of all pairs.

    No pair of the likeness is lost; the others are so told apart before texts are sent for each pair.
    """
    pairs = stored(pairs, f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    names = ["size", *(f"p{k}" for k in range(PARITIES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own, which = sets(b)
            if len(which):
                size = np.fromiter(map(len, own), np.int64, len(own))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(which)).columns, *map(pa.array, (size, *parities(own).T))], ["cls", "text", *names])

    own = texts.select("cls", "text").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    own = stored(own.mapInArrow(run, "cls bigint, text string, " + ", ".join(f"{n} bigint" for n in names)), f"{name}-texts")
    one, two = (own.select(F.col("cls").alias(c), *(F.col(n).alias(c + n) for n in names)) for c in "ab")
    differ = sum((F.bit_count(F.col(f"ap{k}").bitwiseXOR(F.col(f"bp{k}"))) for k in range(PARITIES)), F.lit(0))
    both = F.col("asize") + F.col("bsize")
    need = F.ceil(both * (likeness / (1 + likeness)) - 1e-9)
    fits = (F.least("asize", "bsize") >= need) & (both - differ >= 2 * need)
    return stored(pairs.join(one, "a").join(two, "b").where(fits).select("a", "b"), f"{name}-close"), own.select("cls", "text")


def verified(pairs: DataFrame, texts: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """The ``pairs`` (a, b) whose texts (cls, text) have at least ``likeness``, with it."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    own = texts.select("cls", "text").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    both = pairs.join(own.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tb", 2 << 20):
            memo: dict[int, np.ndarray] = {}
            for ids, texts in ((b.column(0), b.column(2)), (b.column(1), b.column(3))):
                new = {c: t for c, t in zip(ids.to_pylist(), texts.to_pylist()) if c not in memo}
                values, starts, which = bigrams(list(new.values()))
                names = list(new)
                for k, s, e in zip(which, starts, [*starts[1:], len(values)]):
                    memo[names[k]] = np.unique(values[s:e])
            none = np.empty(0, np.uint64)
            like = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = memo.get(x, none), memo.get(y, none)
                n = len(np.intersect1d(p, q, assume_unique=True))
                like.append(n / max(1, len(p) + len(q) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like, pa.float64())], ["a", "b", "likeness"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, likeness double").where(F.col("likeness") >= likeness)
