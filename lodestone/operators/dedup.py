"""Duplicate look-ups by hash, reusable chunks, minhash candidates and version classes."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, squeeze


def newest_twin(docs: DataFrame, digest: str, key: str = "doc_id", tenant: str = "tenant_id", status: str = "status", created: str = "created_at") -> DataFrame:
    """(key, canonical) of records with another record of their tenant and digest that has not failed: the newest one.

    The two newest of each group are enough; they are found with map-side combined maxima, so a digest shared by very
    many records is no bottleneck.
    """
    own = docs.where(F.col(digest).isNotNull() & F.col(tenant).isNotNull()).select(key, tenant, digest, status, created)
    fine = own.where(F.col(status) != "FAILED")
    order = F.struct(F.col(created), F.col(key))
    top = fine.groupBy(tenant, digest).agg(F.max(order).alias("a"))
    second = fine.join(top, [tenant, digest]).where(F.col(key) != F.col(f"a.{key}")).groupBy(tenant, digest).agg(F.max(order).alias("b"))
    both = top.join(second, [tenant, digest], "left")
    twin = own.join(both, [tenant, digest])
    canonical = F.when(F.col(key) != F.col(f"a.{key}"), F.col(f"a.{key}")).otherwise(F.col(f"b.{key}"))
    return twin.select(key, canonical.alias("canonical"), digest).where(F.col("canonical").isNotNull())


def reusable(new: DataFrame, existing: DataFrame, tenant: str = "tenant_id", digest: str = "content_hash") -> DataFrame:
    """``new`` with ``reusable``: whether the tenant already holds a chunk of the same non-empty hash."""
    held = existing.where(F.col(digest).isNotNull() & (F.col(digest) != "")).select(tenant, digest).distinct().withColumn("held", F.lit(True))
    return new.join(held, [tenant, digest], "left").withColumn("reusable", F.coalesce("held", F.lit(False))).drop("held")


# Fixed values of the signature: a prime above 2^32, and the coefficients' seed and number.
PRIME, PERMUTATIONS, SEED, BANDS = 4294967311, 64, 42, 8


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = random.Random(SEED)
    a = [draw.randint(1, PRIME - 1) for _ in range(PERMUTATIONS)]
    b = [draw.randint(0, PRIME - 1) for _ in range(PERMUTATIONS)]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def permuted(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a h + b) mod PRIME of 32-bit hashes, (hashes, permutations); split so that nothing overflows 64 bits."""
    p, h = np.uint64(PRIME), hashes[:, None]
    high = (a >> np.uint64(16)) * h % p
    return ((high << np.uint64(16)) + (a & np.uint64(65535)) * h + b) % p


#: Trigrams whose permuted hashes a worker remembers (512 bytes each).
KNOWN_GRAMS = 40_000


def minhash(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sig array<bigint>) over the character trigrams of the squeezed lower-case text.

    A worker keeps the permuted hashes of the trigrams it has seen in one bounded table; a text takes the minima of its rows.
    """
    from hashlib import md5

    ca, cb = coefficients()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict[str, int] = {}
        table = np.zeros((KNOWN_GRAMS, PERMUTATIONS), np.uint64)
        for batch in batches:
            out = np.zeros((batch.num_rows, PERMUTATIONS), np.uint64)
            for k, t in enumerate(batch.column(1).to_pylist()):
                least = None
                grams = list({t[i : i + 3] for i in range(len(t) - 2)} or {t})
                for at in range(0, len(grams), KNOWN_GRAMS // 2):
                    part = grams[at : at + KNOWN_GRAMS // 2]
                    new = [g for g in part if g not in row]
                    if len(row) + len(new) > KNOWN_GRAMS:
                        row.clear()
                        new = part
                    if new:
                        h = np.fromiter((int(md5(g.encode()).hexdigest()[:8], 16) for g in new), np.uint64, len(new))
                        table[len(row) : len(row) + len(new)] = permuted(h, ca, cb)
                        row.update(zip(new, range(len(row), len(row) + len(new))))
                    low = table[np.fromiter(map(row.__getitem__, part), np.int64, len(part))].min(axis=0)
                    least = low if least is None else np.minimum(least, low)
                out[k] = least
            flat = pa.array(out.ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PERMUTATIONS, dtype=np.int32)), flat)], [key, "sig"])

    src = texts.where(F.col(text).isNotNull()).select(F.col(key), squeeze(F.lower(F.col(text))).alias("t"))
    return src.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, sig array<bigint>")


def banded(sigs: DataFrame, key: str) -> DataFrame:
    """(key, band, h): the digest of each band of a signature as it is written."""
    rows = PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.md5(F.concat(F.lit("("), F.array_join(F.slice("sig", b * rows + 1, F.lit(rows)), ", "), F.lit(")"))))
    return sigs.select(key, F.posexplode(bands).alias("band", "h"))


def near_new(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(new, old) keys of ``new`` signatures that share a band with ``old`` ones, each once."""
    x = banded(new, key).select(F.col(key).alias("new"), "band", "h")
    y = banded(old, key).select(F.col(key).alias("old"), "band", "h")
    return x.join(y, ["band", "h"]).where("new <> old").select("new", "old").distinct()


def band_pairs(sigs: DataFrame, key: str, agree: float = 0.8) -> DataFrame:
    """(a, b, agreement) with a < b that share a band and agree in the share ``agree`` of the signature.

    Equal signatures form one class, whose smallest member stands for it, so copies make no pairs of their own. Keys alone
    meet on the bands; signatures are fetched for the different pairs.
    """
    classes = sigs.groupBy("sig").agg(F.min(key).alias("rep"))
    posted = banded(classes, "rep")
    x = posted.select(F.col("rep").alias("a"), "band", "h")
    y = posted.select(F.col("rep").alias("b"), "band", "h")
    pairs = x.join(y, ["band", "h"]).where("a < b").select("a", "b").distinct()
    held = pairs.join(classes.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda e: e)) / PERMUTATIONS
    return held.select("a", "b", same.alias("agreement")).where(F.col("agreement") >= agree)


def near_members(sigs: DataFrame, key: str, agree: float = 0.8) -> DataFrame:
    """(a, b, agreement, kind): all links of records by signature, without a pair for every two copies.

    ``near``: a and b are the representatives of two classes of equal signatures; ``member``: b is a member of the class
    that a represents. The near records of any record are those of its class and of the classes near to it.
    """
    near = band_pairs(sigs, key, agree).withColumn("kind", F.lit("near"))
    reps = sigs.groupBy("sig").agg(F.min(key).alias("a"))
    member = sigs.join(reps, "sig").select("a", F.col(key).alias("b")).where("a <> b").distinct()
    return near.unionByName(member.select("a", "b", F.lit(1.0).alias("agreement"), F.lit("member").alias("kind")))


def near_earlier(docs: DataFrame, sigs: DataFrame, agree: float = 0.8) -> DataFrame:
    """(doc_id, near, near_same): whether a record has a near one of its tenant in an earlier batch, and one of its file name.

    Classes of equal signatures meet, not their members: of each the first batch by tenant (and file name) is enough.
    """
    reps = sigs.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    own = sigs.join(reps, "sig").select("doc_id", "rep").join(docs.select("doc_id", "tenant_id", "batch_no", "file_name"), "doc_id")
    pairs = band_pairs(sigs, "doc_id", agree).select("a", "b")
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")))

    def first(*by: str, name: str) -> DataFrame:
        held = own.groupBy(F.col("rep").alias("b"), *by).agg(F.min("batch_no").alias(name))
        return ways.join(held, "b").groupBy(F.col("a").alias("rep"), *by).agg(F.min(name).alias(name))

    out = own.join(first("tenant_id", name="n0"), ["rep", "tenant_id"]).join(first("tenant_id", "file_name", name="n1"), ["rep", "tenant_id", "file_name"], "left")
    return out.select("doc_id", (F.col("n0") < F.col("batch_no")).alias("near"), F.coalesce(F.col("n1") < F.col("batch_no"), F.lit(False)).alias("near_same"))


def version_class(docs: DataFrame, chunks: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(doc_id, classification): what an arriving record is against the earlier records of its tenant.

    In this order: EXACT_DUP (file digest), CONTENT_DUP (normalised text), UPDATED_VERSION (chunks shared, same file
    name), PARTIAL_CHANGE (chunks shared), NEW. Earlier means a smaller batch. With ``near`` (doc_id, near, near_same) the
    whole rule: near records of the same file name make UPDATED_VERSION too, others NEAR_DUP before PARTIAL_CHANGE.
    """
    own = docs.where("text is not null").select("doc_id", "id", "tenant_id", "batch_no", "file_name", "sha256", content_hash(F.col("text")).alias("ch"))
    first = lambda c: own.where(F.col(c).isNotNull()).groupBy("tenant_id", c).agg(F.min("batch_no").alias(f"first_{c}"))
    base = own.join(first("sha256"), ["tenant_id", "sha256"], "left").join(first("ch"), ["tenant_id", "ch"], "left")
    parts = chunks.where("parent_id is not null and content_hash is not null").select("document_id", "content_hash").distinct()
    parts = parts.join(own.select(F.col("id").alias("document_id"), "tenant_id", "batch_no", "file_name", "doc_id"), "document_id")
    seen = parts.groupBy("tenant_id", "content_hash").agg(F.min("batch_no").alias("b0"))
    named = parts.groupBy("tenant_id", "content_hash", "file_name").agg(F.min("batch_no").alias("b1"))
    shared = parts.join(seen, ["tenant_id", "content_hash"]).join(named, ["tenant_id", "content_hash", "file_name"], "left")
    shared = shared.groupBy("doc_id").agg(F.max((F.col("b0") < F.col("batch_no")).cast("int")).alias("part"), F.max(F.coalesce((F.col("b1") < F.col("batch_no")).cast("int"), F.lit(0))).alias("same"))
    out = base.join(shared, "doc_id", "left")
    label = F.when(F.col("first_sha256") < F.col("batch_no"), "EXACT_DUP").when(F.col("first_ch") < F.col("batch_no"), "CONTENT_DUP")
    label = label.when(F.col("same") == 1, "UPDATED_VERSION")
    if near is not None:
        out = out.join(near, "doc_id", "left")
        # a near or partly equal record under the same file name is a new version of it
        label = label.when(F.col("near_same"), "UPDATED_VERSION").when(F.col("near"), "NEAR_DUP")
    label = label.when(F.col("part") == 1, "PARTIAL_CHANGE").otherwise("NEW")
    return out.select("doc_id", label.alias("classification"))
