"""Problem 2: best representative of each duplicate group.

Groups are the connected components of the references between records, by alternating large-star and small-star steps
over the edges: each step is one aggregation and one join on a node, the labels halve the distance to the least node of
their component, and a step's result is written to the shared folder before the next. A node that a third of all edges
share is aggregated on the map side first and split by adaptive execution in the join.

The surviving record is built by token-level consensus. For every field the distinct values of a group, weighted by how
many members hold them and how new these are, are aligned progressively into columns of tokens; the weighted tokens of
each column vote; the value that exists and is closest to the consensus is kept. Long values are aligned with their equal
sentences as anchors, by tokens between them. Values of one group and field lie side by side after one shuffle and sort and
are read off the sorted stream; a group of very many values is aligned in blocks whose consensus texts are aligned in turn.

Which record survives is voted on in the same way: the field STANDING spells a record's version, time and id, and since
the order of the records is given (highest version, then latest created_at, then smallest doc_id), so are the weights: each
standing outweighs all lower ones together. ``p2_found`` reads the survivors off the records so built. All other fields come with their types from the best member that holds a value;
what describes the text (TEXT_BOUND) comes from members that hold the chosen text, if these have it.

Defined cases: ids are compared as UUIDs in any spelling; a value that denotes no UUID, and a null, refer to nothing; an
id without a record ties those that refer to it; a record on its own forms no group; a missing version or created_at
counts as lowest, ties go to the smallest doc_id; a record stored twice counts once; a field that all members miss stays null.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, slices, stored, table

FIELDS = ("file_name", "lang", "industry", "source", "metadata", "text")
#: Fields of one value each, taken from the best member that holds them; those that describe the text.
HELD = ("tenant_id", "assistant_id", "knowledge_base_id", "version", "storage_path", "parser_version", "embedding_model", "embedding_model_version", "page_count", "status", "progress_percent", "error_message", "batch_no", "created_at", "completed_at")
TEXT_BOUND = ("n_chars", "sha256", "content_hash")
STANDING = "standing_"
BLOCK = 32
_TOKENS = re.compile(r"\w+|\s+|[^\w\s]")
#: Tokens up to which two stretches are aligned directly, without their sentences as anchors.
DIRECT = 160


def uuid_digits(col: Column) -> Column:
    """The 32 hexadecimal digits of a UUID however it is written, else null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), r"^(?:urn:uuid:)|^\{|\}$", "")
    digits = F.regexp_replace(bare, "-", "")
    return F.when(bare.rlike("^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), digits)


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, label) of undirected ``edges`` (u, v); the label is the least node of the component."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, f"{name}-0")
    for k in range(1, most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, f"{name}-{k}")
        # done when all edges point from distinct nodes to nodes that point nowhere
        if new.groupBy("u").count().where("count > 1").isEmpty() and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_doc_id) of every record in a group of two or more."""
    own = docs.select("doc_id", uuid_digits(F.col("id")).alias("node"), uuid_digits(F.col("canonical_document_id")).alias("c"), uuid_digits(F.col("supersedes")).alias("s")).distinct()
    links = own.where("node is not null").select(F.col("node").alias("u"), F.explode(F.array("c", "s")).alias("v")).where("v is not null")
    label = components(links, "p2")
    tied = own.where("doc_id is not null").select("doc_id", "node").join(label, "node").select("doc_id", "label").distinct()
    first = tied.groupBy("label").agg(F.min("doc_id").alias("group_doc_id"), F.count("*").alias("n")).where("n > 1")
    return tied.join(first, "label").select("group_doc_id", "doc_id")


def _pieces(value: str) -> list[str]:
    return _TOKENS.findall(value)


def _sentences(tokens: list[str]) -> tuple[list[str], list[int]]:
    """The sentences and lines of a text, and where each starts among its tokens, with the end at last."""
    ends = [k + 1 for k, t in enumerate(tokens) if t.isspace() and ("\n" in t or (k and tokens[k - 1] in ".!?"))]
    if not ends or ends[-1] != len(tokens):
        ends.append(len(tokens))
    starts = [0, *ends]
    return ["".join(tokens[s:e]) for s, e in zip(starts, ends)], starts


def aligned(x: list[str], y: list[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """Opcodes that turn tokens ``x`` into ``y``: equal sentences are anchors, tokens are aligned between them."""
    if max(len(x), len(y)) <= DIRECT:
        yield from SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return
    (own, p), (other, q) = _sentences(x), _sentences(y)
    for op, a, b, c, d in SequenceMatcher(None, own, other, autojunk=False).get_opcodes():
        if op != "replace":
            yield op, p[a], p[b], q[c], q[d]
            continue
        # small gaps whole; in large ones sentence by sentence, the last with what is left
        small = max(p[b] - p[a], q[d] - q[c]) <= DIRECT
        n = 1 if small else min(b - a, d - c)
        for k in range(n):
            e, f = (b, d) if k == n - 1 else (a + k + 1, c + k + 1)
            s, t = p[a + k], q[c + k]
            for kind, i, j, m, o in SequenceMatcher(None, x[s : p[e]], y[t : q[f]], autojunk=False).get_opcodes():
                yield kind, s + i, s + j, t + m, t + o


def consensus(values: list[str], weights: list[float]) -> list[str]:
    """Tokens of the consensus: progressive alignment, the heaviest value first, then a vote in every column."""
    order = sorted(range(len(values)), key=lambda i: (-weights[i], values[i]))
    rows = [(_pieces(values[i]), weights[i]) for i in order]
    columns: list[dict[str | None, float]] = [{t: rows[0][1]} for t in rows[0][0]]
    total = rows[0][1]
    for tokens, w in rows[1:]:
        lead = [max((t for t in c if t is not None), key=lambda t: (c[t], t)) for c in columns]
        merged: list[dict[str | None, float]] = []
        for op, a, b, c, d in aligned(lead, tokens):
            both = min(b - a, d - c) if op in ("replace", "equal") else 0
            for k in range(both):
                col = columns[a + k]
                col[tokens[c + k]] = col.get(tokens[c + k], 0.0) + w
                merged.append(col)
            for k in range(a + both, b):
                columns[k][None] = columns[k].get(None, 0.0) + w
                merged.append(columns[k])
            merged += [{tokens[k]: w, None: total} for k in range(c + both, d)]
        columns, total = merged, total + w
    winners = (max(c, key=lambda t: (c[t], t is not None, t or "")) for c in columns)
    return [t for t in winners if t is not None]


def distance(value: str, target: list[str]) -> float:
    own = _pieces(value)
    same = sum(b - a for op, a, b, _, _ in aligned(own, target) if op == "equal")
    return 1.0 - 2.0 * same / max(1, len(own) + len(target))


def weighed(field: str, values: list[str], weights: list[float]) -> list[float]:
    """Weights of the values as given; of standings, each more than all lower ones together."""
    if field != STANDING:
        return weights
    order = {v: k for k, v in enumerate(sorted(values, reverse=True))}
    return [0.5 ** order[v] for v in values]


def voted(votes: DataFrame, key: list[str], emit, schema: str) -> DataFrame:
    """``emit(key, values, weights, firsts)`` gives the rows of each group of ``votes`` (group_doc_id, field, blk, value, w, first) equal in ``key``."""
    names, at = [f.split()[0] for f in schema.split(", ")], [votes.columns.index(k) for k in key]
    kinds: list[pa.DataType] = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []
        for b in slices(batches, "value", 2 << 20):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                own = tuple(row[k] for k in at)
                if held and own != last:
                    out += emit(last, *map(list, zip(*held)))
                    held = []
                last = own
                held.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*emit(last, *map(list, zip(*held)))), kinds)], names)

    own = votes.repartition(shuffle_width(votes.sparkSession), *key).sortWithinPartitions(*key, "value")
    return own.mapInArrow(run, schema)


def merged_fields(docs: DataFrame, member: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(group_doc_id, field, value): for every group and field the existing value closest to the consensus."""
    names = [f for f in fields if f not in ("version", "created_at")]
    held = member.join(docs.select("doc_id", "version", "created_at", *names).dropDuplicates(["doc_id"]), "doc_id")
    newer = 1 + F.coalesce(F.col("version"), F.lit(0)) / 4.0 + F.when(F.col("created_at").isNotNull(), 0.25).otherwise(0.0)
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    votes = held.select("group_doc_id", newer.alias("w"), "doc_id", long.alias("x")).where("x.value is not null and trim(x.value) <> ''")
    votes = votes.groupBy("group_doc_id", F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.sum("w").alias("w"), F.min("doc_id").alias("first"))
    votes = stored(votes.select("group_doc_id", "field", F.lit(0).alias("blk"), "value", "w", "first"), "p2-votes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = votes.groupBy("group_doc_id", "field").agg(F.count("*").alias("n"))
    large = stored(size.where(F.col("n") > BLOCK), "p2-large")
    schema = f"group_doc_id {kind}, field string, value string"

    def closest(key: tuple, values: list[str], weights: list[float], firsts: list) -> list[tuple]:
        target = consensus(values, weighed(key[1], values, weights))
        return [(*key, min(zip(values, weights, firsts), key=lambda v: (distance(v[0], target), -v[1], v[2]))[0])]

    def block(key: tuple, values: list[str], weights: list[float], firsts: list) -> list[tuple]:
        """The consensus of a block as a value that weighs as much as all of it."""
        return [(*key, "".join(consensus(values, weighed(key[1], values, weights))), float(sum(weights)), min(firsts))]

    on = ["group_doc_id", "field"]
    few = voted(votes.join(large.select(*on), on, "left_anti").select(votes.columns), on, closest, schema)
    largest = large.agg(F.max("n")).first()[0]
    if not largest:
        return few
    many = votes.join(large.select(*on), on).select(votes.columns)
    level, wide = many, f"group_doc_id {kind}, field string, blk int, value string, w double, first {kind}"
    depth = 0
    while largest > BLOCK:
        level = level.withColumn("blk", F.pmod(F.xxhash64("value"), F.lit(-(-largest // (BLOCK // 2)))).cast("int"))
        level = stored(voted(level, [*on, "blk"], block, wide), f"p2-level{depth}")
        largest = level.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
        depth += 1
    target = voted(level, on, lambda key, v, w, f: [(*key, "".join(consensus(v, weighed(key[1], v, w))))], schema).withColumnRenamed("value", "target")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "value", 2 << 20):
            far = [distance(v, _pieces(t)) for v, t in zip(b.column(2).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(far, pa.float64())], ["group_doc_id", "field", "value", "w", "first", "far"])

    scored = many.join(target, on).select(*on, "value", "w", "first", "target").mapInArrow(near, f"group_doc_id {kind}, field string, value string, w double, first {kind}, far double")
    return few.unionByName(scored.groupBy(*on).agg(F.min_by("value", F.struct("far", -F.col("w"), "first")).alias("value")))


_LAST = 2**63 - 1


def standing() -> Column:
    """A record's version, time and id as words whose order is the order of the records, the best last."""
    version = F.coalesce(F.col("version").cast("decimal(20,0)") + 2**31 + 1, F.lit(0))
    time = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")).cast("decimal(20,0)") + 2**62, F.lit(0))
    word = lambda sign, x: F.concat(F.lit(sign), F.lpad(x.cast("decimal(20,0)").cast("string"), 20, "0"))
    return F.concat_ws(" ", word("v", version), word("t", time), word("d", F.lit(_LAST) - F.col("doc_id")))


def survivor(col: Column, kind: str) -> Column:
    """The doc_id that a standing spells."""
    return (F.lit(_LAST) - F.element_at(F.split(col, " d"), -1).cast("bigint")).cast(kind)


def survivors(docs: DataFrame, member: DataFrame) -> DataFrame:
    """(group_doc_id, survivor_doc_id): the record whose standing the group votes for."""
    best = merged_fields(docs.withColumn(STANDING, standing()), member, (STANDING,))
    return best.select("group_doc_id", survivor(F.col("value"), docs.schema["doc_id"].dataType.simpleString()).alias("survivor_doc_id"))


def held_fields(docs: DataFrame, member: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per group with the fields of HELD and TEXT_BOUND that ``docs`` has; ``chosen`` gives the hash of each group's text."""
    names = [f for f in (*HELD, *TEXT_BOUND) if f in docs.columns]
    own = docs.select("doc_id", F.struct("version", "created_at", -F.col("doc_id")).alias("rank_"), F.xxhash64("text").alias("own_text"), F.struct(*names).alias("x")).dropDuplicates(["doc_id"])
    held = member.join(own, "doc_id").join(chosen, "group_doc_id")

    def best(f: str) -> Column:
        value = F.col(f"x.{f}")
        there = value.isNotNull() if dict(docs.dtypes)[f] != "string" else F.trim(value) != ""
        rank = F.struct(F.col("own_text") == F.col("chosen"), "rank_") if f in TEXT_BOUND else F.col("rank_")
        return F.max_by(value, F.when(there, rank)).alias(f)

    return held.groupBy("group_doc_id").agg(*map(best, names))


def best_records(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (group_doc_id, doc_id) and one record per group: survivor_doc_id and the merged fields."""
    member = stored(groups(docs), "p2-members")
    fields = merged_fields(docs.withColumn(STANDING, standing()), member, (STANDING, *FIELDS))
    wide = fields.groupBy("group_doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    own = survivor(F.col("m")[STANDING], docs.schema["doc_id"].dataType.simpleString()).alias("survivor_doc_id")
    record = wide.select("group_doc_id", own, *[F.col("m")[f].alias(f) for f in FIELDS])
    return member, record.join(held_fields(docs, member, record.select("group_doc_id", F.xxhash64("text").alias("chosen"))), "group_doc_id", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members with the survivor of the record that their group builds by the vote of all fields."""
    member, record = best_records(table(spark, sf_dir, "documents"))
    # written whole, else the optimizer drops the fields that are not returned and with them their vote
    record = stored(record, "p2-records")
    return member.join(record, "group_doc_id").select("group_doc_id", "doc_id", "survivor_doc_id")


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_records(table(spark, sf_dir, "documents"))[1]
