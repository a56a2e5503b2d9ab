"""Operators on small fixtures: thresholds, orders, ties, empty input, nulls."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answer, chunking, control, dedup, embed, metadata, policy, search, tables
from lodestone.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_hashes(spark):
    a, b = "  Hello   World!\nThis is A Test.  ", "hello world! this is a test."
    assert one(spark, T.content_hash(F.lit(a))) == one(spark, T.content_hash(F.lit(b))) == hashlib.sha256(b.encode()).hexdigest()
    assert one(spark, T.chunk_hash(F.lit("x"))) == hashlib.sha256(b"x").hexdigest()


def test_words_like_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", " ", "\n", " ", "é", "\t", " ", ".", "x1"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.word_count(F.col("t")).alias("n"), T.squeeze(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.n == len(r.t.split()) and r.s == re.sub(r"\s+", " ", r.t.strip())


@pytest.mark.parametrize("query,kind,found", [("how to read the diagram", "VISUAL", []), ("P2001 wired to AB-12", "RELATIONSHIP", ["P2001", "AB-12"]), ("repair steps", "PROCEDURAL", []), ("E-104", "TECHNICAL", []), ("hello", "FACTUAL", [])])
def test_intent(spark, query, kind, found):
    assert one(spark, T.intent(F.lit(query))) == kind
    assert one(spark, T.entities(F.lit(query))) == found


def test_packing_like_a_loop(spark):
    rng = random.Random(5)
    pages = [[" ".join(["w"] * rng.randint(1, 400)) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, b array<string>").select("i", chunking.pack(F.col("b")).alias("s"))
    for r in df.collect():
        want, open_, n = [], [], 0
        for b in pages[r.i]:
            open_.append(b)
            n += len(b.split())
            if n >= 768:
                want, open_, n = [*want, " ".join(open_)], [], 0
        assert r.s == want + ([" ".join(open_)] if open_ else [])


def test_children_cover_their_parent(spark):
    page = spark.createDataFrame([("d", "f", 1, ["a b " * 200])], "document_id string, filename string, page_number int, blocks array<string>")
    p = chunking.sections(page)
    kids = chunking.children(p).orderBy("chunk_id").collect()
    assert [k.chunk_id for k in kids] == ["d::p1::s0::c0", "d::p1::s0::c1", "d::p1::s0::c2"]
    assert " ".join(k.content for k in kids).split() == p.first().content.split()


def test_boxes(spark):
    b = F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0)), F.array(F.lit(0.0), F.lit(3.0), F.lit(2.0), F.lit(9.0)))
    assert one(spark, chunking.box_union(b)) == [0.0, 2.0, 3.0, 9.0]
    assert one(spark, chunking.box_union(F.array(F.array(F.lit(0.0))))) is None


def near_texts():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(120)) for _ in range(6)]
    rows = [t for b in base for t in (b, b.upper(), f"  {b} ", b + " end", b.replace("w1", "v1", 2))]
    return [*rows, "alone", "Alone"]


def links(rows):
    """Every pair of keys linked by rows (a, b, kind)."""
    rep = {r.b: r.a for r in rows if r.kind == "member"}
    members: dict = {}
    for r in rows:
        for x in (r.a, r.b):
            members.setdefault(rep.get(x, x), set()).add(x)
    near = [(r.a, r.b) for r in rows if r.kind == "near"] + [(m, m) for m in members]
    return {(min(x, y), max(x, y)) for a, b in near for x in members[a] for y in members[b] if x != y}


def test_near_members_by_brute_force(spark):
    texts = near_texts()
    sig = dedup.minhash(spark.createDataFrame(list(enumerate(texts)), "k bigint, t string"), "k", "t")
    sigs = {r.k: r.sig for r in sig.collect()}
    band = lambda s: {(i, *s[i : i + 8]) for i in range(0, 64, 8)}
    want = {(a, b) for a in sigs for b in sigs if a < b and sum(p == q for p, q in zip(sigs[a], sigs[b])) / 64 >= 0.8 and band(sigs[a]) & band(sigs[b])}
    assert links(dedup.near_members(sig, "k").collect()) == want and (30, 31) in want and (0, 2) in want


def test_near_versions_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"id{i}", rng.choice("tu"), rng.randint(1, 4), rng.choice(["f", "g", None]), f"s{i}", t) for i, t in enumerate(near_texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, id string, tenant_id string, batch_no int, file_name string, sha256 string, text string")
    sig = dedup.minhash(docs, "doc_id", "text")
    linked = links(dedup.near_members(sig, "doc_id").collect())
    none = spark.createDataFrame([], "document_id string, parent_id string, content_hash string")
    plain = {r.doc_id: r.classification for r in dedup.version_class(docs, none).collect()}
    want = {}
    for x in rows:
        old = [y for y in rows if (min(x[0], y[0]), max(x[0], y[0])) in linked and y[2] == x[2] and y[3] < x[3]]
        want[x[0]] = plain[x[0]] if plain[x[0]] != "NEW" or not old else "UPDATED_VERSION" if any(y[4] == x[4] and x[4] for y in old) else "NEAR_DUP"
    got = dedup.version_class(docs, none, dedup.near_earlier(docs, sig)).collect()
    assert {r.doc_id: r.classification for r in got} == want and len(got) == len(rows) and {"NEAR_DUP", "UPDATED_VERSION", "NEW"} <= set(want.values())


def test_minhash_pairs(spark):
    rows = [("a", "Hydraulic pressure specification for main pump model X100 is 250 bar."), ("b", "Hydraulic pressure spec for main pump model X100 is 250 bar."), ("c", "Electrical wiring diagram for safety switch relay.")]
    sig = dedup.minhash(spark.createDataFrame(rows, "k string, t string"), "k", "t")
    assert {(r.a, r.b) for r in dedup.band_pairs(sig, "k", 0.5).collect()} == {("a", "b")}
    a, b = dedup.coefficients()
    draw = random.Random(42)
    assert [int(x) for x in a] == [draw.randint(1, dedup.PRIME - 1) for _ in range(64)]
    h = 123456789
    assert int(dedup.permuted(dedup.np.array([h], dedup.np.uint64), a, b)[0, 3]) == (int(a[3]) * h + int(b[3])) % dedup.PRIME


def test_newest_twin(spark):
    rows = [(1, "t", "h", "OK", 1), (2, "t", "h", "OK", 3), (3, "t", "h", "FAILED", 9), (4, "u", "h", "OK", 5), (5, "t", None, "OK", 5)]
    got = dedup.newest_twin(spark.createDataFrame(rows, "doc_id int, tenant_id string, d string, status string, created_at int"), "d")
    assert {(r.doc_id, r.canonical) for r in got.collect()} == {(1, 2), (2, 1), (3, 2)}


def ranked(spark, *lists):
    return [spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int") for ids in lists]


def test_fusion(spark):
    got = search.rrf(*ranked(spark, ["chunk_1", "chunk_2"], ["chunk_1", "chunk_3"])).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["chunk_1", "chunk_2", "chunk_3"]
    assert got[0].score == round(2 / 61, 5) and got[0].score > got[1].score == got[2].score


@settings(max_examples=8, deadline=None)
@given(st.permutations(["a", "b", "c", "d"]), st.permutations(["c", "d", "e"]))
def test_fusion_scores_ignore_list_order(spark, x, y):
    one_way = {(r.chunk_id, r.score) for r in search.rrf(*ranked(spark, x, y)).collect()}
    assert one_way == {(r.chunk_id, r.score) for r in search.rrf(*ranked(spark, y, x)).collect()}


@pytest.mark.parametrize("score,level", [(0.85, "HIGH"), (0.55, "MEDIUM"), (0.2, "LOW"), (None, "LOW")])
def test_confidence(spark, score, level):
    q = spark.createDataFrame([("q",)], "query_id string")
    r = spark.createDataFrame([("q", score)] if score is not None else [], "query_id string, score double")
    assert search.confidence(r, q).first()[1:3] == (level, score or 0.0)


def test_access(spark):
    q = spark.createDataFrame([("q", "t", None, ["PUBLIC"]), ("none", "t", None, [])], "query_id string, tenant_id string, knowledge_base_id string, levels array<string>")
    c = spark.createDataFrame([("a", "t", "k", "PUBLIC"), ("b", "t", "k", None), ("c", "u", "k", "PUBLIC")], "chunk_id string, tenant_id string, knowledge_base_id string, access_classification string")
    assert [(r.query_id, r.chunk_id) for r in policy.secured(c, q).collect()] == [("q", "a")]


def test_cosine_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "id bigint, vector array<float>")
    got = search.cosine_topk(rows, rows.select(F.col("id").alias("query_id"), "vector"), 1)
    assert {(r.query_id, r.id) for r in got.collect()} == {(i, i) for i in range(7)}


def test_grounding(spark):
    rows = [("pump pressure", "the pump has pressure"), ("unrelated words entirely", "pump"), ("no relevant evidence", "x"), ("a b", "x"), ("any", None)]
    got = answer.grounded(spark.createDataFrame(rows, "answer string, evidence string")).collect()
    assert [r.verification_status for r in got] == ["SUPPORTED", "UNSUPPORTED", "SUPPORTED", "SUPPORTED", "UNSUPPORTED"]


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, keep string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "k int, v string, keep string")
    assert {tuple(r) for r in tables.upsert(old, new, "k", ["v"]).collect()} == {(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")}
    assert [r.k for r in tables.insert_missing(old, new, "k").collect()] == [3]
    assert tables.grow(old, {"n": ("int", 7), "v": ("int", 0)}).first().n == 7


def test_cascade(spark):
    c = spark.createDataFrame([("s1", None, "d1"), ("c1", "s1", "d1"), ("s2", None, "d2")], "chunk_id string, parent_id string, document_id string")
    nodes, edges = tables.graph(c)
    left, kept = tables.cascade(nodes, edges, spark.createDataFrame([("d1",)], "id string"))
    assert {r.id for r in left.collect()} == {"d2", "s2"} and kept.count() == 1


def test_embedding_once_per_text(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return embed.feature_hashing(texts)

    chunks = spark.createDataFrame([("a", "x y", None), ("b", "x y", None), ("c", "z", None)], "chunk_id string, content string, content_hash string")
    out, rows = embed.embedded(chunks, spark.createDataFrame([], "cache_key string, vector array<float>"), "m", "1", model)
    assert out.where("vector is null").isEmpty() and calls.value == 2
    again, new = embed.embedded(chunks, rows, "m", "1", model)
    assert again.where("vector is null").isEmpty() and new.isEmpty()


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"text")
    good, bad = files.validated(files.landing(spark, str(tmp_path)))
    assert good.count() == 1 and bad.first().reason == "kind not supported"
    assert metadata.load_config(str(tmp_path), "none") == metadata.GENERIC and metadata.load_config(None, "manufacturing")["entity_types"]
    (tmp_path / "bad.json").write_text("{")
    assert metadata.load_config(str(tmp_path), "bad")["domain"] == "generic"
    assert one(spark, files.html_blocks(F.lit("<p>a &amp;lt; <b>b</b></p><li> </li>"))) == ["a &lt; b"]


def test_metrics(spark):
    rows = [("a", 1, False), ("a", 2, True), ("b", 1, False)]
    m = control.retrieval_metrics(spark.createDataFrame(rows, "query_id string, rank int, relevant boolean"), 2).first()
    assert (m.recall_at_k, m.precision_at_k, m.mrr) == (0.5, 0.25, 0.25)
