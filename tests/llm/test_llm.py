"""The training-data operators: brute force on small fixtures, round trips, defined cases."""

import base64
import os
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import encode, history, knn, neardup, ocr, pack, pii, residue, shingle, split, survivors

WORDS = re.compile(r"[^\W_]+")
VOCABULARY = f"{os.environ.get('LODESTONE_TOKENIZERS', '/opt/tokenizers')}/byte_bpe_50k.tiktoken"
CHUNK = "chunk_id string, parent_id string, document_id string, content string, page_number int, section string"


def chunks(spark, rows):
    """rows of (chunk_id, content); all children."""
    return spark.createDataFrame([(c, "p", "d", t, 1, "s") for c, t in rows], CHUNK)


def likeness(a, b):
    x, y = (WORDS.findall(t.lower()) for t in (a, b))
    if min(len(x), len(y)) < 40:
        return 0.0
    p, q = set(zip(x, x[1:])), set(zip(y, y[1:]))
    return len(p & q) / len(p | q)


def edited(rng, n=40, vocabulary=400):
    texts = []
    for _ in range(n):
        base = [f"w{rng.randint(0, vocabulary)}" for _ in range(rng.randint(30, 90))]
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            new = list(base)
            for _ in range(rng.randint(0, 6)):
                new[rng.randrange(len(new))] = f"w{rng.randint(0, vocabulary)}"
            texts.append(new)
    return [" ".join(t) for t in texts]


# 1 splitting


def coarsest(text, limit):
    """Brute force: the coarsest kind at which all trimmed segments are within the limit."""
    for kind, cut in zip(split.KINDS, split._CUTS):
        if all(len(s.strip()) <= limit for s in cut.split(text)):
            return kind
    return "none"


@pytest.mark.parametrize("seed", range(4))
def test_pieces(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(["ab", ". ", "\n", "\n\n", " ", "x" * 70, "! ", "\r\n", " ", "\u2003"]) for _ in range(rng.randint(1, 400)))
        limit, overlap = rng.choice([30, 60, 100]), rng.choice([0, 7, 20, 29])
        kind, got = split.split(text, limit, overlap)
        assert kind == coarsest(text, limit)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(e - s <= limit for s, e, _ in got)
        assert all(b[0] == a[1] - (overlap if len(got) > 1 else 0) and b[1] > a[1] for a, b in zip(got, got[1:]))


def least_cost(text, limit, overlap):
    """Brute force over all ways to cut a short text: the least worst kind, then the least cost."""
    at, kinds = split.cut_places(text, limit, overlap)
    at, kinds = at.tolist(), kinds.tolist()
    share = -(-(len(text) - overlap) // (limit - overlap))
    even = (len(text) - overlap) / share + overlap
    best = {}

    def go(start, after, worst, cost):
        for p, k in zip(at, kinds):
            if p > after and p - start <= limit:
                last = p == len(text)
                c = cost + ((p - start - even) / limit) ** 2 * 4 + (0 if last else split.PENALTY[k])
                w = worst if last else max(worst, k)
                if last:
                    best[w] = min(best.get(w, 1e9), c)
                elif p - overlap > 0:
                    go(p - overlap, p, w, c)

    go(0, 0, 0, 0.0)
    return min(best), best[min(best)], even


def test_least_cost_by_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        text = "".join(rng.choice(["ab ", "c. ", "d\n", "e\n\n", "fgh "]) for _ in range(rng.randint(8, 9)))
        worst, cost, even = least_cost(text, 16, 2)
        got = split.split(text, 16, 2)[1]
        assert max([k for _, _, k in got[:-1]], default=0) == worst
        own = sum(((e - s - even) / 16) ** 2 * 4 for s, e, _ in got) + sum(split.PENALTY[k] for _, _, k in got[:-1])
        if len(text) > 16:
            # finer kinds than the worst may not be left out, so the cost is the least of all ways of that worst kind
            assert own <= cost + 1e-9
    with pytest.raises(ValueError):
        split.split("a b", 2, 2)


def test_boundaries(spark):
    long = "word " * 30
    cases = {"paragraph": f"{long}\n \n{long}", "line": f"{long}\n{long}", "sentence": f"{long}. {long}", "word": long * 2, "none": "x" * 200}
    for kind, text in cases.items():
        assert split.split(text, 160, 10)[0] == coarsest(text, 160) == kind
    rows = [(k, t) for k, t in cases.items()] + [("word", cases["word"]), ("short", "x"), ("null", None), ("blank", " " * 500)]
    got = split.split_chunks(chunks(spark, rows).withColumn("extra", F.lit(1)), 160, 10)
    assert {(r.chunk_id, r.boundary) for r in got.collect()} == {(k, k) for k in cases} | {("blank", "paragraph")}
    assert split.split_chunks(chunks(spark, rows).limit(0), 160, 10).count() == 0


# 2 survivors


def test_groups_and_survivors(spark):
    u = [f"0000000{i}-0000-4000-8000-00000000000{i}" for i in range(10)]
    rows = [
        (1, u[1], None, None, 1, 5, "a b c", "x"),
        (2, u[2], u[1].upper(), None, 2, 5, "a b c d", None),
        (3, u[3], None, "{" + u[2] + "}", 2, None, "a b d", "y"),
        (4, u[4], u[9], None, None, 1, "t", None),  # tied through an id without a record
        (5, u[5], None, "urn:uuid:" + u[9].replace("-", ""), None, 1, None, None),
        (6, u[6], "N/A", "", 1, 1, "alone", None),
        (7, u[7], u[7], None, 1, 1, "self", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, id string, canonical_document_id string, supersedes string, version int, created_at int, text string, file_name string")
    docs = docs.withColumn("created_at", F.timestamp_seconds("created_at")).withColumns({c: F.lit(None).cast("string") for c in ("lang", "industry", "source", "metadata")})
    member, record = survivors.best_records(docs)
    assert {tuple(r) for r in member.collect()} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)}
    assert {(r.group_doc_id, r.survivor_doc_id) for r in record.collect()} == {(1, 2), (4, 4)}
    assert record.where("group_doc_id = 1").first().text in ("a b c", "a b c d", "a b d")


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 60):03}", f"n{rng.randint(0, 60):03}") for _ in range(40)] + [("hub", f"s{i}") for i in range(50)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    want: dict = {}
    for x in parent:
        want.setdefault(find(x), set()).add(x)
    got: dict = {}
    for r in survivors.components(spark.createDataFrame(edges, "u string, v string")).collect():
        got.setdefault(r.label, set()).add(r.node)
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_consensus_votes():
    assert "".join(survivors.consensus(["pump A 10", "pump A 11", "pump B 11"], [1, 1, 1])) == "pump A 11"
    assert "".join(survivors.consensus(["x y", "x z"], [1, 5])) == "x z"


def test_merged_record_has_all_fields(spark):
    u = [f"0000000{i}-0000-4000-8000-00000000000{i}" for i in range(4)]
    rows = [(1, u[1], None, 1, 5, "old words", 7, "COMPLETED", "h1"), (2, u[2], u[1], 2, 6, "new words", None, " ", None), (3, u[3], u[1], 2, 7, None, None, None, "h3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, id string, canonical_document_id string, version int, created_at int, text string, page_count int, status string, content_hash string")
    docs = docs.withColumn("created_at", F.timestamp_seconds("created_at")).withColumns({c: F.lit(None).cast("string") for c in ("supersedes", "file_name", "lang", "industry", "source", "metadata")})
    record = survivors.best_records(docs)[1]
    got = record.collect()
    assert [(r.survivor_doc_id, r.text, r.version, r.page_count, r.status, r.content_hash) for r in got] == [(3, "new words", 2, 7, "COMPLETED", "h3")]
    assert dict(record.dtypes)["page_count"] == "int" and dict(record.dtypes)["created_at"] == "timestamp"


def test_long_values_vote_by_tokens():
    text = lambda a, b, c: f"The pump {a} was checked by {b} and then {c} again. " + "Nothing else was found in the plant. " * 20 + "The end."
    assert "".join(survivors.consensus([text("P1", "Ann", "run"), text("P1", "Bob", "cut"), text("P2", "Bob", "run")], [1, 1, 1])) == text("P1", "Bob", "run")
    x, y = survivors._pieces(text("P1", "Ann", "run")), survivors._pieces(text("P2", "Bob extra", "cut") + "More.\n" * 90)
    ops = list(survivors.aligned(x, y))
    assert all(x[a:b] == y[c:d] for op, a, b, c, d in ops if op == "equal") and ops[0][1] == ops[0][3] == 0 and (ops[-1][2], ops[-1][4]) == (len(x), len(y))
    assert all(p[2] == q[1] and p[4] == q[3] for p, q in zip(ops, ops[1:]))


def test_survivors_are_voted_for(spark):
    """The rule by brute force, also in a group of more values than a block holds; the plan holds the alignment."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, -3]), rng.choice([None, 5, 6]), 0 if i < 90 else rng.randint(1, 20)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id bigint, version int, created_at int, g bigint").withColumn("created_at", F.timestamp_seconds("created_at"))
    member = docs.select(F.col("g").alias("group_doc_id"), "doc_id")
    df = survivors.survivors(docs, member)
    low = lambda x: (x is not None, x or 0)
    want = {g: max((r for r in rows if r[3] == g), key=lambda r: (low(r[1]), low(r[2]), -r[0]))[0] for g in {r[3] for r in rows}}
    assert {r.group_doc_id: r.survivor_doc_id for r in df.collect()} == want
    assert "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


def test_found_survivors_come_from_the_merged_records(spark, tmp_path, monkeypatch):
    """Every field of every group is voted on for p2_found, too."""
    u = [f"0000000{i}-0000-4000-8000-00000000000{i}" for i in range(4)]
    rows = [(1, u[1], None, 1, 5, "a b c"), (2, u[2], u[1], 2, 6, "a b d"), (3, u[3], u[1], 2, 7, "x b d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, id string, canonical_document_id string, version int, created_at int, text string").withColumn("created_at", F.timestamp_seconds("created_at"))
    docs.withColumns({c: F.lit("x") for c in ("file_name", "lang", "industry", "source", "metadata")} | {"supersedes": F.lit(None).cast("string")}).write.parquet(f"{tmp_path}/documents.parquet")
    kept: dict = {}
    keep = survivors.stored
    monkeypatch.setattr(survivors, "stored", lambda df, name: kept.setdefault(name, keep(df, name)))
    got = survivors.p2_found(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 3), (1, 2, 3), (1, 3, 3)}
    assert {r.field for r in kept["p2-votes"].collect()} == {survivors.STANDING, *survivors.FIELDS}
    assert [(r.survivor_doc_id, r.text, r.version) for r in kept["p2-records"].collect()] == [(3, "a b d", 2)]


# 3 personal information


def test_pii_types(spark):
    rows = [
        ("mail", "Write to <Anna.B+qa@mail.korvix.example> now"), ("at", "to joris (at) korvix.test, no subject"), ("phone", "Call +1 212 555 0154 before entry."), ("part", "Part no. 798-205-6420 fits. Drawing 815-66-7946 too. Torque M8@734 Nm."),
        ("id", "Gate pass against 959-16-4537."), ("pass", "passport no. XX8557097."), ("addr", "Parcels go to 49 rue des Vieux Quais, 00553 Villarena."), ("box", "PO Box 1039, Tarnstedt"), ("name", "Key kept by Frau Ostrevant."),
        ("full", "Witness: Dagny Ostrevant"), ("rev", "OSTREVANT, Dagny opened it"), ("init", "As agreed with R. Ostrevant, it stays."), ("alone", "ostrevant@korvix.test and the Titan Corvane press"), ("null", None), ("empty", ""),
    ]
    rows += [(f"t{i}", t) for i, t in enumerate(["Mr Ostrevant", "Dagny OSTREVANT", "Dagny MARCHETANE", "Frau Marchetane"])]
    rows += [("bare", "Call 5551234567 now"), ("free", "or dial 1-800-555-0199 at night"), ("ssn", "SSN 123456789"), ("cyr", "Ответ даёт г-н Остревант."), ("count", "The counter shows 5551234567 turns.")]
    found = pii.finds(chunks(spark, rows + rows[:1]), pii.Finder(*pii.lexicons(chunks(spark, rows))))
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.chunk_id, set()).add(r.kind)
    want = {"mail": {"EMAIL"}, "at": {"EMAIL"}, "phone": {"PHONE"}, "id": {"ID_NUMBER"}, "pass": {"ID_NUMBER"}, "addr": {"ADDRESS"}, "box": {"ADDRESS"}, "alone": {"EMAIL"}} | {k: {"NAME"} for k in ("name", "full", "rev", "init", "t0", "t1", "t2", "t3", "cyr")} | {"bare": {"PHONE"}, "free": {"PHONE"}, "ssn": {"ID_NUMBER"}}
    assert got == want


def test_names_of_few_mentions_in_a_large_corpus(spark):
    rows = [("a", "Mr Ostrevant"), ("b", "Dagny OSTREVANT"), ("c", "Dagny MARCHETANE"), ("d", "Frau Marchetane")]
    small = chunks(spark, rows)
    large = small.unionByName(small.limit(1).withColumn("content", F.repeat(F.lit("0"), F.lit(130_000_000))))
    assert pii.lexicons(large) == pii.lexicons(small) == (frozenset({"ostrevant", "marchetane"}), frozenset({"dagny"}))


def test_names_of_sections_count(spark):
    """Sections teach what no child says, and do not say once more what their children say."""
    rows = [("s1", None, "d", "Mr Ostrevant. Dagny OSTREVANT", 1, "s"), ("s2", None, "d", "Frau Marchetane. Dagny MARCHETANE", 1, "s"), ("c2", "s2", "d", "Frau Marchetane.", 1, "s"), ("s3", None, "d", "Mr Verlinden came", 1, "s"), ("c3", "s3", "d", "Mr Verlinden came", 1, "s")]
    df = spark.createDataFrame(rows, CHUNK)
    for some in (df, df.withColumn("chunk_type", F.lit("TEXT"))):
        assert pii.lexicons(some) == (frozenset({"ostrevant", "marchetane"}), frozenset({"dagny"}))


def test_surrogates(spark):
    rows = [("a", "Call 555-555-0155, Mr Torrelmo."), ("b", "Call 555-555-0155 or 555-555-0156, Mr Torrelmo."), ("c", None), ("d", "none")]
    got = {r.chunk_id: r for r in pii.redacted(chunks(spark, rows), b"k").collect()}
    assert got["a"].redacted_text == "Call [PHONE], [NAME]." and got["d"].surrogate_text == "none" and got["c"].redacted_text is None
    phone = lambda t: re.findall(r"\d{3}-\d{3}-\d{4}", t)
    assert phone(got["a"].surrogate_text) == phone(got["b"].surrogate_text)[:1] and len(set(phone(got["b"].surrogate_text))) == 2
    s = pii.Surrogates(b"k")
    assert len({s.digits(f"{i:04}", "PHONE") for i in range(10_000)}) == 10_000
    spelt = s.of("anna[at]korvix[dot]example", "EMAIL")
    assert "anna" not in spelt and "korvix" not in spelt and spelt.endswith("[dot]example") and "[at]" in spelt
    assert len({s.initial(c, "0") for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}) == 26
    assert s.of("Frau Dagny Ostrevant", "NAME").split()[1].endswith("a") and s.of("Frau Dagny Ostrevant", "NAME").startswith("Frau ")
    assert not s.of("Mr Dagna Ostrevant", "NAME").split()[1].endswith("a") and s.of("Mr OSTREVANT", "NAME").isupper() is False and s.of("Mr OSTREVANT", "NAME").split()[1].isupper()
    assert all("а" <= c <= "я" for c in s.word("остревант", "0")) and s.of("R. Ostrevant", "NAME").split()[1] == s.of("Mr Ostrevant", "NAME").split()[1]
    assert s.of("Mr Ostrevant", "NAME") != pii.Surrogates(b"other").of("Mr Ostrevant", "NAME")


def test_surrogates_meet_neither_each_other_nor_real_ones(spark, monkeypatch):
    """Words from a space so small that many meet at first are drawn until all are distinct."""
    monkeypatch.setattr(pii.Surrogates, "word", lambda self, w, salt, gender="": "abcdefghijklmnopqrstuvwxyz"[self.draw("w", w.lower(), salt) % 26] * 3)
    names = ["Mr " + w for w in ("Aaa", "Bbb", "Ostrevant", "Torrelmo", "Marchetane", "Kelvane", "Dorvane", "Selmark", "Tarnow", "Vireo")]
    found = spark.createDataFrame([("c", 0, 1, "NAME", n) for n in names + names[:2]] + [("c", 0, 1, "NAME", "MR OSTREVANT")], pii.FINDS)
    got = {r.entity: r.surrogate for r in pii.replacements(found, b"k").collect()}
    assert set(got) == {*names, "MR OSTREVANT"} and len({v.lower() for v in got.values()}) == len(names)
    assert not {v.lower() for v in got.values()} & {n.lower() for n in names}


# 4 vectors


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(60, 64))
    x = np.concatenate([c + rng.normal(size=(rng.integers(1, 9), 64)) * 0.15 for c in centre])
    rows = [(f"c{i:04}", v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    bad = [("null", None), ("zero", [0.0] * 64), ("short", [1.0]), ("nan", [float("nan")] * 64), ("hole", [None] * 64)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "chunk_id string, vector array<float>").withColumn("created_at", F.current_timestamp())
    got: dict = {}
    for r in knn.nearest(df, 3, 0.85).collect():
        got.setdefault(r.chunk_id, set()).add(r.neighbour_id)
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {rows[i][0]: {rows[j][0] for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.85} for i in range(len(rows))}
    pairs = [(k, v) for k, w in want.items() for v in w]
    assert sum(v in got.get(k, ()) for k, v in pairs) >= 0.95 * len(pairs)
    assert not set(got) & {b for b, _ in bad}
    assert knn.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [64, 2])
def test_long_files_are_compared_whole(spark, blocks):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 64)) + 2.0
    x[60:] = x[:30] + rng.normal(size=(30, 64)) * 0.05
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    own = spark.createDataFrame(rows + rows[:1] * 200, "cls bigint, vector array<float>")
    base = np.eye(64, dtype=np.float32)[:1]
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i != j}
    found = knn.compared(knn.postings(own, base), 0.9, 1, blocks, 8)  # one file of 12 blocks
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 60


def test_equal_vectors(spark):
    df = spark.createDataFrame([(f"c{i:02}", [1.0] * 64) for i in range(15)], "chunk_id string, vector array<float>")
    got = {(r.chunk_id, r.neighbour_id) for r in knn.nearest(df, 2, 0.85).collect()}
    assert {b for a, b in got if a == "c14"} == {"c00", "c01"} and {b for a, b in got if a == "c00"} == {"c01", "c02"}


def test_agreement_is_footrule():
    rng = np.random.default_rng(3)
    perm = np.array([rng.permutation(20)[: knn.LENGTH] for _ in range(30)])

    def footrule(a, b):
        place = lambda x, p: list(x).index(p) if p in x else knn.LENGTH
        return sum(abs(place(a, p) - place(b, p)) for p in {*a, *b})

    n = knn.LENGTH
    for a in perm[:6]:
        assert [n * (n + 1) - 2 * int(x) for x in knn.agreement(a[None], perm)[0]] == [footrule(a, b) for b in perm]


# 5 and 7 near duplicates


def test_near_pairs_by_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"c{i:04}", t) for i, t in enumerate(edited(rng))]
    rows += [("copy", rows[0][1] + " "), ("same", rows[0][1]), ("short", "a few words"), ("null", None), ("empty", "")]
    want = {tuple(sorted((a, b))) for (a, s), (b, t) in combinations(rows, 2) if s and t and likeness(s, t) >= 0.6}
    got = [(r.chunk_id_a, r.chunk_id_b) for r in neardup.near_pairs(chunks(spark, rows + rows[:3])).collect()]
    assert len(got) == len(set(got)) and not set(got) - want and len(set(got)) >= 0.98 * len(want)
    assert neardup.near_pairs(chunks(spark, rows).limit(0)).count() == 0


def test_large_buckets_go_the_exact_way(spark):
    rng = random.Random(8)
    rows = [(0, i, t) for i, t in enumerate(edited(rng, 25))]
    texts = spark.createDataFrame(rows, "scope bigint, cls bigint, text string")
    want = {(a, b) for (_, a, s), (_, b, t) in combinations(rows, 2) if likeness(s, t) >= 0.6}
    pairs = shingle.candidates(texts, neardup.tensor_keys, "test", cap=1)  # every bucket is too large
    assert {(r.a, r.b) for r in shingle.verified(pairs, texts).collect()} == want


def test_one_bucket_above_the_cap(spark):
    rng = random.Random(12)
    rows = [(rng.choice([1, 2]) << 40, 1000 + i, t) for i, t in enumerate(edited(rng, 40))]
    texts = spark.createDataFrame(rows, "scope bigint, cls bigint, text string")
    want = {(a, b) for (p, a, s), (q, b, t) in combinations(rows, 2) if p == q and likeness(s, t) >= 0.6}
    one_key = lambda pairs, starts: (np.zeros((len(starts), 1), np.uint64), np.zeros((len(starts), 2), np.uint64))
    pairs = shingle.candidates(texts, one_key, "test", cap=16)
    assert want and {(r.a, r.b) for r in shingle.verified(pairs, texts).collect()} == want


def test_hot_keys_are_split(spark):
    rows = [(k, c) for k in (1, 2) for c in range(100 if k == 1 else 5)]
    split = shingle.split_hot(spark.createDataFrame(rows, "key bigint, cls bigint"), 16)
    assert max(r["count"] for r in split.groupBy("key").count().collect()) <= 32
    got = {(r.a, r.b) for r in shingle.pairs_of_runs(split, None, 0).collect()}
    assert got == set(combinations(range(100), 2))


def test_keys_above_the_cap_are_passed_on(spark):
    rows = [(1, c, 0, 0) for c in range(300)] * 2 + [(2, 500, 0, 0), (2, 501, 0, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = [(r.a, r.b) for r in shingle.pairs_of_runs(spark.createDataFrame(rows, "key bigint, cls bigint, s0 bigint, s1 bigint"), 20, 0).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {a for a, b in got if b is None} == set(range(300)) and {(a, b) for a, b in got if b is not None} == {(500, 501)}


def test_pairs_of_copies_are_written_as_they_come(spark, monkeypatch):
    """Pairs of chunks are not shuffled, but for chunks that are stored with several contents."""
    monkeypatch.setattr(neardup, "LISTED", 3)
    one = " ".join(f"w{i}" for i in range(60))
    two = one + " more"
    rows = [(f"a{i}", one) for i in range(8)] + [(f"b{i}", two) for i in range(5)] + [("ab", one), ("ab", two), ("ba", two), ("ba", one)]
    want = set(combinations(sorted({c for c, _ in rows}), 2))
    df = neardup.near_pairs(chunks(spark, rows))
    got = [(r.chunk_id_a, r.chunk_id_b) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert df._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_pairs_out_of_reach_get_no_texts(spark):
    rng = random.Random(13)
    rows = [(0, i, t) for i, t in enumerate(edited(rng, 25))]
    texts = spark.createDataFrame(rows, "scope bigint, cls bigint, text string")
    every = spark.createDataFrame([(a, b) for (_, a, _), (_, b, _) in combinations(rows, 2)], "a bigint, b bigint")
    want = {(a, b) for (_, a, s), (_, b, t) in combinations(rows, 2) if likeness(s, t) >= 0.6}
    close, own = shingle.possible(every, texts, "test")
    assert want <= {tuple(r) for r in close.collect()} and close.count() < every.count() / 2
    assert {(r.a, r.b) for r in shingle.verified(close, own).collect()} == want


def test_runs_over_batches(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 12), rng.randint(0, 60), 0, 0) for _ in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.a, r.b) for r in shingle.pairs_of_runs(spark.createDataFrame(rows, "key bigint, cls bigint, s0 bigint, s1 bigint"), None, 0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(min(a, b), max(a, b)) for (k, a, *_), (m, b, *_) in combinations(rows, 2) if k == m and a != b}


def docs_in_batches(spark, seed=11):
    rng = random.Random(seed)
    texts = edited(rng, 30)
    rows = [(i, rng.choice("tu"), rng.randint(1, 4), rng.choice(["COMPLETED", "FAILED", None]), None if i % 3 else f"SHA256:{i % 9:064x}".replace("SHA", "sha"), t) for i, t in enumerate(texts)]
    rows += [(900, "t", None, "COMPLETED", None, texts[0]), (901, None, 1, "COMPLETED", None, texts[0]), (902, "t", 2, "COMPLETED", f" {0:064X} ", None), (903, "t", 3, "COMPLETED", "none", "")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, tenant_id string, batch_no int, status string, sha256 string, text string")


def test_history_by_brute_force(spark):
    rows, docs = docs_in_batches(spark)
    digest = lambda x: x.strip().lower().removeprefix("sha256:") if x and x != "none" else None
    want = set()
    for a, b in combinations([r for r in rows if r[1] and r[2]], 2):
        first, last = (a, b) if a[2] < b[2] else (b, a)
        if a[1] == b[1] and a[2] != b[2] and first[3] != "FAILED" and ((digest(a[4]) and digest(a[4]) == digest(b[4])) or (a[5] and b[5] and likeness(a[5], b[5]) >= 0.6)):
            want.add((first[0], last[0]))
    got = {(r.p, r.q) for r in history.repeats(docs).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert history.repeats(docs.limit(0)).count() == 0


def forest_rows(spark, seed):
    rows, docs = docs_in_batches(spark, seed)
    own = history.labelled(history.records(docs.where("batch_no is not null and tenant_id is not null")))
    of = {r.doc_id: r.cls for r in own.select("doc_id", "cls").collect()}
    return [r for r in rows if r[1] and r[2] and of[r[0]] is not None], own, of


def test_forest_grows_batch_by_batch(spark):
    rows, own, of = forest_rows(spark, 12)
    forest, got = history.HashForest(spark), set()
    for b in range(1, 5):
        new = history.entries(own.where(F.col("batch_no") == b))
        got |= {(r.old, r.new) for r in forest.search(new).collect()}
        assert b == 1 or forest.read_bytes > 0
        forest.append(new)
    assert forest.runs() == [(0, 3)]  # four runs of one batch each became one
    want = {(of[x[0]], of[y[0]]) for x in rows for y in rows if x[1] == y[1] and x[2] < y[2] and x[5] != y[5] and likeness(x[5], y[5]) >= 0.6}
    assert len(want - got) <= 0.02 * len(want)
    assert history.depth_for(0.6) == 3 and history.depth_for(0.99) == history.DEPTH


def test_forest_opened_again_and_widened(spark):
    rows, own, of = forest_rows(spark, 13)
    forest = history.HashForest(spark)
    forest.append(history.entries(own.where("batch_no <= 2")))
    new = history.entries(own.where("batch_no > 2"))
    again = history.HashForest(spark, forest.path)
    got = {tuple(r) for r in again.search(new).collect()}
    assert again.runs() == forest.runs() and got == {tuple(r) for r in forest.search(new).collect()}
    narrow = {tuple(r) for r in again.search(new, 0.95).collect()}
    assert narrow <= got and narrow  # whole labels are stored, so any depth can be asked
    # a run that was not finished is none
    fs, at = forest._folder("run-000001-000001")
    fs.mkdirs(at)
    assert again.runs() == [(0, 0)]
    few = dict(BITS_A_NODE=history.BITS_A_NODE, MOST_BITS=history.MOST_BITS)
    try:
        history.BITS_A_NODE, history.MOST_BITS = 1 << 9, 1 << 16  # several passes, each over its own trees
        assert got == {tuple(r) for r in again.search(new).collect()}
    finally:
        for k, v in few.items():
            setattr(history, k, v)


# 6 scanned pages


def test_noise(spark):
    plain = "the encoder is removed from the upper hopper gate and the cross-section of the pump is polished "
    rows = [(f"w{i}", plain * 3) for i in range(30)]
    rows += [
        ("hy", "the enc-\noder is removed from the upper\nhopper gate"), ("keep", "the cross-\nsection of the pump is polished"), ("mis", "the enc0dcr is removed from the upper hopper gate"), ("slip", "the encdoer is removed"),
        ("head", "Plant record KSZ-325Q\nthe encoder is removed from the upper\nhopper gate"), ("head2", "the pump is polished\nPLANT REC0RD KSZ-325Q\nand removed"), ("page", "the pump is polished\n- 12 -\nand removed"),
        ("bare", "the pump is polished and\n12\nremoved from the gate"), ("list", "the numbers\n12\n511\n34\n90"), ("split", "the enc-\nPlant record KSZ-325Q    7\noder is removed"), ("null", None), ("empty", ""),
    ]
    got: dict = {}
    for r in ocr.noise(chunks(spark, rows + rows[-5:])).collect():
        got.setdefault(r.chunk_id, set()).add(r.noise_type)
    assert got == {"hy": {"hyphenation"}, "mis": {"misread"}, "head": {"header"}, "head2": {"header"}, "page": {"page_number"}, "bare": {"page_number"}, "split": {"hyphenation", "header"}}
    text = {r.chunk_id: r.paragraph for r in ocr.repaired(chunks(spark, rows)).where("paragraph_no = 0").collect()}
    assert text["split"] == "the encoder is removed" and text["keep"] == "the cross-section of the pump is polished" and text["mis"].startswith("the encoder is")
    assert ocr.noise(chunks(spark, rows).limit(0)).count() == 0


def test_line_model_labels_by_layout():
    r = ocr.Reader({}, frozenset(), ocr.LineModel())
    names = lambda lines, titles=frozenset(): [ocr.STATES[s] for s in r.label(lines, titles)]
    assert names(["the pump is polished and", "12", "removed from the gate"]) == ["body", "page", "body"]
    assert names(["the numbers", "12", "511", "34", "90"])[1:] == ["table"] * 4
    assert names(["the pump is pol-", "ished and removed"]) == ["break", "body"]
    title = "Works manual 13 A-20"
    assert names([title, "the pump is polished"]) == ["body", "body"] and names([title, "the pump is polished"], frozenset({ocr.fold(title)})) == ["header", "body"]
    assert names(["some text", "", "some text"])[1] == "gap"
    m = ocr.LineModel()
    page = [r.sequence(["the pump is polished and", "- 12 -", "removed from the gate"], frozenset())] * 400
    before = m.emission(page[0][1])[ocr.PAGE]
    assert m.fit(page).emission(page[0][1])[ocr.PAGE] > before and m.decode(page[0]) == [0, ocr.PAGE, 0]


def test_words_of_sections_and_tables_count(spark):
    """A word that only sections and tables hold often is no misread one."""
    rows = [(f"c{i}", "p", "d", "il ne faut pas ouvrir " * 5, 1, "s") for i in range(40)] + [(f"t{i}", None, "d", "Pos 12\nPos 13", 1, "s") for i in range(40)] + [("x", "p", "d", "voir Pos 7 du plan", 1, "s")]
    got = ocr.noise(spark.createDataFrame(rows, CHUNK)).where("noise_type = 'misread'")
    assert got.isEmpty()


def test_words_and_families_beyond_memory_count(spark, monkeypatch):
    plain = "the encoder is removed from the upper hopper gate and the pump is polished naïve "
    title = "Plant record KSZ-325Q"
    rows = [(f"w{i}", None, f"e{i}", plain * 3, 1, "s") for i in range(30)] + [("mis", "p", "e", "the enc0dcr is removed from the upper h0pper gate", 1, "s"), ("hy", "p", "e", "the enc-\noder is removed from the upper\nhopper gate", 1, "s")]
    rows += [(f"t{i}-{k}", "p", f"d{i}", f"{title}\nthe pump is polished\nand removed", k, "s") for i in range(6) for k in range(2)] + [("alone", "p", "x", f"{title}\nthe pump is polished\nand removed", 1, "s")]
    df = spark.createDataFrame(rows, CHUNK)
    found = lambda: sorted(tuple(r) for r in ocr.noise(df).collect())
    want, words = found(), ocr.dictionary(df)
    assert ("mis", "misread") in want and ("hy", "hyphenation") in want and ("alone", "header") in want
    monkeypatch.setattr(ocr, "MOST_WORDS", 2)
    monkeypatch.setattr(ocr, "MOST_FAMILIES", 0)
    few = ocr.dictionary(df)
    assert len(few) == 2 and {w: few.get(w) for w in words} == words and "naïve" in few and "encode" not in few and few.get("encode", 0) == 0
    assert found() == want


# 8 and 9 tokens


def test_encoding_is_the_tokenizers():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    e, rng = encode.Encoder(VOCABULARY, memo=50), random.Random(4)
    parts = ["the", " pump", "  ", "\n\n", "’s", "'ll", "½", "Ⅷ", "३", "é", "é", "हिन्दी", "模具", "👩‍🏭", "_", "--", "​", "\x1c", "<|endoftext|>", "X9", "\xa0", "\x85", "𝕏"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert e.encode(t) == own.encode_ordinary(t) and e.count(t) == len(e.encode(t))
    long = "ab" * 30_000 + "x" * 30_000
    assert e.encode(long) == own.encode_ordinary(long) and e.encode(None) == e.encode("") == []


def test_corpus_encoding(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    got = sorted((r.doc_id, r.ids) for r in encode.encode_corpus(docs).collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, [])] and len(got[0][1]) == 2


def test_plan_fits():
    rng = random.Random(6)
    for _ in range(200):
        cap = rng.choice([5, 12, 50, 512])
        h = {rng.randint(1, cap): rng.randint(1, 20) for _ in range(rng.randint(1, 30))}
        runs, n = pack.plan_runs(h, cap)
        load, seen = [0] * n, dict.fromkeys(h, 0)
        for s, rank, items, each, first in runs:
            assert rank == seen[s]
            seen[s] += items
            for i in range(items):
                load[first + i // each] += s
        assert seen == h and max(load) <= cap and min(load) > 0
        assert n <= 1.5 * -(-sum(s * k for s, k in h.items()) // cap) + 1


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 3, 7, 7, 7, 25, None])) for i in range(300)]
    got = pack.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), [("container_x", 10)]).collect()
    load: dict = {}
    for r in got:
        load[r.bin_no] = load.get(r.bin_no, 0) + r.n_tokens
    assert max(load.values()) <= 10 and {r.doc_id for r in got} == set(range(300)) and len({(r.doc_id, r.piece_no) for r in got}) == len(got)
    assert sum(load.values()) == sum(n or 0 for _, n in rows) and all(r.piece_no == 0 for r in got if (rows[r.doc_id][1] or 0) <= 10)
    assert pack.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int"), [("container_x", 10)]).count() == 0


def test_packing_of_many_and_large_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 1 << 19, (1 << 21) + 3, 1 << 20])) for i in range(60)]
    limits = [(f"container_{k:02}", (1 << 20) + k) for k in range(12)]
    got = pack.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), limits).collect()
    load: dict = {}
    for r in got:
        load[r.container, r.bin_no] = load.get((r.container, r.bin_no), 0) + r.n_tokens
    for name, cap in limits:
        own = [v for (c, _), v in load.items() if c == name]
        assert max(own) <= cap and sum(own) == sum(n for _, n in rows)


# 10 residue


def test_residue(spark):
    rows = {
        "placeholder": ["Unit {{unit}} was tested in ${site} by %AUTHOR% today.", "Dear [INSERT NAME],"],
        "filler": ["test, test, test, test, test", "Noctarum remodi itermis tremuit pontelum lorem. Sedrumque magrum vincala.", "Your text goes here.", "kqf asd eejlrrl akd sfrje"],
        "error_page": ["HTTP 404 The requested page was not found.", "pump | drain plug\n502 - Bad request! Please retry later.\ngasket | valve", "<html><body><h1>Error 503: Session expirée.</h1></body></html>", "Sitzung abgelaufen!"],
        "script_notice": ["Please enable JavaScript to view this manual.", "CHECKING YOUR BROWSER TO USE THE PORTAL.", "drain plug\nVeuillez activer JavaScript puis recharger.\nfeed pump"],
        None: [None, "", "  ", "VSG-354P", "drain plug | feed pump", "Error 404 on the controller means that drive 76 does not answer on the bus. The pump is cooled.", "In the label editor the field {{serial_no}} is replaced when label 879 is printed.", "JavaScript must be switched on in the panel browser before firmware 383 is loaded. Keep the pump dry."],
    }
    flat = [(i, t, k) for i, (t, k) in enumerate((t, k) for k, ts in rows.items() for t in ts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in flat], "doc_id bigint, text string")
    got = {r.doc_id: r.residue_type for r in residue.residue(docs, frozenset({"drain", "pump", "feed", "gasket", "valve", "plug"})).collect()}
    assert got == {i: k for i, _, k in flat if k}


def test_residue_of_joined_and_long_messages():
    tree = residue.Judge(frozenset({"capteur", "pompe", "pump", "drive"}))
    pages = [
        "Oops! This item has been moved or deleted - If this continues, tell the portal team.", "(429) Der Dienst ist derzeit nicht erreichbar - Bitte später erneut versuchen.", "THIS ITEM HAS BEEN MOVED OR DELETED - PLEASE RETRY LATER.",
        "The page that you are looking for was not found on this server.", "le capteur > la pompe\nAccès refusé!\nle capteur > la pompe", "Internal fault in the viewer. Please retry later.",
    ]
    assert [residue.classify_text(t, tree) for t in pages] == ["error_page"] * len(pages)
    assert residue.classify_text("Scripts are blocked by your settings - some content cannot be displayed.", tree) == "script_notice"
    real = ["Access denied messages at the pump are logged - see the badge reader state.", "Error 404 on the controller means that drive 76 does not answer on the bus - wait.", 'If the page shows "Service unavailable", wait two minutes and press the reset key of the panel.']
    assert [residue.classify_text(t, tree) for t in real] == [None] * len(real)


def test_slots_and_pages_of_other_makes():
    judge = residue.Judge(frozenset({"pump"}))
    kinds = {
        "Dear <CUSTOMER>, your order {order_no} from [DATE] has shipped.": "placeholder", "Dear [NAME], thank you for ordering on [DATE].": "placeholder", "502 Bad Gateway": "error_page", "This site is under maintenance": "error_page",
        "Webseite vorübergehend offline": "error_page", "Please wait while we verify that you are human.": "script_notice", "The pump is offline during the night and is restarted in the morning.": None, "<HTML><BODY><TABLE><TR><TD>The pump is cold.</TD></TR></TABLE></BODY></HTML>": None,
    }
    assert {t: residue.classify_text(t, judge) for t in kinds} == kinds


def test_templates_are_mined(spark):
    """A page unknown to the seeds is found by its support and spread; the same words spread over ordinary records are content."""
    page = lambda k: f"Your visit {k}-{k * 7} to the reading room could not be matched by our server and was put aside."
    plain = "The pump is cleaned. The valve is opened. The shaft is turned by hand. The cover is put on again. "
    real = lambda k: f"The server in hall {k} is restarted by the night crew."
    rows = [(i, page(i)) for i in range(6)] + [(10 + i, plain + real(i)) for i in range(6)] + [(20, real(3)), (21, real(4)), (22, real(5)), (30, "Once seen: the server was put aside by all of us.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    templates = [r for r in residue.mined(docs).collect() if r.few >= 3]
    assert any(r.few == 6 and r.template.count(None) == 0 and "#" in r.template for r in templates)
    got = {r.doc_id: r.residue_type for r in residue.residue(docs, frozenset({"pump", "valve"})).collect()}
    assert got == {i: "error_page" for i in range(6)}


def test_tree_learns_wildcards():
    t = residue.TemplateTree()
    for w in ("red", "green", "blue"):
        t.add(t.tokens(f"the {w} lamp of unit 7 is lit"), 1, 0)
    t.add(t.tokens("the lamp"), 1, 0)
    assert sorted(len(x) for _, x, _ in t.rows()) == [2, 8, 8, 8]  # the second token is a level of the tree
    same = residue.TemplateTree()
    for w in ("red", "green"):
        same.add(same.tokens(f"lamp of unit {w} is now lit"), 1, 0)
    assert [x for _, x, _ in same.rows()] == [["lamp", "of", "unit", None, "is", "now", "lit"]] and next(same.rows())[2] == [2, 0]


def test_found_queries(spark, sf):
    from lodestone import llm

    columns = {"p1_found": ["chunk_id", "boundary"], "p2_found": ["group_doc_id", "doc_id", "survivor_doc_id"], "p3_found": ["chunk_id", "pii_type"], "p4_found": ["chunk_id_a", "chunk_id_b"], "p5_found": ["chunk_id_a", "chunk_id_b"], "p6_found": ["chunk_id", "noise_type"], "p7_found": ["doc_id_a", "doc_id_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "residue_type"]}
    every = llm.queries()
    for name, names in columns.items():
        rows = [tuple(map(str, r)) for r in every[name](spark, sf).select(*names).collect()]
        assert len(rows) == len(set(rows)) and rows, name
