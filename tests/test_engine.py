"""The entry points end to end: uploads through all stages, resuming, cancelling, time limits, search and chat."""

import pytest
from pyspark.sql import functions as F

from lodestone import engine as E
from lodestone.operators import answer, embed, models, policy, search
from lodestone.operators.index import SearchIndex
from lodestone.sources import parse
from lodestone.store import Store

PAGE = b"""<html><body data-page="2"><h1>Pump &amp; valve</h1><p>The feed pump has a pressure of 12 bar.</p><ul><li>a</li><li> </li></ul>
<table data-bbox="0 1 2 3"><tr><th>part</th><th>bar</th></tr><tr><td>pump</td><td>12</td></tr></table>
<figure><img src="x.png"><figcaption>The feed pump</figcaption></figure><p data-page="1">Before all.</p></body></html>"""


def uploads(spark, *rows):
    return spark.createDataFrame(list(rows), "filename string, content binary")


@pytest.fixture(scope="module")
def filled(spark):
    e = E.Engine(spark)
    rows = [("a.html", PAGE), ("b.txt", b"The drain plug of the gearbox is at the bottom.\n\n- open it\fsecond page of the gearbox"), ("copy.html", PAGE), ("bad.bin", b"\x00\x01\x02\xff"), ("none.txt", None)]
    ids = {r.filename: r.document_id for r in e.upload(uploads(spark, *rows)).join(e.raw().select("document_id", "filename"), "document_id").collect()}
    out = {r.document_id: r for r in e.ingest(run="first").collect()}
    e.reindex()
    return e, ids, out


def test_states_after_ingestion(filled):
    e, ids, out = filled
    html = sorted([ids["a.html"], ids["copy.html"]])
    assert [out[i].status for i in html] == ["COMPLETED", "DUPLICATE"] and out[html[0]].progress_percent == 100
    assert out[ids["b.txt"]].status == "COMPLETED" and out[ids["bad.bin"]].status == out[ids["none.txt"]].status == "FAILED"
    assert out[ids["bad.bin"]].error_message == "kind not supported" and out[ids["none.txt"]].error_message == "missing"
    state = e.status(ids["b.txt"])
    assert state["status"] == "COMPLETED" and state["completed_at"] is not None
    with pytest.raises(ValueError):
        e.status("no id")
    with pytest.raises(KeyError):
        e.status("00000000-0000-4000-8000-000000000000")
    assert e.documents(E.Tenant(), "completed")["count"] == 2
    assert e.base_version(E.Tenant()) == 2 and e.base_version(E.Tenant("other")) == 1


def test_chunks_of_a_page(filled):
    e, ids, _ = filled
    rows = e.store.read("chunks", "chunk_id").collect()
    kinds = {(r.page_number, r.chunk_type, r.parent_id is None) for r in rows}
    assert {(1, "TEXT", True), (2, "TEXT", True), (2, "TEXT", False), (2, "TABLE", True), (2, "IMAGE", True)} <= kinds
    table = next(r for r in rows if r.chunk_type == "TABLE")
    assert table.content == "| part | bar |\n|---|---|\n| pump | 12 |" and table.metadata_map["domain_config_version"] == "1.0" and "parent_token_range" in table.metadata_map["chunking_rules"]
    nodes, edges = e.graph()
    assert nodes.where("label = 'Document'").count() == 2 and edges.where("type = 'HAS_SECTION'").count() >= 4


def test_search_and_chat(filled):
    e, _, _ = filled
    got = e.search("drain plug of the gearbox")
    assert got["results"][0]["content"].startswith("The drain plug") and got["strategy"] == "dense+bm25_rrf_rerank" and got["confidence"] == "HIGH"
    assert e.search("error of page2.section0")["strategy"].startswith("dense+bm25")
    assert e.search("   ")["results"] == []
    first = e.chat("drain plug of the gearbox")
    assert first.verification_status == "SUPPORTED" and first.citations and first.sources[0]["source_no"] == 1 and first.trace_id.startswith("tr_") and not first.cached
    again = e.chat("  Drain plug of the gearbox ")
    assert again.cached and again.answer == first.answer
    assert not e.chat("drain plug of the gearbox", E.Tenant(access_level="PUBLIC")).cached  # another level, another key
    alien = e.chat("drain plug", E.Tenant("other"))
    assert alien.answer == E.NOT_ENOUGH and alien.verification_status == "UNSUPPORTED" and alien.retries == 1
    with pytest.raises(ValueError):
        e.chat("x", top_k=51)


def test_policy_stops_a_question(filled, spark):
    e, _, _ = filled
    e.services.policy = lambda claims: {"allowed": False, "denied_reason": "closed"}
    try:
        with pytest.raises(E.AccessDenied, match="closed"):
            e.chat("drain plug")
    finally:
        e.services.policy = None


def test_a_failing_channel_is_empty(filled, monkeypatch):
    e, _, _ = filled
    monkeypatch.setattr(e.index, "dense", lambda *a: 1 / 0)
    assert e.search("drain plug of the gearbox")["results"]


def test_second_run_and_deletion(filled, spark):
    e, ids, _ = filled
    before = e.store.log("jobs").count()
    e.ingest(run="first")  # all stages are done: nothing is written
    assert e.store.log("jobs").count() == before
    e.upload(uploads(spark, ("again.html", PAGE), ("new.txt", b"The drain plug of the gearbox is at the bottom.\n\n- open it\fsecond page is another")))
    got = {r.status for r in e.ingest().collect()}
    assert got == {"DUPLICATE", "COMPLETED"}
    n = e.store.read("chunks", "chunk_id").count()
    e.delete(ids["b.txt"], "default")
    left = e.store.read("chunks", "chunk_id")
    assert left.count() < n and left.where(F.col("document_id") == ids["b.txt"]).isEmpty() and e.graph()[0].where(F.col("id") == ids["b.txt"]).isEmpty()
    e.store.compact("chunks", "chunk_id")
    assert e.store.read("chunks", "chunk_id").count() == e.store.log("chunks").count()


def test_cancelled_and_late(spark, monkeypatch):
    e = E.Engine(spark)
    job = e.upload(uploads(spark, ("a.txt", b"some text"), ("b.txt", b"other text"))).collect()
    e.cancel(job[0].job_id)
    out = {r.document_id: r.status for r in e.ingest().collect()}
    assert out == {job[1].document_id: "COMPLETED"} and e.status(job[0].document_id)["status"] == "CANCELLED"
    assert e.job(job[0].job_id)["status"] == "CANCELLED" and e.job("none") is None
    late = E.Engine(spark)
    late.upload(uploads(spark, ("a.txt", b"some text")))
    monkeypatch.setattr(late, "_stage_parse", lambda *a: __import__("time").sleep(12) or {})
    with pytest.raises(TimeoutError, match="parse"):
        late.ingest(seconds=8, run="slow")
    row = late.store.read("documents", "document_id").first()
    assert row.status == "FAILED" and "timed out" in row.error_message


def test_one_sink_down_is_partial(spark, monkeypatch):
    e = E.Engine(spark)
    e.upload(uploads(spark, ("a.txt", b"some text")))
    real = e.store.append
    monkeypatch.setattr(e.store, "append", lambda name, rows, gone=False: (_ for _ in ()).throw(OSError("down")) if name == "nodes" else real(name, rows, gone))
    row = e.ingest().first()
    assert (row.status, row.progress_percent) == ("PARTIAL", 95) and e.store.log("indexing_state").first().graph_status == "FAILED" and e.base_version(E.Tenant()) == 1


def test_quota_is_waited_for_and_stages_are_registered(spark, tmp_path):
    flag = tmp_path / "asked"

    def limited(texts):
        if not flag.exists():
            flag.write_text("x")
            raise models.QuotaError(0.1)
        return embed.feature_hashing(texts)

    e = E.Engine(spark, services=models.Services(embedder=limited))
    e.upload(uploads(spark, ("a.txt", b"some text to mail@korvix.io")))
    seen = []
    e.register("mark", lambda held, at: seen.append(held["chunks"].count()) or {}, 72, "METADATA", after="incremental")
    assert e.ingest().first().status == "COMPLETED" and seen and flag.exists()
    assert "WAITING_FOR_EMBEDDING_QUOTA" in {r.status for r in e.store.log("jobs").select("status").distinct().collect()}
    text, kinds = e.services.pii(F.col("content"))
    row = e.store.read("chunks", "chunk_id").select(text.alias("t"), kinds.alias("k")).first()
    assert row.t == "some text to [REDACTED_EMAIL]" and row.k == ["EMAIL"] and E.STRATEGIES["chunking"] == "hierarchical"


def test_files_by_document(spark, tmp_path):
    from lodestone.sources import export

    parsed = parse.parsed(spark.createDataFrame([("d1", b"a\nb\fc"), ("d2", b"x")], "document_id string, content binary"))
    export.save_processed(parsed, str(tmp_path / "p"))
    export.save_processed(parsed.where("document_id = 'd1'"), str(tmp_path / "p"))  # replaces that one alone
    assert {r.document_id: len(r.pages) for r in export.load_processed(spark, str(tmp_path / "p")).collect()} == {"d1": 2, "d2": 1}
    assert export.load_processed(spark, str(tmp_path / "p"), "d2").first().pages[0].text_blocks[0].text == "x"
    export.save_chunk_texts(spark.createDataFrame([("d1", "d1::p1", "two\nlines"), ("d1", "d1::p2", None)], "document_id string, chunk_id string, content string"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c" / "document_id=d1" / "chunk=d1__p1")).count() == 2
    assert export.exists(spark, str(tmp_path / "c")) and not export.exists(spark, str(tmp_path / "none"))


def test_store(spark):
    s = Store(spark)
    s.append("t", spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, keep string"))
    s.upsert("t", spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "k int, v string, keep string"), "k", ["v"])
    assert {tuple(r) for r in s.read("t", "k").select("k", "v", "keep").collect()} == {(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")}
    s.delete("t", "k", F.col("k") == 1)
    s.insert_missing("t", spark.createDataFrame([(2, "no", "no"), (4, "D", "W")], "k int, v string, keep string"), "k")
    assert {r.k: r.v for r in s.read("t", "k").collect()} == {2: "B", 3: "C", 4: "D"}
    s.put("c", spark.createDataFrame([("a", "1")], "key string, value string"), 60)
    s.put("c", spark.createDataFrame([("b", "2")], "key string, value string"), -1)
    assert s.get("c", "a") == "1" and s.get("c", "b") is None and s.get("none", "a") is None
    assert s.fetchval("SELECT :x + 1", x=2) == 3 and s.fetchrow("SELECT 1 AS a WHERE false") is None and len(s.fetch("SELECT explode(sequence(1, 3))")) == 3


def test_readers(spark):
    rows = [(1, b"<p>a</p>"), (2, b"plain\n\ntext\fmore"), (3, b"\xff\xfe"), (4, None)]
    got = {r.k: r for r in parse.parsed(spark.createDataFrame(rows, "k int, content binary"), key="k").collect()}
    assert got[1].parser == "primary" and got[2].parser == "fallback" and len(got[2].pages) == 2 and got[3].parser is None and "Unicode" in got[3].error
    assert [b.text for b in got[2].pages[0].text_blocks] == ["plain", "text"]
    kinds = spark.createDataFrame([(b"%PDF-1",), (b"\x89PNG\r\n\x1a\n1",), (b"<!DOCTYPE html><p>",), (b"words",), (b"\x00\x01",), (b"",), (None,)], "c binary").select(parse.sniffed(F.col("c"))).collect()
    assert [r[0] for r in kinds] == ["application/pdf", "image/png", "text/html", "text/plain", "application/octet-stream", "application/octet-stream", None]
    assert parse.boxed("1, 2 3;4") == [1, 2, 3, 4] and parse.boxed({"l": 0, "t": 1, "r": 2, "b": 3}) == [0, 1, 2, 3] and parse.boxed("1 2") == parse.boxed(None) == []
    assert parse.markdown([]) == ""


def test_saved_figure(tmp_path):
    assert parse.saved_figure(str(tmp_path / "f"), "a.png", b"x").endswith("a.png") and parse.saved_figure(str(tmp_path), "b.png", None) == ""


def test_retries_and_quota():
    waits, tries = [], []

    def failing(texts):
        tries.append(len(texts))
        if len(tries) < 3:
            raise OSError("down")
        return embed.feature_hashing(texts)

    e = models.BatchEmbedder(failing, size=2, sleep=waits.append)
    assert e(["a", "b", "c"]).shape == (3, embed.SIZE) and tries == [2, 2, 2, 1] and waits == [1.0, 2.0, 0.1]
    asked = []

    def limited(texts):
        asked.append(1)
        if len(asked) <= 5:
            raise RuntimeError("HTTP 429")
        return embed.feature_hashing(texts)

    said = []
    assert len(models.BatchEmbedder(limited, sleep=waits.append, on_quota=lambda: said.append(1))(["a"])) == 1 and said == [1] and 30.0 in waits
    with pytest.raises(ValueError):
        models.BatchEmbedder(lambda t: embed.feature_hashing(t)[:0], sleep=waits.append)(["a"])
    few = [{"content": "pump"}, {"content": "valve seat"}]
    assert models.reranked("valve", few, 1)[0]["content"] == "valve seat" and models.reranked("valve", few, 1, lambda q, t: 1 / 0, sleep=waits.append) == few[:1]
    look = models.analysed(lambda data: '{"functional_summary": "x"}', lambda path: b"" if path == "p" else 1 / 0, sleep=waits.append)
    assert look("p").startswith("{") and look("q") == "{}" and look(None) is None
    assert models.joined_regions(["a", "b"]) == "a b" and models.image_url("a.JPG", b"x") == "data:image/jpeg;base64,eA==" and models.image_url("a", b"x").startswith("data:image/png")
    one = [{"chunk_id": "c", "content": " ", "page_number": 1}]
    assert models.generated("q", []) == answer.NO_EVIDENCE and models.generated("q", one) == models.NOTHING_SAID and models.generated("q", one, lambda p: 1 / 0) == models.FAILED
    assert "[Source 1 - Chunk c - Page 1]" in models.generated("q", one, lambda p: p)


def test_policy_decisions(spark):
    levels = policy.levels_of
    assert policy.decide("RESTRICTED") == (True, levels("RESTRICTED"), None) and policy.decide("other")[1] == ["PUBLIC"]
    assert policy.decide("PUBLIC", lambda c: True)[1] == levels("INTERNAL") and policy.decide("RESTRICTED", lambda c: False)[:2] == (False, levels("RESTRICTED"))
    assert policy.decide("PUBLIC", lambda c: {}) == (False, levels("INTERNAL"), None) and policy.decide("PUBLIC", lambda c: 1 / 0) == (True, ["PUBLIC"], None)
    assert E.Tenant.from_headers({"X-Tenant-ID": "t", "x-access-level": "PUBLIC"}) == E.Tenant("t", access_level="PUBLIC")


def test_confidence_reasons():
    assert search.confidence_of(None) == ("LOW", 0.0, "No evidence retrieved") and search.confidence_of(0.5)[2] == "Moderate top evidence score (0.50)"


def test_index_gives_what_the_operators_give(spark, sf):
    from lodestone.plans import common, retrieval

    vectors, chunks, queries = retrieval._with_vectors(spark, sf)
    full = common.chunks_once(spark, sf, "content", "hierarchy_path", *retrieval.ACCESS)
    index = SearchIndex(spark, f"{Store(spark).root}/index").build(full, vectors)
    rows = lambda df: {tuple(r) for r in df.select("query_id", "chunk_id", "rank", "score").collect()}
    assert rows(index.dense(queries, 20)) == rows(search.dense(vectors, chunks, queries, 20))
    assert rows(index.bm25(queries, 20)) == rows(search.bm25(full.where("parent_id is not null"), queries, 20))
    assert rows(index.graph(queries)) == rows(search.graph(full, queries))
