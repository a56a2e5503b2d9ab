"""Queries on texts, chunks and duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, dedup, embed, metadata, models, tables
from ..session import shared_root
from ..sources import export, files, parse
from .common import CHUNKS_ONCE, chunks_once, kept, table

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = rf"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
SQUEEZE = rf"regexp_replace({STRIP}, '{WS}+', ' ', 'g')"
WORDS = rf"list_filter(regexp_split_to_array(%s, '{WS}+'), lambda w: w <> '')"
HASHED = f"SELECT doc_id, tenant_id, status, created_at, sha256(CAST({SQUEEZE % 'lower(text)'} AS VARCHAR)) AS h FROM documents WHERE text IS NOT NULL AND tenant_id IS NOT NULL"
TWIN = """WITH own AS (%s), fine AS (SELECT doc_id, tenant_id, h, row_number() OVER (PARTITION BY tenant_id, h ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS n FROM own WHERE status <> 'FAILED')
SELECT o.doc_id, f.doc_id AS canonical, o.h AS digest FROM own o JOIN fine f ON o.tenant_id = f.tenant_id AND o.h = f.h AND o.doc_id <> f.doc_id QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY f.n) = 1"""


def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("digest", T.content_hash(F.col("text")))
    return dedup.newest_twin(docs, "digest")


def file_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.newest_twin(table(spark, sf_dir, "documents").withColumnRenamed("sha256", "digest"), "digest")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("file_name", F.lit("unnamed")).alias("filename"), F.lit(1).alias("page_number"), chunking.line_blocks(F.col("text")).alias("blocks"))


PAGES = rf"""pages AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(file_name, 'unnamed') AS filename,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP % 'x'}), lambda x: x <> '') AS blocks FROM documents WHERE text IS NOT NULL)"""
PARENTS = rf"""{PAGES}, packed AS (SELECT document_id, filename, list_reduce(list_transform(blocks, lambda b: {{'done': CAST([] AS VARCHAR[]), 'open': [b], 'n': len({WORDS % 'b'})}}),
  lambda a, x: CASE WHEN a.n + x.n >= 768 THEN {{'done': list_append(a.done, array_to_string(list_concat(a.open, x.open), ' ')), 'open': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}}
  ELSE {{'done': a.done, 'open': list_concat(a.open, x.open), 'n': a.n + x.n}} END, {{'done': CAST([] AS VARCHAR[]), 'open': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}}) AS p FROM pages WHERE len(blocks) > 0),
whole AS (SELECT document_id, filename, CASE WHEN len(p.open) > 0 THEN list_append(p.done, array_to_string(p.open, ' ')) ELSE p.done END AS s FROM packed),
parents AS (SELECT document_id, filename, unnest(s) AS content, unnest(range(len(s))) AS i FROM whole),
named AS (SELECT document_id, document_id || '::p1::s' || i AS chunk_id, content, 'Section ' || (i + 1) AS section, filename || ' > Page 1 > Section ' || (i + 1) AS context_prefix, 'doc.page1.section' || i AS hierarchy_path FROM parents)"""


def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(pages(spark, sf_dir)).select("chunk_id", "content_hash", "section", "context_prefix", "hierarchy_path", T.word_count(F.col("content")).alias("n_words"))


def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.children(chunking.sections(pages(spark, sf_dir))).select("chunk_id", "parent_id", "content_hash", "context_prefix", "hierarchy_path")


def chunk_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in ("TEXT", "TABLE", "IMAGE", "DIAGRAM")], "chunk_type string")
    n = chunks_once(spark, sf_dir, "chunk_type").groupBy("chunk_type").agg(F.count("*").alias("n"))
    return kinds.join(n, "chunk_type", "left").select("chunk_type", F.coalesce("n", F.lit(0)).alias("n"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks_once(spark, sf_dir, "document_id", "page_number", "chunk_type", "parent_id")
    return c.groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"), F.count_if(F.col("chunk_type") == "TABLE").alias("tables"), F.count_if(F.col("chunk_type").isin("IMAGE", "DIAGRAM")).alias("figures"), F.count_if(F.col("parent_id").isNull()).alias("sections"))


def chunk_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("id").alias("document_id"), "batch_no")
    c = chunks_once(spark, sf_dir, "document_id", "tenant_id", "content_hash").join(docs, "document_id")
    return dedup.reusable(c.where("batch_no > 6"), c.where("batch_no <= 6")).select("chunk_id", "reusable")


def metadata_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks_once(spark, sf_dir, "access_classification", "metadata")
    m = metadata.enrich(c, metadata.load_config(None, "manufacturing"))
    own = F.col("metadata_map")
    return m.select("chunk_id", "industry_domain", "access_classification", own["entity_type_hints"].alias("entity_type_hints"), own["relation_type_hints"].alias("relation_type_hints"), own["chunking_rules"].alias("chunking_rules"), own["industry"].alias("industry"), own["domain_config_version"].alias("config_version"))


def minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of the representatives of equal signatures, and the members of each class."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return dedup.near_members(kept(dedup.minhash(docs, "doc_id", "text"), "signatures"), "doc_id").select("a", "b", F.round("agreement", 6).alias("agreement"), "kind")


_A, _B = dedup.coefficients()
_PERMS = ",".join(f"({k},{a},{b})" for k, (a, b) in enumerate(zip(_A.tolist(), _B.tolist())))
SIGS = f"""perms(k, a, b) AS (VALUES {_PERMS}), norm AS (SELECT doc_id, {SQUEEZE % 'lower(text)'} AS t FROM documents WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, CAST(i AS INTEGER), 3)) END) AS s FROM norm),
hashed AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) AS h FROM grams),
minima AS (SELECT doc_id, k, CAST(min((CAST(a AS HUGEINT) * h + b) % {dedup.PRIME}) AS BIGINT) AS m FROM hashed, perms GROUP BY ALL), sigs AS MATERIALIZED (SELECT doc_id, list(m ORDER BY k) AS sig FROM minima GROUP BY doc_id),
reps AS (SELECT sig, min(doc_id) AS rep FROM sigs GROUP BY sig), bands AS (SELECT rep, sig, b, list_slice(sig, b * 8 + 1, b * 8 + 8) AS h FROM reps, range(8) r(b)),
near AS (SELECT DISTINCT x.rep AS a, y.rep AS b, len(list_filter(list_zip(x.sig, y.sig), lambda z: z[1] = z[2])) / 64.0::DOUBLE AS agreement FROM bands x JOIN bands y ON x.b = y.b AND x.h = y.h AND x.rep < y.rep),
close AS (SELECT * FROM near WHERE agreement >= 0.8)"""


def near_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the later batches with the earlier ones that share a band of the signature."""
    docs = table(spark, sf_dir, "documents").where("text is not null and text <> '' and id is not null")
    sigs = kept(dedup.minhash(docs, "doc_id", "text").join(docs.select("doc_id", "batch_no"), "doc_id"), "signatures")
    return dedup.near_new(sigs.where("batch_no > 6"), sigs.where("batch_no <= 6"), "doc_id")


def version_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sigs = kept(dedup.minhash(docs.where("text is not null"), "doc_id", "text"), "signatures")
    return dedup.version_class(docs, table(spark, sf_dir, "chunks"), dedup.near_earlier(docs, sigs))


VERSION_SQL = f"""WITH {SIGS}, own AS (SELECT doc_id, id, tenant_id, batch_no, file_name, sha256, sha256(CAST({SQUEEZE % 'lower(text)'} AS VARCHAR)) AS ch FROM documents WHERE text IS NOT NULL),
f1 AS (SELECT tenant_id, sha256, min(batch_no) AS b FROM own WHERE sha256 IS NOT NULL GROUP BY ALL), f2 AS (SELECT tenant_id, ch, min(batch_no) AS b FROM own GROUP BY ALL),
parts AS (SELECT DISTINCT c.content_hash, o.tenant_id, o.batch_no, o.file_name, o.doc_id FROM chunks c JOIN own o ON c.document_id = o.id WHERE c.parent_id IS NOT NULL AND c.content_hash IS NOT NULL),
seen AS (SELECT tenant_id, content_hash, min(batch_no) AS b0 FROM parts GROUP BY ALL), nam AS (SELECT tenant_id, content_hash, file_name, min(batch_no) AS b1 FROM parts GROUP BY ALL),
sh AS (SELECT p.doc_id, bool_or(s.b0 < p.batch_no) AS part, bool_or(coalesce(n.b1 < p.batch_no, false)) AS same FROM parts p JOIN seen s ON p.tenant_id = s.tenant_id AND p.content_hash = s.content_hash
  LEFT JOIN nam n ON p.tenant_id = n.tenant_id AND p.content_hash = n.content_hash AND p.file_name = n.file_name GROUP BY ALL),
held AS (SELECT s.doc_id, r.rep, d.tenant_id, d.batch_no, d.file_name FROM sigs s JOIN reps r USING (sig) JOIN documents d USING (doc_id)), ways AS (SELECT a, b FROM close UNION ALL SELECT b, a FROM close UNION ALL SELECT rep, rep FROM reps),
nx AS (SELECT o.doc_id, bool_or(x.batch_no < o.batch_no) AS near, bool_or(x.batch_no < o.batch_no AND x.file_name = o.file_name) AS near_same FROM held o JOIN ways w ON o.rep = w.a JOIN held x ON x.rep = w.b AND x.tenant_id = o.tenant_id GROUP BY o.doc_id)
SELECT o.doc_id, CASE WHEN f1.b < o.batch_no THEN 'EXACT_DUP' WHEN f2.b < o.batch_no THEN 'CONTENT_DUP' WHEN sh.same OR nx.near_same THEN 'UPDATED_VERSION' WHEN nx.near THEN 'NEAR_DUP' WHEN sh.part THEN 'PARTIAL_CHANGE' ELSE 'NEW' END AS classification
FROM own o LEFT JOIN f1 ON o.tenant_id = f1.tenant_id AND o.sha256 = f1.sha256 LEFT JOIN f2 ON o.tenant_id = f2.tenant_id AND o.ch = f2.ch LEFT JOIN sh ON o.doc_id = sh.doc_id LEFT JOIN nx ON o.doc_id = nx.doc_id"""


def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([("probe_1", "call 555-123-4567 or a.b@c.io"), ("probe_2", "id 123-45-6789, none else"), ("probe_3", "nothing here")], "chunk_id string, content string")
    c = chunks_once(spark, sf_dir, "content").select("chunk_id", "content").unionByName(probe)
    return c.select("chunk_id", F.array_join(T.private_types(F.col("content")), ",").alias("types"), F.md5(T.redacted(F.col("content"))).alias("redacted_md5"))


_P = {n: p for n, p in T.PRIVATE}
PII_SQL = f"""WITH {CHUNKS_ONCE}, c AS (SELECT chunk_id, content FROM chunks_once UNION ALL VALUES ('probe_1','call 555-123-4567 or a.b@c.io'),('probe_2','id 123-45-6789, none else'),('probe_3','nothing here'))
SELECT chunk_id, array_to_string(list_filter([CASE WHEN regexp_matches(content, '{_P['EMAIL']}') THEN 'EMAIL' END, CASE WHEN regexp_matches(content, '{_P['PHONE']}') THEN 'PHONE' END, CASE WHEN regexp_matches(content, '{_P['SSN']}') THEN 'SSN' END], lambda x: x IS NOT NULL), ',') AS types,
md5(regexp_replace(regexp_replace(regexp_replace(content, '{_P['EMAIL']}', '[REDACTED_EMAIL]', 'g'), '{_P['PHONE']}', '[REDACTED_PHONE]', 'g'), '{_P['SSN']}', '[REDACTED_SSN]', 'g')) AS redacted_md5 FROM c"""


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return d.select("doc_id", T.word_count(t).alias("n_words"), T.token_estimate(t).alias("tokens_by_words"), T.token_estimate_chars(t).alias("tokens_by_chars"), T.chunk_hash(t).alias("text_hash"), F.coalesce(T.is_uuid(F.col("canonical_document_id")), F.lit(False)).alias("canonical_is_uuid"))


def embed_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "chunk_vectors").where("content_hash is not null")
    key = T.embedding_key(F.col("content_hash"), F.coalesce("embedding_model", F.lit("")), F.coalesce("embedding_model_version", F.lit("")))
    model = cache.groupBy("embedding_model", "embedding_model_version").count().where("embedding_model is not null and embedding_model_version is not null").orderBy(F.desc("count"), "embedding_model", "embedding_model_version").first()
    seen = embed.probe(chunks_once(spark, sf_dir, "tenant_id", "content", "content_hash"), cache.select(key.alias("cache_key"), F.lit(True).alias("vector")), model[0], model[1])
    return seen.groupBy("tenant_id").agg(F.count_if(F.col("vector").isNotNull()).alias("hits"), F.count_if(F.col("vector").isNull()).alias("misses"))


CACHED = f"""{CHUNKS_ONCE}, m AS (SELECT embedding_model, embedding_model_version FROM chunk_vectors WHERE content_hash IS NOT NULL AND embedding_model IS NOT NULL AND embedding_model_version IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, 1, 2 LIMIT 1),
k AS (SELECT DISTINCT sha256(content_hash || '::' || coalesce(embedding_model, '') || '::' || coalesce(embedding_model_version, '')) AS cache_key FROM chunk_vectors WHERE content_hash IS NOT NULL),
c AS (SELECT chunk_id, tenant_id, coalesce(content_hash, sha256(content)) AS content_hash, sha256(coalesce(content_hash, sha256(content)) || '::' || (SELECT embedding_model FROM m) || '::' || (SELECT embedding_model_version FROM m)) AS cache_key FROM chunks_once)"""
CACHE_SQL = f"WITH {CACHED} SELECT c.tenant_id, count(*) FILTER (k.cache_key IS NOT NULL) AS hits, count(*) FILTER (k.cache_key IS NULL) AS misses FROM c LEFT JOIN k ON c.cache_key = k.cache_key GROUP BY c.tenant_id"


def embed_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk gets a vector: the cached one, or one of the offline embedder, once per different text."""
    v = table(spark, sf_dir, "chunk_vectors").where("content_hash is not null")
    model = v.groupBy("embedding_model", "embedding_model_version").count().where("embedding_model is not null and embedding_model_version is not null").orderBy(F.desc("count"), "embedding_model", "embedding_model_version").first()
    key = T.embedding_key(F.col("content_hash"), F.coalesce("embedding_model", F.lit("")), F.coalesce("embedding_model_version", F.lit("")))
    cache = v.select(key.alias("cache_key"), F.coalesce("vector", F.array().cast("array<float>")).alias("vector"))
    out, new = embed.embedded(chunks_once(spark, sf_dir, "content", "content_hash"), cache, model[0], model[1])
    fresh = new.select("cache_key").withColumn("embedded", F.lit(True))
    own = out.join(fresh, "cache_key", "left")
    return own.select("chunk_id", "content_hash", F.coalesce("embedded", F.lit(False)).alias("embedded"), F.col("vector").isNotNull().alias("has_vector"))


def embed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure chunk by its image, those whose image can't be read by their text, all other chunks by their text."""
    c = chunks_once(spark, sf_dir, "content", "chunk_type", "page_number")
    path = F.when(F.col("chunk_type").isin("IMAGE", "DIAGRAM"), F.when(F.col("page_number") % 2 == 0, F.concat("chunk_id", F.lit(".jpg"))).otherwise(F.lit("missing.png")))
    rows = c.withColumns({"embedding_representation": F.when(F.col("chunk_type").isin("IMAGE", "DIAGRAM"), "image").otherwise("text"), "image_path": path})

    def read(path: str) -> bytes:
        if path == "missing.png":
            raise OSError(path)
        return path.encode()

    return embed.embed_mixed(rows, read=read).select("chunk_id", "way", F.size("vector").alias("n_dims"))


def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks_once(spark, sf_dir, "document_id", "page_number", "bounding_box")
    good = c.where("bounding_box is not null and size(bounding_box) >= 4")
    u = good.groupBy("document_id", "page_number").agg(chunking.box_union(F.collect_list("bounding_box")).alias("u"))  # the boxes of a page
    return u.select("document_id", "page_number", *[F.element_at("u", k + 1).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the first batches, with those of all batches merged in."""
    docs = table(spark, sf_dir, "documents").where("batch_no <= 6").select(F.col("id").alias("document_id"))
    cols = ("chunk_id", "document_id", "content_hash", "section", "context_prefix")
    every = chunks_once(spark, sf_dir, *cols).select(*cols)
    old = every.join(docs, "document_id", "left_semi").select("chunk_id", "document_id", F.lit("old").alias("content_hash"), F.lit("kept").alias("section"), F.lit("old").alias("context_prefix"))
    return tables.upsert(old, every, "chunk_id", ["content_hash", "context_prefix"])


MARKUP = r"(?is)<(?:h[1-6]|p|li|td|th|pre)\b[^>]*>"


def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = table(spark, sf_dir, "documents").where(F.col("text").rlike(MARKUP)).select(F.col("doc_id").cast("string").alias("page"), F.col("text").alias("html"))
    probe = spark.createDataFrame([("probe", "<html><h1>Pump &amp; valve</h1><p>One <b>bold</b> word</p><ul><li>a</li><li> </li></ul><table><tr><td>1</td></tr></table></html>")], "page string, html string")
    return pages_.unionByName(probe).select("page", F.posexplode(files.html_blocks(F.col("html"))).alias("block_no", "block"))


def vision_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, '```json\n{"functional_summary":"pump","components":["P1","V2"],"relationships":[],"spatial_layout":"left"}\n```'), (2, 'Here it is: {"functional_summary":"tank"} as asked'), (3, "no object"), (4, '{"components": [broken'), (5, None)]
    v = T.vision_json(F.coalesce("raw", F.lit("")))
    return spark.createDataFrame(rows, "figure int, raw string").select("figure", v.alias("v")).select("figure", "v.functional_summary", F.array_join("v.components", ",").alias("components"), F.size("v.relationships").alias("n_relationships"), "v.spatial_layout")


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the layout reader or, where it is no markup, the plain one: what each page holds."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    probe = spark.createDataFrame([(-1, bytearray(b"<p data-page='2'>b</p><p data-page='1'>a</p><table><tr><td>x</td></tr></table><img src='f.png'>")), (-2, bytearray(b"\xff\xfe")), (-3, None)], "doc_id bigint, content binary")
    got = parse.counts(parse.parsed(docs.unionByName(probe), key="doc_id"))
    size = lambda f: F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p[f]))
    return got.select("doc_id", "page_count", "table_count", "figure_count", F.when(F.col("pages").isNotNull(), size("text_blocks")).alias("block_count"), (F.col("parser") == "primary").alias("layout"))


def figure_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with what the model says of them: nothing without a path, an empty analysis where it fails."""
    rows = [(1, "a.png", "ok"), (2, None, "ok"), (3, "", "ok"), (4, "b.png", "down"), (5, "c.png", "prose")]
    said = {"ok": '```json\n{"functional_summary":"pump","components":["P1"]}\n```', "prose": "I see {\"functional_summary\": \"tank\"} there"}

    def look(data: bytes) -> str:
        return said[data.decode()]

    def run(path: str | None, way: str) -> str | None:
        return models.analysed(look, lambda _: way.encode(), sleep=lambda s: None)(path)

    figures = spark.createDataFrame(rows, "figure int, path string, way string")
    raw = F.udf(run, "string")("path", "way")  # stands for a call of a model
    v = T.vision_json(F.coalesce("raw", F.lit("")))
    return figures.withColumn("raw", raw).select("figure", F.col("raw").isNotNull().alias("analysed"), v["functional_summary"].alias("summary"), F.array_join(v["components"], ",").alias("components"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, children, tables and figures of all documents in one table, counted by kind."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    got = parse.parsed(docs.select(F.col("doc_id").cast("string").alias("document_id"), F.encode("text", "UTF-8").alias("content")))
    names = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.coalesce("file_name", F.lit("unnamed")).alias("filename"))
    pages_ = kept(parse.paged(got.where("error is null").join(names, "document_id")), "pages").withColumn("figures", F.transform("figures", lambda f: F.struct(f["image_path"].alias("image_path"), f["caption"].alias("caption"), F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("components"))))
    c = chunking.all_chunks(pages_)
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("parent_id").isNull()).alias("parents"), F.countDistinct("chunk_id").alias("ids"))


def processed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents parsed, written as JSON by document and read back: pages and blocks of each."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    # a few large folders: the tenant stands for the document, so that files do not become many
    got = parse.parsed(docs.select("doc_id", F.encode("text", "UTF-8").alias("content")), primary=parse.plain, key="doc_id").where("error is null")
    rows = got.select(F.concat(F.lit("bucket_"), F.pmod("doc_id", F.lit(16))).alias("document_id"), "pages")
    at = f"{shared_root(spark)}/lodestone/processed-{uuid.uuid4().hex}"
    export.save_processed(rows, at)
    back = export.load_processed(spark, at)
    size = F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p["text_blocks"]))
    return back.groupBy("document_id").agg(F.sum(F.size("pages")).alias("pages"), F.sum(size).alias("blocks"), F.count("*").alias("documents"))


def media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table and figure chunks of a page with every kind of them."""
    page = spark.sql("""SELECT 'd1' AS document_id, 'f.pdf' AS filename, 2 AS page_number,
      array(named_struct('markdown', '| a |', 'bbox', array(0D, 0D, 1D, 1D)), named_struct('markdown', '', 'bbox', array(0D)), named_struct('markdown', '| a |', 'bbox', array(0D))) AS tables,
      array(named_struct('image_path', 'x.png', 'caption', 'Pump', 'summary', cast(null as string), 'components', cast(array() as array<string>)),
            named_struct('image_path', '', 'caption', '', 'summary', 'A tank', 'components', array('T1', 'T2')),
            named_struct('image_path', 'y.png', 'caption', '', 'summary', cast(null as string), 'components', cast(array() as array<string>)),
            named_struct('image_path', '', 'caption', '', 'summary', cast(null as string), 'components', cast(array() as array<string>))) AS figures""")
    t = chunking.table_chunks(page).select("chunk_id", "content", "chunk_type", "hierarchy_path")
    return t.unionByName(chunking.figure_chunks(page).select("chunk_id", "content", "chunk_type", "hierarchy_path"))


MEDIA_SQL = """WITH m AS (SELECT * FROM (VALUES ('t','table_','| a |','TABLE'),('t','table_','','TABLE'),('t','table_','| a |','TABLE'),('f','figure_','Caption: Pump','IMAGE'),('f','figure_','Description: A tank' || chr(10) || 'Components: T1, T2','DIAGRAM'),('f','figure_','Figure from page 2','IMAGE')) v(k, w, content, chunk_type))
SELECT 'd1::p2::' || k || substr(sha256(content), 1, 12) AS chunk_id, content, chunk_type, 'doc.page2.' || w || substr(sha256(content), 1, 12) AS hierarchy_path FROM m"""


def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "good text", [90, 80, -1], "other"), (2, "poor", [20, 30], "second"), (3, "  ", [99], "third"), (4, "none sure", [], None)]
    d = spark.createDataFrame(rows, "page int, first string, conf array<int>, second string")
    c = files.mean_confidence(F.transform("conf", lambda x: F.struct(x.alias("conf"))))
    return d.select("page", F.round(c, 2).alias("confidence"), files.trusted_reading(F.col("first"), c, F.col("second")).alias("text"))


def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a.pdf", bytearray(b"%PDF-1.7 x"), 10), ("b.png", bytearray(b"\x89PNG"), 4), ("c.pdf", bytearray(b"%PDF"), 104857601), ("d.pdf", bytearray(b"%PDF"), 104857600), ("e.pdf", None, 0)]
    good, bad = files.validated(spark.createDataFrame(rows, "path string, content binary, length bigint"))
    return good.select("path", F.lit("").alias("reason")).unionByName(bad.select("path", "reason"))


QUERIES = {f.__name__: f for f in (content_hash_dups, file_hash_dups, parent_chunks, child_chunks, chunk_type_counts, page_counts, chunk_partition, metadata_enrich, minhash_near, near_candidates, version_classification, pii_redact, token_estimates, embed_cache_hits, embed_new, embed_images, box_unions, upsert_chunks, html_parse, parsed_pages, figure_vision, page_chunks, processed_pages, vision_json, media_chunks, ocr_gate, file_checks)}
# What the configuration of the industry says.
_ENTITIES = '["PhysicalComponent","SystemFaultCode","Procedure","MaintenanceTask","SafetyWarning","PartNumber","Assembly","Specification"]'
_RELATIONS = '["SUPPLIES_FLUID_TO","WIRED_TO","TRIGGERS","REQUIRES","REPLACES","MOUNTED_ON","CONNECTED_TO","PRECEDED_BY"]'
_RULES = '{"parent_token_range":[1024,2048],"child_token_range":[128,256],"table_as_single_chunk":true,"figure_min_caption_length":10}'
SQL = {
    "content_hash_dups": TWIN % HASHED,
    "file_hash_dups": TWIN % "SELECT doc_id, tenant_id, status, created_at, sha256 AS h FROM documents WHERE sha256 IS NOT NULL AND tenant_id IS NOT NULL",
    "parent_chunks": f"WITH {PARENTS} SELECT chunk_id, sha256(content) AS content_hash, section, context_prefix, hierarchy_path, CAST(len({WORDS % 'content'}) AS INTEGER) AS n_words FROM named",
    "child_chunks": f"""WITH {PARENTS}, w AS (SELECT *, {WORDS % 'content'} AS ws FROM named), ch AS (SELECT *, unnest(range(CAST(ceil(len(ws) / 144.0) AS BIGINT))) AS j FROM w),
      t AS (SELECT chunk_id, context_prefix, hierarchy_path, j, array_to_string(list_slice(ws, j * 144 + 1, j * 144 + 144), ' ') AS content FROM ch)
      SELECT chunk_id || '::c' || j AS chunk_id, chunk_id AS parent_id, sha256(content) AS content_hash, context_prefix || ' > Chunk ' || j AS context_prefix, hierarchy_path || '.child' || j AS hierarchy_path FROM t""",
    "chunk_type_counts": f"WITH {CHUNKS_ONCE} SELECT k AS chunk_type, count(chunk_id) AS n FROM (VALUES ('TEXT'),('TABLE'),('IMAGE'),('DIAGRAM')) v(k) LEFT JOIN chunks_once ON chunk_type = k GROUP BY k",
    "page_counts": f"WITH {CHUNKS_ONCE} SELECT document_id, count(DISTINCT page_number) AS pages, count(*) FILTER (chunk_type = 'TABLE') AS tables, count(*) FILTER (chunk_type IN ('IMAGE','DIAGRAM')) AS figures, count(*) FILTER (parent_id IS NULL) AS sections FROM chunks_once GROUP BY document_id",
    "chunk_partition": f"""WITH {CHUNKS_ONCE}, c AS (SELECT k.chunk_id, k.tenant_id, k.content_hash, d.batch_no FROM chunks_once k JOIN documents d ON k.document_id = d.id),
      h AS (SELECT DISTINCT tenant_id, content_hash FROM c WHERE batch_no <= 6 AND content_hash <> '') SELECT c.chunk_id, h.content_hash IS NOT NULL AS reusable FROM c LEFT JOIN h ON c.tenant_id = h.tenant_id AND c.content_hash = h.content_hash WHERE c.batch_no > 6""",
    "metadata_enrich": f"WITH {CHUNKS_ONCE} SELECT chunk_id, 'manufacturing' AS industry_domain, coalesce(access_classification, 'INTERNAL') AS access_classification, '{_ENTITIES}' AS entity_type_hints, '{_RELATIONS}' AS relation_type_hints, '{_RULES}' AS chunking_rules, json_extract_string(metadata, '$.industry') AS industry, '1.0' AS config_version FROM chunks_once",
    "minhash_near": f"WITH {SIGS} SELECT a, b, round(agreement, 6) AS agreement, 'near' AS kind FROM close UNION ALL SELECT rep, doc_id, 1.0, 'member' FROM sigs JOIN reps USING (sig) WHERE rep <> doc_id",
    "near_candidates": f"WITH {SIGS}, own AS (SELECT doc_id, batch_no, b, list_slice(sig, b * 8 + 1, b * 8 + 8) AS h FROM sigs JOIN documents d USING (doc_id), range(8) r(b) WHERE d.text <> '' AND d.id IS NOT NULL) SELECT DISTINCT x.doc_id AS \"new\", y.doc_id AS \"old\" FROM own x JOIN own y ON x.b = y.b AND x.h = y.h WHERE x.batch_no > 6 AND y.batch_no <= 6",
    "version_classification": VERSION_SQL,
    "pii_redact": PII_SQL,
    "token_estimates": f"""SELECT doc_id, CAST(len({WORDS % 'text'}) AS INTEGER) AS n_words, CAST(trunc(len({WORDS % 'text'}) / 0.75) AS INTEGER) AS tokens_by_words, CAST(floor(length(text) / 4) AS BIGINT) AS tokens_by_chars, sha256(text) AS text_hash,
      coalesce(regexp_matches(lower(canonical_document_id), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$'), false) AS canonical_is_uuid FROM documents WHERE text IS NOT NULL""",
    "embed_cache_hits": CACHE_SQL,
    "embed_new": f"WITH {CACHED} SELECT c.chunk_id, c.content_hash, k.cache_key IS NULL AS embedded, true AS has_vector FROM c LEFT JOIN k ON c.cache_key = k.cache_key",
    "embed_images": f"WITH {CHUNKS_ONCE} SELECT chunk_id, CASE WHEN chunk_type NOT IN ('IMAGE','DIAGRAM') OR chunk_type IS NULL THEN 'text' WHEN page_number % 2 = 0 THEN 'image' ELSE 'fallback' END AS way, 64 AS n_dims FROM chunks_once",
    "html_parse": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS page, text AS html FROM documents WHERE regexp_matches(text, '{MARKUP}') UNION ALL SELECT 'probe', '<html><h1>Pump &amp; valve</h1><p>One <b>bold</b> word</p><ul><li>a</li><li> </li></ul><table><tr><td>1</td></tr></table></html>'),
      b AS (SELECT page, list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|td|th|pre)\\b[^>]*>(.*?)</(?:h[1-6]|p|li|td|th|pre)>', 1), lambda x: {SQUEEZE % "regexp_replace(x, '<[^>]*>', ' ', 'g')"}), lambda x: x <> '') AS l FROM d),
      u AS (SELECT page, unnest(l) AS x, unnest(range(len(l))) AS n FROM b)
      SELECT page, CAST(n AS INTEGER) AS block_no, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS block FROM u""",
    "processed_pages": rf"""WITH d AS (SELECT 'bucket_' || (doc_id % 16) AS document_id, CAST(1 + length(text) - length(replace(text, chr(12), '')) AS BIGINT) AS p, len(list_filter(regexp_split_to_array(text, '[\n\f]'), lambda b: {STRIP % 'b'} <> '')) AS n FROM documents WHERE text IS NOT NULL)
      SELECT document_id, sum(p) AS pages, sum(n) AS blocks, count(*) AS documents FROM d GROUP BY document_id""",
    "figure_vision": "SELECT * FROM (VALUES (1,true,'pump','P1'),(2,false,'',''),(3,false,'',''),(4,true,'',''),(5,true,'tank','')) v(figure, analysed, summary, components)",
    "box_unions": f"WITH {CHUNKS_ONCE} SELECT document_id, page_number, min(bounding_box[1]) AS x0, min(bounding_box[2]) AS y0, max(bounding_box[3]) AS x1, max(bounding_box[4]) AS y1 FROM chunks_once WHERE len(bounding_box) >= 4 GROUP BY document_id, page_number",
    "upsert_chunks": f"WITH {CHUNKS_ONCE}, old AS (SELECT id FROM documents WHERE batch_no <= 6) SELECT chunk_id, document_id, content_hash, CASE WHEN document_id IN (SELECT id FROM old) THEN 'kept' ELSE section END AS section, context_prefix FROM chunks_once",
    "media_chunks": MEDIA_SQL,
    "vision_json": "SELECT * FROM (VALUES (1,'pump','P1,V2',0,'left'),(2,'tank','',0,''),(3,'','',0,''),(4,'','',0,''),(5,'','',0,'')) v(figure, functional_summary, components, n_relationships, spatial_layout)",
    "ocr_gate": "SELECT * FROM (VALUES (1, 85.0::DOUBLE, 'good text'),(2, 25.0, 'second'),(3, 99.0, 'third'),(4, 0.0, '')) v(page, confidence, text)",
    "file_checks": "SELECT * FROM (VALUES ('a.pdf',''),('b.png','kind not supported'),('c.pdf','too large'),('d.pdf',''),('e.pdf','missing')) v(path, reason)",
}
