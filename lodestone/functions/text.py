"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelled out since regular expression dialects differ.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}++|{SPACE}++$", "")


def squeeze(text: Column) -> Column:
    """Trimmed, inner runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, f"{SPACE}++", " "))


def words(text: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    return (word_count(text) / 0.75).cast("int")


def token_estimate_chars(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def chunk_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(text: Column) -> Column:
    """Case and white space do not count."""
    return F.sha2(squeeze(F.lower(text)), 256)


def search_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def snippet(text: Column, size: int = 150) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def any_in(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


# The key words of each intent, in the order of their precedence.
INTENTS = (
    ("VISUAL", ("diagram", "figure", "schematic", "drawing", "image", "photo")),
    ("RELATIONSHIP", ("connected to", "wired to", "relationship", "replaces", "depends on")),
    ("PROCEDURAL", ("how to", "procedure", "steps", "instructions", "maintenance", "repair")),
    ("TECHNICAL", ("fault", "error", "code", "part #")),
)
# A term with a number, and what counts as an entity.
TECHNICAL_TERM = r"\b[a-z0-9]+-[0-9]+\b"
ENTITY = r"\b[A-Z0-9]{2,10}-[0-9]{2,6}\b|\b[EFP]\d{3,5}\b"


def intent(clean: Column) -> Column:
    low, out = F.lower(clean), None
    for name, needles in INTENTS:
        test = any_in(low, list(needles))
        if name == "TECHNICAL":
            test = test | low.rlike(TECHNICAL_TERM)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("FACTUAL")


def entities(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(ENTITY), 0)


# The patterns of personal data in the order in which they are replaced.
PRIVATE = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
)


def private_types(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in PRIVATE]))


def redacted(text: Column) -> Column:
    for name, pattern in PRIVATE:
        text = F.regexp_replace(text, pattern, f"[REDACTED_{name}]")
    return text


def embedding_key(digest: Column, model: Column, version: Column) -> Column:
    return F.sha2(F.concat(digest, F.lit("::"), model, F.lit("::"), version), 256)


def security_key(tenant: Column, assistant: Column, kb: Column, version: Column, level: Column, query: Column, prefix: str = "query_res") -> Column:
    """A cache key that no other tenant, base version or access level shares."""
    digest = F.substring(F.sha2(strip(F.lower(query)), 256), 1, 16)
    return F.sha2(F.concat(F.lit(f"{prefix}::"), tenant, F.lit("::"), assistant, F.lit("::"), kb, F.lit("::v"), version.cast("string"), F.lit("::"), level, F.lit("::"), digest), 256)


def is_uuid(col: Column) -> Column:
    return F.lower(col).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def mime_of(content: Column) -> Column:
    return F.when(is_pdf(content), "application/pdf").otherwise("application/octet-stream")


def data_url(path: Column, content: Column) -> Column:
    """Image bytes as a data URL; the kind follows the file name."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "webp", "image/webp").when(ext == "gif", "image/gif").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


VISION = "functional_summary string, components array<string>, relationships array<struct<`from`:string,`to`:string,type:string>>, spatial_layout string"


def vision_json(raw: Column) -> Column:
    """The object between the first and the last brace; an empty analysis where there is none or it is broken."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, VISION, {"mode": "PERMISSIVE"})
    text = lambda c: F.coalesce(got[c], F.lit(""))
    return F.struct(
        text("functional_summary").alias("functional_summary"),
        F.coalesce(got["components"], F.array().cast("array<string>")).alias("components"),
        F.coalesce(got["relationships"], F.array().cast("array<struct<`from`:string,`to`:string,type:string>>")).alias("relationships"),
        text("spatial_layout").alias("spatial_layout"),
    )
