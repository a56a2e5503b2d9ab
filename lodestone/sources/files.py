"""Files in a landing folder: read, checked, typed; what fails goes to quarantine with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_pdf, mime_of, squeeze, strip

MOST_BYTES = 100 * 1024 * 1024
#: Mean confidence from which the first reader of a picture is believed.
OCR_TRUST = 50.0


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, sha256, mime) of the files in a folder."""
    got = spark.read.format("binaryFile").load(folder)
    return got.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), mime_of(F.col("content")).alias("mime"))


def validated(files: DataFrame, kinds: tuple[str, ...] = ("application/pdf",)) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and those refused with ``reason``."""
    mime = mime_of(F.col("content"))
    reason = F.when(F.col("content").isNull(), "missing").when(F.col("length") > MOST_BYTES, "too large").when(~mime.isin(*kinds), "kind not supported")
    checked = files.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def text_pages(docs: DataFrame) -> DataFrame:
    """(document_id, filename, page_number, blocks) of plain texts: form feeds part pages, lines are blocks."""
    pages = docs.select("document_id", "filename", F.posexplode(F.split("text", "\f")).alias("p", "page"))
    blocks = F.filter(F.transform(F.split("page", "\n"), strip), lambda b: b != "")
    return pages.select("document_id", "filename", (F.col("p") + 1).alias("page_number"), blocks.alias("blocks"))


def _replaced(texts: Column, name: str, sign: str) -> Column:
    return F.transform(texts, lambda b: F.replace(b, F.lit(name), F.lit(sign)))


def html_blocks(html: Column) -> Column:
    """Texts of headings, paragraphs, list items and table cells in the order of the page."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(?:h[1-6]|p|li|td|th|pre)\b[^>]*>(.*?)</(?:h[1-6]|p|li|td|th|pre)>"), 1)
    plain = F.transform(found, lambda b: squeeze(F.regexp_replace(b, "<[^>]*>", " ")))
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = _replaced(plain, name, sign)
    return F.filter(plain, lambda b: b != "")


def mean_confidence(words: Column) -> Column:
    """Mean of the confidences that aren't negative; 0 if there is none."""
    good = F.filter(F.transform(words, lambda w: w["conf"]), lambda c: c >= 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, c: a + c) / F.size(good)).otherwise(0.0)


def trusted_reading(first: Column, confidence: Column, second: Column) -> Column:
    """The first reading if it isn't blank and sure enough, else the second, else an empty text."""
    return F.when((strip(first) != "") & (confidence >= OCR_TRUST), first).otherwise(F.coalesce(second, F.lit("")))


def is_accepted(content: Column, length: Column) -> Column:
    return is_pdf(content) & (length <= MOST_BYTES)
