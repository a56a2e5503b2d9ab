"""Documents into pages of text blocks, tables and figures: a layout reader with a plain-text reader behind it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

PAGES = (
    "array<struct<page_num:int,text_blocks:array<struct<text:string,bbox:array<double>>>,"
    "tables:array<struct<markdown:string,bbox:array<double>>>,figures:array<struct<image_path:string,bbox:array<double>,caption:string>>>>"
)
Pages = list[dict]
Parser = Callable[[bytes], Pages]
#: What the first bytes say of a file.
MAGIC = ((b"%PDF", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"PK\x03\x04", "application/zip"))


def sniffed(content: Column) -> Column:
    """The kind of a file by its content: known first bytes, markup, readable text; else octet-stream."""
    out = None
    for sign, kind in MAGIC:
        test = F.substring(content, 1, len(sign)) == F.lit(sign)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    text = F.when(F.is_valid_utf8(content.cast("string")), F.lower(F.substring(content.cast("string"), 1, 512)))
    out = out.when((F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WEBP")), "image/webp")
    out = out.when(text.rlike(r"^\s*(<!doctype html|<html)"), "text/html").when((F.length(content) > 0) & text.isNotNull() & ~text.rlike(r"\x00"), "text/plain")
    return F.when(content.isNotNull(), out.otherwise("application/octet-stream"))


def boxed(box: object) -> list[float]:
    """Left, top, right and bottom of a box however it is given; empty if that fails."""
    try:
        if isinstance(box, str):
            box = re.split(r"[\s,;]+", box.strip())
        if isinstance(box, dict):
            box = [box[k] for k in ("l", "t", "r", "b")]
        got = [float(x) for x in box][:4]  # type: ignore[union-attr]
        return got if len(got) == 4 else []
    except (TypeError, ValueError, KeyError):
        return []


class _Layout(HTMLParser):
    """Headings, paragraphs, list items, tables and pictures of a marked-up page, in order."""

    BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li pre figcaption".split())

    def __init__(self) -> None:
        super().__init__()
        self.pages: dict[int, dict] = {}
        self.page, self.words, self.box = 1, None, []
        self.rows: list[list[str]] | None = None
        self.figure: dict | None = None
        self.tags = 0

    def at(self) -> dict:
        return self.pages.setdefault(self.page, {"page_num": self.page, "text_blocks": [], "tables": [], "figures": []})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        self.tags += 1
        if own.get("data-page", "").isdigit():
            self.page = int(own["data-page"])
        if tag == "table":
            self.rows, self.box = [], boxed(own.get("data-bbox"))
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.words = []
        elif tag == "figure":
            self.figure = {"image_path": "", "bbox": boxed(own.get("data-bbox")), "caption": ""}
        elif tag == "img":
            one = {"image_path": own.get("src") or "", "bbox": boxed(own.get("data-bbox")), "caption": own.get("alt") or ""}
            if self.figure is not None:
                self.figure |= {k: v for k, v in one.items() if v}
            else:
                self.at()["figures"].append(one)
        elif tag in self.BLOCKS and self.rows is None:
            self.words, self.box = [], boxed(own.get("data-bbox"))

    def handle_data(self, data: str) -> None:
        if self.words is not None:
            self.words.append(data)

    def handle_endtag(self, tag: str) -> None:
        text = " ".join("".join(self.words or ()).split())
        if tag == "table" and self.rows is not None:
            self.at()["tables"].append({"markdown": markdown(self.rows), "bbox": self.box})
            self.rows = self.words = None
        elif tag in ("td", "th") and self.rows is not None and self.words is not None:
            (self.rows or [[]])[-1].append(text) if self.rows else self.rows.append([text])
            self.words = None
        elif tag == "figcaption" and self.figure is not None:
            self.figure["caption"], self.words = text, None
        elif tag == "figure" and self.figure is not None:
            self.at()["figures"].append(self.figure)
            self.figure = None
        elif tag in self.BLOCKS and self.words is not None:
            if text:
                self.at()["text_blocks"].append({"text": text, "bbox": self.box})
            self.words = None


def markdown(rows: list[list[str]]) -> str:
    """A table as lines of cells, the first line as its head."""
    full = [r for r in rows if r]
    if not full:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(full[0]), "|" + "---|" * len(full[0]), *map(line, full[1:])])


def layout(content: bytes) -> Pages:
    """Pages of marked-up text, by number; page 1 where none is said. ValueError if it is no markup."""
    p = _Layout()
    p.feed(content.decode("utf-8"))
    p.close()
    if not p.tags:
        raise ValueError("no markup")
    return [p.pages[k] for k in sorted(p.pages)]


def plain(content: bytes) -> Pages:
    """Pages of plain text: form feeds part them, lines that are not blank are blocks; of PDF files by a reader if there is one."""
    if content.startswith(b"%PDF"):
        import fitz  # type: ignore[import-not-found]

        texts = [page.get_text() for page in fitz.open(stream=content, filetype="pdf")]
    else:
        texts = content.decode("utf-8").split("\f")
    return [{"page_num": k, "text_blocks": [{"text": b.strip(), "bbox": []} for b in t.split("\n") if b.strip()], "tables": [], "figures": []} for k, t in enumerate(texts, 1)]


def parsed(files: DataFrame, primary: Parser = layout, fallback: Parser = plain, key: str = "document_id") -> DataFrame:
    """(key, pages, parser, error): each file by the first reader, on any failure by the second; both failing gives the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([
            ("page_num", pa.int32()), ("text_blocks", pa.list_(pa.struct([("text", pa.string()), ("bbox", pa.list_(pa.float64()))]))),
            ("tables", pa.list_(pa.struct([("markdown", pa.string()), ("bbox", pa.list_(pa.float64()))]))),
            ("figures", pa.list_(pa.struct([("image_path", pa.string()), ("bbox", pa.list_(pa.float64())), ("caption", pa.string())]))),
        ]))
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                pages, by, errors = [], [], []
                for content in part.column(1).to_pylist():
                    got, who, error = None, None, None
                    for name, parser in (("primary", primary), ("fallback", fallback)):
                        try:
                            got, who, error = parser(content or b""), name, None
                            break
                        except Exception as e:
                            error = f"{type(e).__name__}: {e}"[:2000]
                    pages.append(got), by.append(who), errors.append(error)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, kind), pa.array(by, pa.string()), pa.array(errors, pa.string())], [key, "pages", "parser", "error"])

    return files.select(key, "content").mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, pages {PAGES}, parser string, error string")


def paged(docs: DataFrame) -> DataFrame:
    """One row a page of ``docs`` (document_id, filename, pages): page_number, blocks, tables, figures; in the order of page_num."""
    cut = docs.select("document_id", "filename", F.explode(F.array_sort("pages")).alias("p"))
    blocks = F.filter(F.transform("p.text_blocks", lambda b: strip(b["text"])), lambda t: t != "")
    return cut.select("document_id", "filename", F.col("p.page_num").alias("page_number"), blocks.alias("blocks"), F.transform("p.text_blocks", lambda b: b["bbox"]).alias("boxes"), F.col("p.tables").alias("tables"), F.col("p.figures").alias("figures"))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the numbers of pages, tables and figures."""
    total = lambda f: F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p[f]))
    return docs.withColumns({"page_count": F.size("pages"), "table_count": total("tables"), "figure_count": total("figures")})


def saved_figure(folder: str, name: str, data: bytes | None) -> str:
    """Write a figure's image and give its path; an empty text if that fails."""
    try:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, os.path.basename(name))
        with open(path, "wb") as f:
            f.write(data)  # type: ignore[arg-type]
        return path
    except (OSError, TypeError):
        return ""
