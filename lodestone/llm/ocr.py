"""Problem 6: noise in text from scanned pages.

Lines are labelled by a hidden Markov model with the states body, break (a body line that ends inside a word), table,
header, page number and gap. It sees raw features of the layout: length, share of digits, case, how the line ends, its place
among the lines, whether it holds nothing but a number, and whether its document repeats it over its pages; a state's
emission is the product of its distributions of these. The prior is re-estimated by Viterbi training on a bounded sample
(``SAMPLE`` chunks, those whose hash is least), which weighs up to half as much as the prior. Headers and page numbers are
the lines so labelled; hyphenation is a line labelled break whose word a dictionary of the corpus joins with the next body
line; paragraphs are put together from body lines. Misread words are no property of a line: a word is misread if putting back
one or two characters of like shape gives a word that is far more frequent.

What a document repeats is a title-like line that its pages show twice or more, compared after folding characters of like
shape; title families (the words before the code) that several documents share tell titles that stand alone. Words and
families count by absolute support over all chunks, sections and tables included, at any number of them: the ``MOST_WORDS``
most frequent words and the ``MOST_FAMILIES`` most frequent families are held in memory, all others are looked up in a file
sorted by hash, which every worker has and maps.

Defined cases: null and empty contents have no noise; a chunk stored twice counts once; null pages come last.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

_DICT_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"[^\s.,;:!?()\"“”«»<>\[\]]+")
_HYPHEN = re.compile(r"([^\W\d_][\w@+]*)([-‐¬\xad])\s*$")
_MARKS = frozenset("-‐¬\xad")
_DIGIT = re.compile(r"\d")
_START = re.compile(r"\s*([^\W\d_][\w@+]*)")
_PAGE = re.compile(r"^\s*(?:(?:page|seite|página|pagina|pág|pag|blatt|folio|hoja|p|s)\b\.?\s*\d{1,5}(?:\s*(?:of|von|de|sur|/)\s*\d{1,5})?|[-–—·•~]\s*\d{1,5}\s*[-–—·•~]|[\[(]\s*\d{1,5}\s*[\])]|\d{1,5}\s*/\s*\d{1,5}|\d{1,5}\s+(?:of|von|de|sur)\s+\d{1,5})\s*$", re.I)
_NUMBER = re.compile(r"^\s*\d{1,5}\s*$")
_CODE = re.compile(r"\b(?:[A-Z]{1,4}-?\d{2,5}[A-Z]?(?:/\d+)?|\d{1,3}-[A-Z]\d+)")
_LEAD = re.compile(r"^\s*(?:\d{1,5}\s*\||[-–—]+)\s*|\s*[-–—]+\s*$|\s{2,}\d{1,5}\s*$|\s*\|\s*\d{1,5}\s*$")

# What is read, and what stood on the page.
SHAPES = (("c", "e"), ("@", "a"), ("+", "t"), ("l", "i"), ("0", "o"), ("0", "ó"), ("1", "l"), ("1", "i"), ("5", "s"), ("b", "h"), ("9", "g"), ("ri", "n"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("o", "a"), ("8", "b"), ("vv", "w"), ("|", "l"), ("$", "s"), ("€", "e"))
_FOLD = str.maketrans("@0o15+cb9|ló", "aaaistehgiia")
#: A misread word must be this much rarer than the word it stands for.
RARER = 20
STATES = ("body", "break", "table", "header", "page", "gap")
BODY, BREAK, TABLE, HEADER, PAGE, GAP = range(6)
LEAST_COUNT, MOST_WORDS, MOST_FAMILIES = 5, 2_000_000, 100_000
SAMPLE = 2000
LONGEST_TITLE = 90


def fold(line: str) -> str:
    """A line without decoration and page number, characters of like shape made equal, letters and digits alone."""
    bare = line
    for _ in range(2):
        bare = _LEAD.sub("", bare)
    low = bare.lower().replace("rn", "m").replace("ri", "n").replace("ii", "u").translate(_FOLD)
    return "".join(c for c in low if c.isalnum())


def family(line: str) -> str | None:
    """The folded words before the code of a title-like line."""
    bare = line
    for _ in range(2):
        bare = _LEAD.sub("", bare)
    m = _CODE.search(bare.upper())
    return fold(bare[: m.start()]) or None if m else None


def title_like(line: str) -> bool:
    s = line.strip()
    return 8 <= len(s) <= 90 and s[-1] not in ".,;:-‐¬\xad" and not s[0].islower() and any(c.isdigit() for c in s) and 2 <= len(s.split()) <= 12 and _CODE.search(s.upper()) is not None


class LineModel:
    """Hidden Markov model of the lines of a page over features of their layout."""

    #: Pseudo-counts; rows are states. Transitions start from the last row.
    TRANSITION = np.array([
        [800, 80, 25, 45, 40, 10], [900, 50, 5, 25, 18, 2], [180, 10, 780, 10, 15, 5], [820, 80, 10, 5, 75, 10], [700, 80, 10, 190, 10, 10], [800, 80, 30, 60, 25, 5], [740, 80, 30, 120, 25, 5],
    ], float)
    #: Of each feature the weights of its values in each state, in thousandths.
    EMISSION = {
        # nothing known, a known family of titles, a title that the document repeats
        "repeated": [[999, 0.8, 0.2], [999.8, 0.1, 0.1], [985, 10, 5], [2, 300, 700], [995, 4, 1], [999, 0.5, 0.5]],
        # other text, a bare number, a number with the signs of a page number
        "number": [[997, 2, 1], [999.8, 0.1, 0.1], [100, 895, 5], [990, 5, 5], [5, 165, 830], [998, 1, 1]],
        # blank, up to 12, 40, 90 characters, more
        "length": [[1, 60, 240, 500, 199], [0.1, 20, 200, 600, 179.9], [1, 700, 200, 90, 9], [0.1, 20, 600, 375, 4.9], [0.1, 900, 95, 4.9, 0.1], [995, 2, 1, 1, 1]],
        # no digits, up to a fifth, up to half of the characters, more
        "digits": [[600, 370, 25, 5], [600, 390, 9, 1], [150, 300, 300, 250], [10, 500, 450, 40], [1, 30, 270, 699], [997, 1, 1, 1]],
        # first letter small, large, all letters large, no letters
        "case": [[480, 500, 15, 5], [500, 490, 9, 1], [150, 450, 150, 250], [2, 640, 353, 5], [100, 300, 5, 595], [1, 1, 1, 997]],
        # end of a sentence, a hyphen, anything else
        "end": [[300, 20, 680], [1, 990, 9], [50, 5, 945], [3, 60, 937], [50, 100, 850], [1, 1, 998]],
        # alone, first, between, last
        "place": [[250, 250, 250, 250], [1, 330, 659, 10], [100, 200, 400, 300], [150, 450, 350, 50], [50, 150, 500, 300], [50, 150, 500, 300]],
    }
    #: What the sample may weigh against the prior.
    WEIGHT = 0.5

    def __init__(self) -> None:
        self.fit([])

    def fit(self, pages: list[list[tuple[int, ...]]], rounds: int = 3) -> LineModel:
        """Re-estimate from sequences of features by Viterbi training around the pseudo-counts."""
        share = lambda x: x / x.sum(axis=1, keepdims=True)
        prior_t, prior_e = share(self.TRANSITION), [share(np.array(e, float)) for e in self.EMISSION.values()]
        self._take(prior_t, prior_e)
        for _ in range(rounds if pages else 0):
            ct, ce = np.zeros_like(prior_t), [np.zeros_like(e) for e in prior_e]
            for seq in pages:
                before = len(STATES)
                for s, y in zip(self.decode(seq), seq):
                    ct[before, s] += 1
                    before = s
                    for e, v in zip(ce, y):
                        e[s, v] += 1

            def mixed(prior: np.ndarray, count: np.ndarray) -> np.ndarray:
                # a state that the sample hardly shows keeps its prior
                n = count.sum(axis=1, keepdims=True)
                w = self.WEIGHT * n / (n + 200)
                return (1 - w) * prior + w * count / np.maximum(1, n)

            self._take(mixed(prior_t, ct), [mixed(p, c) for p, c in zip(prior_e, ce)])
        return self

    def _take(self, t: np.ndarray, e: list[np.ndarray]) -> None:
        self.t = np.log(t)
        self.e = [np.log(np.maximum(x, 1e-7)) for x in e]
        self.rows = self.t[:-1].T.copy()
        self.memo: dict[tuple[int, ...], np.ndarray] = {}

    def emission(self, y: tuple[int, ...]) -> np.ndarray:
        got = self.memo.get(y)
        if got is None:
            got = self.memo[y] = sum(e[:, v] for e, v in zip(self.e, y))
        return got

    def decode(self, seq: list[tuple[int, ...]]) -> list[int]:
        score, back = self.t[-1] + self.emission(seq[0]), []
        for y in seq[1:]:
            way = self.rows + score
            b = way.argmax(axis=1)
            back.append(b)
            score = way[_ROW, b] + self.emission(y)
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


_ROW = np.arange(len(STATES))


class _Verdicts(dict):
    """Whether a token as written is misread; emptied at half a million entries."""

    def __init__(self, test) -> None:
        self.test = test

    def __missing__(self, token: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        got = self[token] = token != token.upper() and self.test(token.lower()) is not None
        return got


class Words(dict):
    """Counts of words: the most frequent ones here, the rest in the file ``rest`` (hashes in order, then counts)."""

    def __init__(self, top: dict[str, int], rest: str, longest: int) -> None:
        super().__init__(top)
        self.rest, self.longest, self.table = rest, longest, None

    def __reduce__(self) -> tuple:
        return Words, (dict(self), self.rest, self.longest)

    def get(self, word: str, default: int | None = None) -> int | None:
        got = super().get(word)
        if got is not None:
            return got
        if self.table is None:
            self.table = np.memmap(SparkFiles.get(self.rest), np.int64, "r").reshape(2, -1)
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        h = h - 2**64 if h >= 2**63 else h
        at = int(np.searchsorted(self.table[0], np.int64(h)))
        return int(self.table[1, at]) if at < self.table.shape[1] and self.table[0, at] == h else default

    def __missing__(self, word: str) -> int:
        got = self.get(word)
        if got is None:
            raise KeyError(word)
        return got

    def __contains__(self, word: object) -> bool:
        return self.get(word) is not None


class Reader:
    """Labels and repairs the texts of one worker."""

    def __init__(self, words: dict[str, int], families: frozenset[str] | dict[str, int], model: LineModel) -> None:
        self.words, self.families, self.model = words, families, model
        self.longest = words.longest if isinstance(words, Words) else max(map(len, words), default=0)
        self.memo: dict[str, str | None] = {}
        self.misread = _Verdicts(self.meant).__getitem__

    def features(self, line: str, place: int, titles: frozenset[str]) -> tuple[int, ...]:
        """The features of a line in the order of the model's emissions."""
        n = len(line)
        bare = line.strip()
        if not bare:
            return 0, 0, 0, 0, 3, 2, place
        repeated = 0
        if n <= LONGEST_TITLE + 30:  # a title with its decoration
            if titles and fold(line) in titles:
                repeated = 2
            elif title_like(line) and (f := family(line)) and f in self.families:
                repeated = 1
        digits = sum(map(line.count, "0123456789"))
        number = 0
        if digits and n <= 60:
            number = 1 if _NUMBER.match(line) else 2 if _PAGE.match(line) else 0
        share = digits / len(bare)
        case = 3 if bare.lower() == bare.upper() else 2 if bare == bare.upper() else 0 if bare[0].islower() else 1
        end = 1 if line[-1:] in _MARKS or line[-2:-1] in _MARKS else 0 if bare[-1] in ".!?:;" else 2
        return repeated, number, 1 if n <= 12 else 2 if n <= 40 else 3 if n <= 90 else 4, 0 if not digits else 1 if share < 0.2 else 2 if share < 0.5 else 3, case, end, place

    def sequence(self, lines: list[str], titles: frozenset[str]) -> list[tuple[int, ...]]:
        last = len(lines) - 1
        return [self.features(x, 0 if not last else 1 if not k else 3 if k == last else 2, titles) for k, x in enumerate(lines)]

    def label(self, lines: list[str], titles: frozenset[str]) -> list[int]:
        return self.model.decode(self.sequence(lines, titles))

    def meant(self, token: str) -> str | None:
        """The word for which a misread token stands, if it is one."""
        if token in self.memo:
            return self.memo[token]
        got = None
        if 3 <= len(token) <= self.longest + 2 and sum(c.isalpha() for c in token) >= max(2, len(token) // 2) and not (("-" in token or "/" in token) and any(c.isdigit() for c in token)):
            least = RARER * max(1, self.words.get(token, 0))
            first = self.variants(token)
            # two places at most differ, so longer tokens than the longest word and two have no word near
            for layer in (first, (w for v in first for w in self.variants(v))):
                good = [v for v in layer if self.words.get(v, 0) >= least]
                if good:
                    got = max(good, key=lambda v: (self.words[v], v))
                    break
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[token] = got
        return got

    @staticmethod
    def variants(token: str) -> list[str]:
        out = []
        for seen, true in SHAPES:
            at = token.find(seen)
            while at >= 0:
                out.append(token[:at] + true + token[at + len(seen) :])
                at = token.find(seen, at + 1)
        return out

    def joined(self, left: str, mark: str, right: str) -> bool:
        """Whether a word was broken: known when joined, and no compound that keeps its hyphen."""
        one, two = left.lower(), right.lower()
        whole = one + two
        n = self.words.get(whole, 0)
        if n and n >= self.words.get(f"{one}-{two}", 0):
            return True
        if self.words.get(f"{one}-{two}", 0):
            return False
        if self.meant(whole):
            return True
        return not (one in self.words and two in self.words) and not (mark == "-" and (one in self.words or two in self.words) and len(one) > 3 and len(two) > 3)

    def read(self, text: str, titles: frozenset[str]) -> tuple[set[str], list[tuple[int, str]]]:
        """Kinds of noise, and the lines with their states."""
        lines = text.split("\n")
        states = self.label(lines, titles)
        kinds = set()
        if HEADER in states:
            kinds.add("header")
        if PAGE in states:
            kinds.add("page_number")
        own = [(x, s) for x, s in zip(lines, states) if s in (BODY, BREAK, GAP)]
        body = [x for x, _ in own]
        for (a, s), b in zip(own, body[1:]):
            if s == BREAK and (m := _HYPHEN.search(a)) and (n := _START.match(b)) and self.joined(m.group(1), m.group(2), n.group(1)):
                kinds.add("hyphenation")
                break
        flat = " ".join(_HYPHEN.sub("", x) if x[-2:-1] in _MARKS or x[-1:] in _MARKS else x for x in body)
        if any(map(self.misread, set(_TOKEN.findall(flat)))):
            kinds.add("misread")
        return kinds, list(zip(states, lines))

    def paragraphs(self, text: str, titles: frozenset[str]) -> list[str]:
        """The body as continuous paragraphs: words joined, misread words put right, headers and page numbers gone."""
        out: list[str] = []
        open_ = False
        for s, line in self.read(text, titles)[1]:
            if s in (HEADER, PAGE):
                continue
            if s == GAP or not line.strip():
                open_ = False
                continue
            fixed = _TOKEN.sub(lambda m: self.put_right(m.group()), line.strip())
            if not open_ or s == TABLE:
                out.append(fixed)
            elif (m := _HYPHEN.search(out[-1])) and (n := _START.match(fixed)):
                broken = self.joined(m.group(1), m.group(2), n.group(1))
                out[-1] = out[-1][: m.start(2)] + ("" if broken else "-") + fixed
                head, _, last = out[-1].rpartition(" ")
                out[-1] = out[-1] if not broken else (head + " " if head else "") + _TOKEN.sub(lambda m: self.put_right(m.group()), last)
            else:
                out[-1] += " " + fixed
            open_ = s in (BODY, BREAK)
        return out

    def put_right(self, token: str) -> str:
        low = token.lower()
        if token == token.upper() or not (v := self.meant(low)):
            return token
        return v.capitalize() if token[0].isupper() else v


def word_table(chunks: DataFrame) -> DataFrame:
    """(word, n) over all chunks, compounds with their hyphen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        for b in slices(batches, "content"):
            count.update(_DICT_WORD.findall("\n".join(t for t in b.column(0).to_pylist() if t).lower()))
            if len(count) > 300_000:
                yield send()
                count.clear()
        if count:
            yield send()

    return chunks.where(F.col("content").isNotNull()).select("content").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(words: DataFrame, most: int) -> dict[str, int]:
    """The stored ``words`` (word, n): the ``most`` most frequent in memory, the others in a file that goes to every worker."""
    total = words.count()
    if total <= most:
        return {r.word: r.n for r in words.toLocalIterator()}
    spark = words.sparkSession
    top = {r.word: r.n for r in words.orderBy(F.desc("n"), "word").limit(most).toLocalIterator()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in b.columns], ["h", "n"])

    # Spark's xxhash64 of a text is XXH64 of its bytes with seed 42; the file holds the top words, too
    sorted_ = words.select(F.xxhash64("word").alias("h"), F.col("n").cast("bigint").alias("n")).orderBy("h")
    fd, name = tempfile.mkstemp(prefix="lodestone-words-")
    os.close(fd)
    out, at = np.memmap(name, np.int64, "w+", shape=(2, total)), 0
    for r in sorted_.mapInArrow(packed, "h binary, n binary").toLocalIterator():
        h = np.frombuffer(r.h, np.int64)
        out[0, at : at + len(h)], out[1, at : at + len(h)] = h, np.frombuffer(r.n, np.int64)
        at += len(h)
    out.flush()
    spark.sparkContext.addFile(name)
    return Words(top, os.path.basename(name), words.agg(F.max(F.length("word"))).first()[0])


def dictionary(chunks: DataFrame) -> dict[str, int]:
    """The words of ``LEAST_COUNT`` occurrences or more."""
    return lexicon(stored(word_table(chunks).where(F.col("n") >= LEAST_COUNT), "p6-words"), MOST_WORDS)


def title_table(chunks: DataFrame) -> DataFrame:
    """(document_id, titles, families): per document the folded title-like lines that its pages repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            rows = [(d, f, family(x)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in t.split("\n") if title_like(x) and (f := fold(x))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["document_id", "title", "family"])

    # a section repeats the lines of its children, so these alone tell what pages repeat
    lines = chunks.where(F.col("parent_id").isNotNull() & F.col("document_id").isNotNull() & F.col("content").contains("\n")).select("document_id", "content")
    often = lines.mapInArrow(run, "document_id string, title string, family string").groupBy("document_id", "title").agg(F.count("*").alias("n"), F.min("family").alias("family")).where("n > 1")
    return often.groupBy("document_id").agg(F.sort_array(F.collect_list("title")).alias("titles"), F.max_by("family", F.struct("n", "title")).alias("family"))


def prepared(chunks: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Reader]:
    """Chunks (chunk_id, document_id, page_number, parent_id, content, titles) and what is needed to read them.

    ``sample`` bounds the chunks from which the line model is re-estimated: those whose hash is least, of several lines.
    """
    words = dictionary(chunks)
    titles = stored(title_table(chunks), "p6-titles")
    few = titles.where("family is not null").groupBy(F.col("family").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    few = lexicon(stored(few, "p6-families"), MOST_FAMILIES)
    reader = Reader(words, few if isinstance(few, Words) else frozenset(few), LineModel())
    text = chunks.where(F.col("content").isNotNull() & (F.col("content") != ""))
    rows = text.select("chunk_id", "document_id", "page_number", "parent_id", "content").join(titles.select("document_id", "titles"), "document_id", "left")
    # long texts are no better a sample than short ones
    some = text.where(F.col("content").contains("\n") & (F.length("content") < 20_000)).select("document_id", "content", F.xxhash64(F.lit(23), "content").alias("h"))
    last = some.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    # hashes travel first, contents of the sample alone
    seen = some.where(F.col("h") <= (last if last is not None else 0)).dropDuplicates(["h"]).join(titles.select("document_id", "titles"), "document_id", "left").orderBy("h").collect()
    reader.model.fit([reader.sequence(r.content.split("\n"), frozenset(r.titles or ())) for r in seen])
    return rows, reader


def noise(chunks: DataFrame) -> DataFrame:
    """(chunk_id, noise_type), each once."""
    rows, reader = prepared(chunks)
    held = chunks.sparkSession.sparkContext.broadcast((reader.words, reader.families, reader.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(*held.value)
        for b in slices(batches, "content"):
            found = [(c, k) for c, t, u in zip(*(x.to_pylist() for x in b.columns)) for k in sorted(own.read(t, frozenset(u or ()))[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)], ["chunk_id", "noise_type"])

    return rows.select("chunk_id", "content", "titles").mapInArrow(run, "chunk_id string, noise_type string").distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(document_id, page, chunk_id, paragraph_no, paragraph) of the child chunks, to be read in that order."""
    rows, reader = prepared(chunks)
    held = chunks.sparkSession.sparkContext.broadcast((reader.words, reader.families, reader.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(*held.value)
        for b in slices(batches, "content"):
            out = [(d, p, c, k, x) for d, p, c, t, u in zip(*(x.to_pylist() for x in b.columns)) for k, x in enumerate(own.paragraphs(t, frozenset(u or ())))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()))], ["document_id", "page", "chunk_id", "paragraph_no", "paragraph"])

    page = F.coalesce(F.when(F.col("page_number") > 0, F.col("page_number")), F.regexp_extract("chunk_id", r"::p(\d+)::", 1).try_cast("int")).alias("page")
    child = rows.where("parent_id is not null").dropDuplicates(["chunk_id"])
    return child.select("document_id", page, "chunk_id", "content", "titles").mapInArrow(run, "document_id string, page int, chunk_id string, paragraph_no int, paragraph string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(table(spark, sf_dir, "chunks"))


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "chunks"))
