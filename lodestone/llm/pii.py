"""Problem 3: personal information inside free text.

E-mail addresses, phone numbers, identity numbers and postal addresses are found by their formats, minus numbers that a
label before them gives to a part, order, lot or drawing; numbers without a format of their own need a label that says what
they are. Family and given names are learned from the whole corpus: words after a title, and pairs that only names form
(``Given FAMILY``, ``FAMILY, Given``), in Latin, Greek and Cyrillic letters. A person is then a family name with a title, an
initial or a given name.

Surrogates: every find becomes a row with its entity, and every different entity gets one keyed, type-consistent replacement
in a table that all finds are joined with, so the same entity is replaced alike everywhere (coreference). Digits go through a
keyed permutation of the numbers of that length and initials through one of the alphabet, so formats stay and different
ones stay different; words become pronounceable words of the same script, case and gender (by title, else by ending).
Entities whose surrogates meet, and entities that meet a real one, are drawn anew, round after round, until all are
distinct. ``p3_found`` and ``p3_redacted`` both read this table of finds.

The key is given by ``spark.lodestone.pii.key`` or LODESTONE_PII_KEY; without one every run draws its own.

The lexicons are sent to the workers: the ``MOST_NAMES`` best supported names of either kind at most.

Defined cases: null content gives null text and no types; empty content gives empty text; a chunk stored twice counts
once; a name inside an e-mail address or a street is no NAME; overlapping finds: the earlier type of TYPES wins.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table

TYPES = ("EMAIL", "ADDRESS", "ID_NUMBER", "PHONE", "NAME")
_AT = re.compile(r"@|＠|[\[({](?:at|AT|arroba)[\])}]")
EMAIL = re.compile(r"[\w.+'-]*\w[ ]?(?:@|＠|[\[({](?:at|arroba)[\])}])[ ]?[\w-]+(?: ?(?:\.|[\[({](?:dot|punto|punkt|point)[\])}]) ?[\w-]+)*?(?:\.|[\[({](?:dot|punto|punkt|point)[\])}])[^\W\d_]{2,}(?:\.[^\W\d_]{2,})*(?![\w@])".replace("(?:at|", "(?:at|AT|").replace("(?:dot|", "(?:dot|DOT|"))
EMAIL_SPACED = re.compile(r"[\w.+'-]*\w\s(?:@|＠|[\[({](?:at|AT|arroba)[\])}])\s[\w-]+(?:(?:\.|[\[({](?:dot|DOT)[\])}])[\w-]+)+")
_U, _L = "A-ZÀ-ÖØ-ÞΑ-ΫА-ЯЁ", "a-zß-öø-ÿά-ώа-яё"
_CAP = rf"[{_U}][{_L}]+(?:-[{_U}][{_L}]+)?"
_UP = rf"[{_U}]{{3,}}(?:-[{_U}]{{3,}})?"
_PLACE = rf"(?:,? ?(?:Apt|Apto|App|Wohnung|Unit|Flat) ?\d+[a-z]?)?(?:, ?\d{{1,2}}º ?[A-Z])?(?:,? ?\d{{4,5}})?(?:,? {_CAP}(?: \d{{4,5}})?)?"
_WAY = r"(?:Street|Lane|Road|Avenue|Drive|Court|Square|Terrace|Close|STREET|LANE|ROAD|AVENUE)"
ADDRESS = re.compile(
    rf"\b\d{{1,4}}[a-z]?,? (?:(?:{_CAP}|{_UP})\s){{1,3}}{_WAY}\b{_PLACE}"
    rf"|\b(?:(?:{_CAP}|{_UP})\s){{1,3}}{_WAY} \d{{1,4}}[a-z]?\b{_PLACE}"
    rf"|\b\d{{1,4}}[a-z]?,?\s(?:rue|avenue|boulevard|chemin|impasse|allée|RUE)\s(?:(?:des?|du|de la|DES|DU|DE LA)\s|de l['’])?(?:{_CAP}|{_UP})(?:\s{_CAP})?{_PLACE}"
    rf"|\b(?:Calle|Avenida|Paseo|Plaza|CALLE)\s(?:(?:del?|de la|de los|DEL)\s)?(?:{_CAP}|{_UP})(?:\s{_CAP})?,? \d{{1,4}}[a-z]?\b{_PLACE}"
    rf"|\b(?:{_CAP}|{_UP})(?:\s(?:Str\.|STR\.|Straße|Strasse)|straße|strasse|str\.)\s\d{{1,4}}[a-z]?\b{_PLACE}"
    rf"|\b(?:P\.?O\.? ?Box|PO BOX|Postfach|Apartado(?: de Correos)?|Boîte postale)\s\d{{2,6}}\b{_PLACE}"
)
_ADDRESS_HINT = re.compile(rf"{_WAY}|\brue\b|RUE|avenue|boulevard|chemin|impasse|allée|Calle|CALLE|Avenida|Paseo|Plaza|[Ss]tr\.|STR\.|[Ss]traße|[Ss]trasse|Box|BOX|Postfach|Apartado|Boîte")
_LABEL = re.compile(r"(?:\b(?:part|order|lot|drawing|serial|software|batch|item|stock|sketch|teil|auftrag|zeichnung|los|charge|pièce|commande|dessin|plan|pieza|pedido|lote|plano)(?:[ -]?(?:no|nr|num|number|nº|n°)\b\.?|\.)?|\bno\.|\bv)[:# ]*$", re.I)
_ID_LABEL = re.compile(r"(?:passport|ssn|dni|nif|steuer|sociale|social|ausweis|identity|pase)[^\n.]{0,18}(?:\bno\. ?)?$", re.I)
ID_NUMBER = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|[A-Z]{2}\d{7}|\d{2} \d{3} \d{3} \d{3}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d \d{2} \d{2} (?:\d{2}|2[AB]) \d{3} \d{3}(?: \d{2})?)(?![\w]|-\d)")
#: Bare numbers that are personal only where a label says so.
BARE_ID = re.compile(r"(?<![\w.-])\d{9,11}(?![\w]|[-.]\d)")
BARE_PHONE = re.compile(r"(?<![\w.-])\d{10,11}(?![\w]|[-.]\d)")
_PHONE_LABEL = re.compile(r"(?:\b(?:call|phone|telephone|tel|mobile|cell|fax|telefon|mobil|rufnummer|téléphone|tél|portable|teléfono|móvil)\b\.?)[^\n.\d]{0,14}$", re.I)
PHONE = re.compile(
    r"(?<![\w+./-])(?:1[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}|\+\d{1,3}[ .-]?(?:\(?\d{1,4}\)?[ .-]?){1,5}\d{2,4}|\(\d{2,5}\) ?\d{3,4}[ -]?\d{3,5}|\d{3}([-. ])\d{3}\1\d{4}|0\d{2,4} ?/ ?\d{3,6}(?:-\d{1,5})?|0\d{4} \d{6}|0\d(?: \d{2}){4}|0\d{2,3} \d{3,4} \d{4})(?:,? ?(?:ext|x|Durchwahl|poste|int)\.? ?\d{1,5})?(?![\w]|[-.]\d)"
)
_DIGITS = re.compile(r"\d[\d ().\-/]{5,}\d|\d{7}")
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|MR|MRS|MS|DR|HERR|FRAU|MME|SR|SRA|Г-н|г-н|Г-жа|г-жа|Κος|Κα|Κύριος|Κυρία)"
_TITLED = re.compile(rf"\b{_TITLE}\.?\s+({_CAP}|{_UP})")
_PAIRS = re.compile(rf"\b(?:({_CAP})\s({_UP})|({_UP}),\s({_CAP}))(?![\w/-])")
_LISTED = re.compile(r"\d\s$")
# Words with a capital that may stand before a family name without being a given name.
_NO_GIVEN = frozenset("laut nach von mit bei vor für según selon par para con por de des by with for and the per sender contact witness visa unit steuer signed siehe see from herr frau".split())
_NAMED = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Finder:
    """Finds the entities of a text; ``family`` and ``given`` are lower-case lexicons."""

    def __init__(self, family: frozenset[str], given: frozenset[str]) -> None:
        self.family, self.given = family, given
        before = rf"\b(?:{_TITLE}\.?|[{_U}]\.|[^\W\d_]+)\s+$"
        self.before = re.compile(before)
        self.after = re.compile(r"^,\s+([^\W\d_]+(?:-[^\W\d_]+)?)")

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type), not overlapping, in order."""
        taken: list[tuple[int, int, str]] = []

        def add(s: int, e: int, kind: str) -> None:
            if all(e <= a or s >= b for a, b, _ in taken):
                taken.append((s, e, kind))

        if _AT.search(text):
            for p in (EMAIL, EMAIL_SPACED):
                for m in p.finditer(text):
                    add(*m.span(), "EMAIL")
        if _ADDRESS_HINT.search(text):
            for m in ADDRESS.finditer(text):
                add(*m.span(), "ADDRESS")
        if _DIGITS.search(text):
            for p, kind in ((ID_NUMBER, "ID_NUMBER"), (PHONE, "PHONE")):
                for m in p.finditer(text):
                    lead = text[max(0, m.start() - 40) : m.start()]
                    known = _ID_LABEL.search(lead) is not None
                    if kind == "ID_NUMBER" and " " in m.group() and m.group().count(" ") == 2 and not known:
                        continue  # three groups of digits are an identity number only if they are called so
                    if kind == "PHONE" and _LISTED.search(lead) and m.group()[0] not in "+(":
                        continue  # one of a row of numbers
                    if known or not _LABEL.search(lead):
                        add(*m.span(), kind)
            for p, label, kind in ((BARE_ID, _ID_LABEL, "ID_NUMBER"), (BARE_PHONE, _PHONE_LABEL, "PHONE")):
                for m in p.finditer(text):
                    if label.search(text[max(0, m.start() - 40) : m.start()]):
                        add(*m.span(), kind)
        words = [(m.start(), m.end(), m.group().lower()) for m in _NAMED.finditer(text) if m.group()[0].isupper() and len(m.group()) > 2]
        if not self.family.isdisjoint(w for _, _, w in words):
            for s, e, w in words:
                if w in self.family:
                    self.person(text, s, e, add)
        for m in _TITLED.finditer(text):
            add(*m.span(), "NAME")
        return sorted(taken)

    def person(self, text: str, s: int, e: int, add) -> None:
        lead = text[max(0, s - 40) : s]
        if m := self.before.search(lead):
            own = m.group().strip()
            low = own.lower()
            if low in self.given or (len(own) > 2 and own[0].isupper() and own[1:].islower() and low not in _NO_GIVEN and low not in self.family) or re.fullmatch(rf"{_TITLE}\.?|[{_U}]\.", own):
                add(s - len(lead) + m.start(), e, "NAME")
                return
        if (m := self.after.match(text[e : e + 40])) and m.group(1).lower() in self.given:
            add(s, e + m.end(), "NAME")


def lexicons(chunks: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Family and given names of the corpus.

    A family name is seen with a title and at least once more, a given name with two family names, at any size of corpus.
    All chunks teach. A section and its children say the same, so of both the one that says it more often counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def send() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in count.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()))], ["section", "whole", "family", "given", "n"])

        for b in slices(batches, "content"):
            for section, whole, t in zip(*(c.to_pylist() for c in b.columns)):
                for m in _PAIRS.finditer(t):
                    a, fam, fam2, g = m.groups()
                    count[section, whole, (fam or fam2).lower(), (a or g).lower()] += 1
                for m in _TITLED.finditer(t):
                    count[section, whole, m.group(1).lower(), m.group().split()[0].rstrip(".").lower() + "."] += 1
            if len(count) > 300_000:
                yield send()
                count.clear()
        if count:
            yield send()

    texts = chunks.where(F.col("content").isNotNull()).select(F.coalesce("parent_id", "chunk_id").alias("section"), F.col("parent_id").isNull().alias("whole"), "content")
    said = texts.mapInArrow(run, "section string, whole boolean, family string, given string, n bigint")
    each = lambda whole: F.coalesce(F.sum(F.when(F.col("whole") == whole, F.col("n"))), F.lit(0))
    said = said.groupBy("section", "family", "given").agg(F.greatest(each(True), each(False)).alias("n"))
    pairs = stored(said.groupBy("family", "given").agg(F.sum("n").alias("n")), "p3-names")
    titled = F.col("given").endswith(".")
    family = pairs.groupBy("family").agg(F.max(titled.cast("int")).alias("t"), F.sum("n").alias("n")).where((F.col("t") == 1) & (F.col("n") >= 2))
    family = stored(family.orderBy(F.desc("n"), "family").limit(MOST_NAMES).select("family"), "p3-families")
    given = pairs.where(~titled).join(family, "family", "left_semi").groupBy("given").agg(F.count_distinct("family").alias("n")).where("n > 1")
    given = given.orderBy(F.desc("n"), "given").limit(MOST_NAMES)
    return frozenset(r[0] for r in family.toLocalIterator()), frozenset(r[0] for r in given.toLocalIterator()) - _NO_GIVEN


# Syllables are made of these, in the script of the word; the letters that initials are drawn from.
_SCRIPTS = {"latin": ("aeiou", "bdfgklmnprstvz"), "greek": ("αεηιου", "βγδκλμνπρστφχ"), "cyrillic": ("аеиоу", "бвгдзклмнпрст")}
_INITIALS = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"}
# Titles that tell the gender.
_SHE = frozenset("mrs ms miss frau mme mlle madame sra srta г-жа κα κυρία".split())
_HE = frozenset("mr herr herrn monsieur sr г-н κος κύριος".split())
MOST_NAMES = 1_000_000
#: Rounds of drawing; what still meets another after these gets digits at its end.
MOST_ROUNDS = 8


def script_of(c: str) -> str:
    return "greek" if "Ͱ" <= c <= "Ͽ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "latin"


class Surrogates:
    """Keyed replacements; ``salt`` gives another draw for an entity whose surrogate met another's."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.letters: dict[tuple[str, str], dict[str, str]] = {}

    def draw(self, *parts: str) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(parts).encode(), hashlib.sha256).digest()[:16], "big")

    def digits(self, s: str, kind: str) -> str:
        """A keyed permutation of the digit strings of this length: four Feistel rounds over its two halves."""
        if len(s) < 2:
            return str((int(s) + self.draw(kind, "1")) % 10)
        a, b = s[: len(s) // 2], s[len(s) // 2 :]
        for r in range(4):
            m = 10 ** len(a)
            a, b = b, str((int(a) + self.draw(kind, str(r), str(len(s)), b)) % m).zfill(len(a))
        return a + b

    def initial(self, c: str, salt: str) -> str:
        """A keyed permutation of the letters of a script; letters with marks count as their own."""
        script = script_of(c)
        if (script, salt) not in self.letters:
            plain = _INITIALS[script]
            order = sorted(plain, key=lambda x: self.draw("initial", x, salt))
            self.letters[script, salt] = dict(zip(plain, order))
        up = c.upper()
        got = self.letters[script, salt].get(up)
        if got is None:  # a letter outside the alphabet
            got = _INITIALS[script][self.draw("initial", up, salt) % len(_INITIALS[script])]
        return got if c.isupper() else got.lower()

    def word(self, w: str, salt: str, gender: str = "") -> str:
        low = w.lower()
        script = script_of(low[0])
        vowels, consonants = _SCRIPTS[script]
        n = self.draw("word", low, salt)
        out = ""
        while len(out) < max(6, len(w) - 1):
            n, c = divmod(n, len(consonants))
            n, v = divmod(n, len(vowels))
            out += consonants[c] + vowels[v]
        she = {"latin": "a", "greek": "α", "cyrillic": "а"}[script]
        last = low[-1] if low[-1] in (*she, "e") else ""
        end = she if gender == "she" else "" if gender == "he" else last
        out = out.rstrip(vowels) + end
        return out.upper() if len(w) > 1 and w.isupper() else out.capitalize() if w[0].isupper() else out

    def of(self, entity: str, kind: str, salt: str = "0") -> str:
        digits = "".join(c for c in entity if c.isascii() and c.isdigit())
        fresh = iter(self.digits(digits, kind + salt)) if digits else iter("")
        # the last label of a mail address stays
        tail = max((m.start() for m in _DOT.finditer(entity)), default=len(entity)) if kind == "EMAIL" else len(entity)
        words = [m.group() for m in _WORD.finditer(entity)] if kind == "NAME" else []
        titles = {w.lower() for w in entity.replace(".", " ").split()}
        gender = "she" if titles & _SHE else "he" if titles & _HE else ""
        given = next((w for w in words if len(w) > 2 and not _KEEP.match(w)), None) if len(words) > 2 else None

        def one(m: re.Match) -> str:
            w = m.group()
            if w.isdigit():
                return "".join(next(fresh) if c.isascii() else c for c in w)
            if kind == "PHONE" or w in "ºª" or (kind != "NAME" and _KEEP.match(w)) or (kind == "EMAIL" and m.start() > tail):
                return w
            if len(w) <= 2:
                return self.initial(w[0], salt) + w[1:]
            return self.word(w, salt if kind in ("EMAIL", "NAME") else kind + salt, gender if w == given else "")

        if kind == "NAME" and (m := _TITLE_HEAD.match(entity)):
            return entity[: m.end()] + _WORD.sub(one, entity[m.end() :])
        return _WORD.sub(one, entity)


_WORD = re.compile(r"\d+|[^\W\d_]+")
_DOT = re.compile(r"\.|[\[({](?:dot|DOT|punto|punkt|point)[\])}]")
_TITLE_HEAD = re.compile(rf"{_TITLE}\.?\s+")
_KEEP = re.compile(rf"^(?:{_TITLE}|{_WAY}|rue|des?|du|la|Calle|del|Str|Box|PO|Apt|ext|at|dot|AT|DOT|arroba|punto|punkt|point)$")
FINDS = "chunk_id string, start int, stop int, kind string, entity string"


def finds(chunks: DataFrame, finder: Finder) -> DataFrame:
    """(chunk_id, start, stop, kind, entity): one row a find; null and empty contents have none."""
    held = chunks.sparkSession.sparkContext.broadcast((finder.family, finder.given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Finder(*held.value)
        for b in slices(batches, "content"):
            rows = [(c, s, e, k, t[s:e]) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for s, e, k in own.find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["chunk_id", "start", "stop", "kind", "entity"])

    return chunks.select("chunk_id", "content").mapInArrow(run, FINDS)


def replacements(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) of the different entities of ``found``: distinct surrogates, none of them a real entity.

    Spellings of one entity that differ in case alone count as one here: their surrogates differ in case alone.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(key)
        for b in slices(batches, "entity"):
            got = [own.of(e, k, str(n)) + (str(own.draw("last", k, e.lower()) % 10**12) if n >= MOST_ROUNDS else "") for k, e, n in zip(*(c.to_pylist() for c in b.columns[:3]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(got, pa.string())], ["kind", "entity", "salt", "surrogate"])

    schema = "kind string, entity string, salt int, surrogate string"
    drawn = lambda df: df.select("kind", "entity", "salt").mapInArrow(draw, schema)
    each = stored(drawn(found.select("kind", "entity").distinct().withColumn("salt", F.lit(0))), "p3-drawn-0")
    real = each.select("kind", F.lower("entity").alias("low")).distinct()
    fine = None
    for k in range(1, MOST_ROUNDS + 2):
        # of the entities that share a surrogate the least keeps it, unless it is a real entity or was given before
        low = F.lower("surrogate")
        first = each.groupBy("kind", low.alias("low")).agg(F.min(F.lower("entity")).alias("keeps"))
        taken = real if fine is None else real.unionByName(fine.select("kind", F.lower("surrogate").alias("low"))).distinct()
        first = first.join(taken, ["kind", "low"], "left_anti")
        judged = each.withColumn("low", low).join(first, ["kind", "low"], "left").withColumn("ok", F.col("keeps").eqNullSafe(F.lower("entity")))
        judged = stored(judged.select("kind", "entity", "salt", "surrogate", (F.col("ok") | (F.col("salt") >= MOST_ROUNDS)).alias("ok")), f"p3-judged-{k}")
        good, again = judged.where("ok").drop("ok"), judged.where("not ok").drop("ok")
        fine = good if fine is None else fine.unionByName(good)
        if again.isEmpty():
            break
        each = stored(drawn(again.withColumn("salt", F.col("salt") + 1)), f"p3-drawn-{k}")
    return fine.select("kind", "entity", "surrogate")


def surrogated(chunks: DataFrame, key: bytes) -> DataFrame:
    """The finds of all chunks, each once, with their surrogates: (chunk_id, start, stop, kind, entity, surrogate)."""
    found = stored(finds(chunks, Finder(*lexicons(chunks))).distinct(), "p3-finds")
    return found.join(replacements(found, key), ["kind", "entity"])


def redacted(chunks: DataFrame, key: bytes) -> DataFrame:
    """(chunk_id, redacted_text, detected_types, surrogate_text) of every chunk."""
    found = surrogated(chunks, key)
    listed = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "surrogate"))).alias("finds"))
    once = chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            plain, swapped, kinds = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t is None:
                    plain.append(None), swapped.append(None), kinds.append([])
                    continue
                p, q, at = [], [], 0
                for x in spans or ():
                    if x["start"] < at or x["stop"] > len(t):
                        continue  # of another content that is stored under the same id
                    p += [t[at : x["start"]], f"[{x['kind']}]"]
                    q += [t[at : x["start"]], x["surrogate"]]
                    at = x["stop"]
                plain.append("".join(p) + t[at:]), swapped.append("".join(q) + t[at:])
                kinds.append(sorted({x["kind"] for x in spans or ()}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plain, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(swapped, pa.string())], ["chunk_id", "redacted_text", "detected_types", "surrogate_text"])

    return once.join(listed, "chunk_id", "left").mapInArrow(write, "chunk_id string, redacted_text string, detected_types array<string>, surrogate_text string")


def key_of(spark: SparkSession) -> bytes:
    """The key that was set, or a new one for this run."""
    given = spark.conf.get("spark.lodestone.pii.key", None) or os.environ.get("LODESTONE_PII_KEY")
    return given.encode() if given else secrets.token_bytes(32)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogated(table(spark, sf_dir, "chunks"), key_of(spark)).select("chunk_id", F.col("kind").alias("pii_type")).distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "chunks"), key_of(spark))
