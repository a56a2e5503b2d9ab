"""Problem 10: template residue and error-page text.

Records are cut into messages (lines and sentences, markup stripped). Message templates are mined with a fixed-depth prefix
tree: its levels are the number of tokens, the first two and the last one, numbers and codes masked; a leaf holds templates,
token lists whose differing places have become wildcards. Workers mine the records of few sentences, where residue is all
there is; the trees of all workers are merged path by path, and a second pass counts in how many records of either sort,
short and ordinary, each template stands. Then every template is judged once:

* by seeds, phrases that pages use of themselves and that need no support;
* by its statistics where only a weak seed speaks for it: enough records, nearly all of them made of it alone.

The verdict holds for all messages of the template. A message of content is judged by its parts between spaced dashes and
arrows. A record is residue if it has a residual message and none of content. Unresolved slots inside ordinary sentences
are found separately: a record that mentions one field as its matter is content, one full of slots is not.

Verdicts mined from statistics travel to the workers in blocks of ``MOST_TEMPLATES``; each further block is one more pass.

Defined cases: null, empty and blank texts are no residue; a text of codes or bare menu entries alone is no residue;
several kinds in one record: placeholder before script_notice before error_page before filler; one row a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, slices, stored, table

SLOT = re.compile(r"\{\{[^{}\n]*\}\}|\$\{\w+\}|%[A-Z][A-Z_]+%|__[A-Z][A-Z_]*__|\[(?:INSERT|Insert|insert|ENTER|Enter) [^\]\n]+\]|\[[\w ]+: ?(?:TBD|TODO|N/A)\]|<<\s*\w+\s*>>|<(?:enter|insert|your) [\w ]+>|\{%[^%\n]*%\}|#\{\w+\}|<(?!(?i:/?(?:html|head|body|div|span|table|tr|td|th|ul|ol|li|p|a|b|i|br|hr|h[1-6]|img|pre|code)\b))[A-Z][A-Z_ ]{2,}>|(?<![\w{$#])\{[a-z][a-z0-9_.]*\}(?!\})|\[[A-Z][A-Z_ ]{2,}\]")
#: A record needs this many slots, or one slot for so few words, to count as an unfilled template.
SLOTS, WORDS_A_SLOT = 2, 8

# Articles, auxiliaries and conjunctions of the four languages, which sentences hold and menu entries don't.
FUNCTION_WORDS = frozenset(
    "the a an is are was were be been has have had must should can cannot do does did not and or if when while until then this that these with from at by it its as which"
    " der die das den dem des ein eine ist sind war wird werden wurde wurden muss soll sollte darf nicht und oder wenn dass mit bei nach im am zu wie als hier vor danach solange"
    " le la les un une est sont sera ne pas et ou si que qui dans sur avec il elle puis tant lorsque cette ce se après avant au aux"
    " el los las una es son está esté se no y o cuando mientras hay debe con por según al lo su antes después que en".split()
)
# Articles that menu entries hold too, and what pages that speak of themselves name as their subject.
ARTICLES = frozenset("der die das le la les l el los las".split())
PAGE_WORDS = frozenset(
    "page file item document resource request server site url address viewer browser seite datei dokument anfrage server adresse browser"
    " fichier ressource demande requête serveur adresse navigateur página archivo documento recurso solicitud servidor dirección navegador".split()
)
# What pages say of themselves when they fail, and what they add to it.
ERROR_CUES = re.compile(
    r"not found|could not (?:be )?(?:load|open)|(?:temporarily |service )unavailable|access denied|gateway time-?out|bad request|internal fault|moved or deleted|do not have permission|unexpected error|upstream server|session (?:has )?expired|internal server error|forbidden|nothing to display|too many requests"
    r"|bad gateway|(?:site|page|portal|server|service|system)\b.{0,30}(?:under maintenance|offline)|(?:webseite|seite|portal|server|dienst)\b.{0,30}(?:offline|in wartung|gewartet)|(?:site|page|portail|serveur)\b.{0,30}(?:en maintenance|hors ligne)|(?:sitio|página|portal|servidor)\b.{0,30}(?:en mantenimiento|fuera de línea)"
    r"|nicht gefunden|sitzung abgelaufen|zugriff verweigert|nicht (?:verfügbar|erreichbar)|ist ein fehler aufgetreten|konnte nicht geladen|keine berechtigung|derzeit nicht"
    r"|session expirée|indisponible|introuvable|accès refusé|erreur est survenue|non trouvée?|pas disponible"
    r"|no está disponible|no encontrad[ao]|sesión ha caducado|acceso denegado|se produjo un error|no se pudo|no tiene permiso"
    r"|^\W*(?:oops|(?:error|http|status|erreur|fehler|err_)\W*#)\W*$|^\W*(?:error|http|status|err_|erreur|fehler)\W*#"
)
SCRIPT_CUES = re.compile(r"javascript|\bjs\b|\bscript(?:s|ing)?\b|\bskripte?\b|(?:checking|vérification|verificando|comprobando|prüf\w+).{0,12}(?:browser|navigateur|navegador)|just a moment|cookies|verif\w+.{0,12}(?:you are|you're)|captcha|you are (?:a )?human")
AUX_CUES = re.compile(r"retry|try again|start ?page|startseite|page d'accueil|página de inicio|retour à l'accueil|volver al inicio|(?:log|sign) ?in\b|inicie sesión|vous connecter|anmelden|if this continues|some content cannot|später|réessayer|más tarde|(?:trace|request id|ref|id|ray id|incident)\b\W*#|reload|neu laden|contact (?:the|your)|powered by|all rights reserved")
FILLER_CUES = re.compile(r"your text goes here|insert (?:description|text|content|title)|lorem|dolor sit|(?:dummy|sample|placeholder|filler) text|text goes|hier steht ihr text|votre texte ici|su texto aquí|beschreibung einfügen|inserte? (?:la )?descripción|insérer")
# Words that by themselves say little, but much of a message that is all its records hold.
WEAK_SCRIPT = re.compile(r"wait|browser|human|robot|verif|loading|script|enable|allow|warten|lädt|geladen|patient|chargement|espere|cargando|activ|aktivier")
WEAK_ERROR = re.compile(r"error|fail|fault|unable|cannot|denied|block|expired|missing|invalid|timeout|timed out|gateway|proxy|server|maintenance|offline|unavailable|fehler|ungültig|wartung|gesperrt|erreur|échec|impossible|interdit|bloqué|fallo|inválid|caducad|bloquead|prohibid|\b[45]\d\d\b")
#: A mined template needs as many records, and as large a share of them made of it alone. Sentences that a short record has at most.
SUPPORT, ALONE, FEW = 3, 0.95, 3
#: Share of equal tokens at which a message belongs to a template.
ALIKE = 0.6
MOST_TEMPLATES = 100_000
_TAGS = re.compile(r"<[a-zA-Z/!][^<>\n]*>")
_CUT = re.compile(r"[\r\n|]+|(?<=[.!?])\s+")
_JOINT = re.compile(r"\s+[-–—>]+(?:\s+|$)")
_CODED = re.compile(r"\S*\d\S*")
_WORD = re.compile(r"[^\W\d_]+")
ERROR_WORDS, SCRIPT_WORDS, LONGEST = 9, 16, 24


Path = tuple[int, str, str, str]


class TemplateTree:
    """Fixed-depth prefix tree: number of tokens, first, second and last token; leaves hold templates with wildcards."""

    def __init__(self) -> None:
        self.leaves: dict[Path, list[list[str | None]]] = {}
        self.counts: dict[Path, list[list[int]]] = {}
        self.starts: set[str] = set()

    @staticmethod
    def tokens(message: str) -> list[str]:
        return _CODED.sub("#", message.lower()).split()

    @staticmethod
    def path(tokens: list[str | None]) -> Path:
        return len(tokens), tokens[0] or "", (tokens[1] or "") if len(tokens) > 1 else "", tokens[-1] or ""

    def find(self, tokens: list[str | None]) -> tuple[Path, int] | None:
        """The template of the leaf that shares most places with ``tokens``, if enough of them; wildcards fit anything."""
        path = self.path(tokens)
        best, at = ALIKE * len(tokens) - 1e-9, -1
        for k, t in enumerate(self.leaves.get(path, ())):
            same = sum(a == b for a, b in zip(t, tokens))
            if same > best or (at < 0 and same >= best):
                best, at = same, k
        return (path, at) if at >= 0 else None

    def hold(self, template: list[str | None]) -> Path:
        """Take in a template as it is."""
        path = self.path(template)
        self.leaves.setdefault(path, []).append(template)
        self.starts.add(path[1])
        return path

    def match(self, message: str) -> tuple[Path, int] | None:
        """The held template of a message; most messages are turned away at their first token."""
        first = message.split(None, 1)[:1]
        if not first or _CODED.sub("#", first[0].lower()) not in self.starts:
            return None
        return self.find(self.tokens(message))

    def add(self, tokens: list[str | None], *counts: int) -> None:
        """Put a message, or a template of another tree, where it belongs; places that differ become wildcards."""
        got = self.find(tokens)
        if got is None:
            path = self.path(tokens)
            self.leaves.setdefault(path, []).append(list(tokens))
            self.counts.setdefault(path, []).append(list(counts))
            return
        path, k = got
        own = self.leaves[path][k]
        self.leaves[path][k] = [a if a == b else None for a, b in zip(own, tokens)]
        self.counts[path][k] = [a + b for a, b in zip(self.counts[path][k], counts)]

    def rows(self) -> Iterator[tuple[Path, list[str | None], list[int]]]:
        for path, own in self.leaves.items():
            for t, c in zip(own, self.counts[path]):
                yield path, t, c


class Judge:
    """Verdicts of messages: those of mined templates first, then by seeds and shape, once for each shape."""

    def __init__(self, known: frozenset[str], mined: dict[str, list[tuple[list[str | None], str]]] | None = None) -> None:
        self.known = known
        self.memo: dict = {}
        self.tree, self.kinds = TemplateTree(), {}
        for kind, templates in (mined or {}).items():
            for t in templates:
                self.kinds.setdefault(self.tree.hold(t), []).append(kind)

    def verdict(self, message: str) -> str:
        if self.kinds:
            if got := self.tree.match(message):
                return self.kinds[got[0]][got[1]]
        masked = _CODED.sub("#", message.lower())
        words = _WORD.findall(masked)
        if not words:
            return "none"
        cues = tuple(m.group() if (m := c.search(masked)) else "" for c in (ERROR_CUES, SCRIPT_CUES, AUX_CUES, FILLER_CUES))
        own = frozenset(words)
        shape = (
            bool(own & FUNCTION_WORDS), bool(own & self.known), "#" in masked, len(own) <= 2, max(map(words.count, own)) > 1 if len(words) < 40 else True,
            own & FUNCTION_WORDS <= ARTICLES and masked.rstrip()[-1:] not in ".!?", bool(own & PAGE_WORDS) and not set("\"“”„«»") & set(masked),
        )
        key = (min(len(words), LONGEST), cues, shape)
        if (got := self.memo.get(key)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[key] = self.classify(len(words), cues, shape)
        return got

    @staticmethod
    def classify(n: int, cues: tuple[str, ...], shape: tuple[bool, ...]) -> str:
        error, script, aux, filler = cues
        sentence, known, coded, few, again, entries, page = shape
        # a long message is a page's own if it names the page and no other subject
        own = page and not known and n < LONGEST
        if filler:
            return "filler"
        if script and (n <= SCRIPT_WORDS or own) and not (coded and sentence and n > 6):
            return "script_notice"
        if error and (n <= ERROR_WORDS or own):
            return "error_page"
        if aux and (n <= ERROR_WORDS or own):
            return "aux"
        if few and again and n >= 4:
            return "filler"
        if entries and known:
            return "menu"
        if sentence and n >= 3:
            return "content"
        if not known and not sentence and n >= 3:
            return "filler"
        return "menu"


def messages(text: str) -> list[str]:
    return [m for m in _CUT.split(_TAGS.sub("\n", text)) if m]


def classify_text(text: str, tree: Judge) -> str | None:
    slots = SLOT.findall(text)
    if slots:
        words = len(_WORD.findall(SLOT.sub(" ", text)))
        if len(slots) >= SLOTS or words <= WORDS_A_SLOT * len(slots):
            return "placeholder"
    found = set()
    for m in messages(text):
        kind = tree.verdict(m)
        # a page's message and its advice, or menu entries, may be joined by dashes and arrows
        found.update([kind] if kind != "content" else map(tree.verdict, _JOINT.split(m)))
        if "content" in found:
            return None
    for kind in ("script_notice", "error_page", "filler"):
        if kind in found:
            return kind
    return None


def sentences(text: str, most: int) -> list[list[str | None]]:
    """The tokens of the messages that are sentences: three words or more, one of them a function word; ``most`` and one more at most."""
    out: list[list[str | None]] = []
    for m in messages(text):
        t = TemplateTree.tokens(m)
        if len(t) >= 3 and not FUNCTION_WORDS.isdisjoint(w.strip(".,;:!?") for w in t):
            out.append(t)
            if len(out) > most:
                break
    return out


_ROWS = "n int, first string, second string, last string, template array<string>, few bigint, other bigint"


def _emitted(tree: TemplateTree) -> Iterator[pa.RecordBatch]:
    rows = [(*p, t, *c) for p, t, c in tree.rows()]
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64())
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000]), kinds)], [f.split()[0] for f in _ROWS.split(", ")])


def mined(docs: DataFrame) -> DataFrame:
    """Templates of the records of few sentences, merged over all workers, with the number of these records."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree()
        for b in slices(batches, "text"):
            for t in b.column(0).to_pylist():
                own = sentences(t, FEW)
                if 0 < len(own) <= FEW:
                    for m in own:
                        tree.add(m, 1, 0)
            if sum(map(len, tree.leaves.values())) > 50_000:  # goes on with a new tree; the merge makes them one
                yield from _emitted(tree)
                tree = TemplateTree()
        yield from _emitted(tree)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, TemplateTree()
        for b in batches:
            for *path, t, few, other in zip(*(c.to_pylist() for c in b.columns)):
                if path != last and last is not None:
                    yield from _emitted(tree)
                    tree = TemplateTree()
                last = path
                tree.add(t, few, other)
        yield from _emitted(tree)

    path = ("n", "first", "second", "last")
    parts = docs.where("text is not null").select("text").mapInArrow(mine, _ROWS)
    parts = parts.groupBy(*path, "template").agg(F.sum("few").alias("few"), F.sum("other").alias("other"))
    width = shuffle_width(docs.sparkSession)
    return parts.repartition(width, *path).sortWithinPartitions(*path, F.desc("few"), "template").mapInArrow(merge, _ROWS)


def weakly(template: list[str | None]) -> str | None:
    text = " ".join(t or "*" for t in template)
    return "script_notice" if WEAK_SCRIPT.search(text) else "error_page" if WEAK_ERROR.search(text) else None


def judged(docs: DataFrame, known: frozenset[str]) -> Iterator[dict[str, list[list[str | None]]]]:
    """Blocks of mined templates by verdict: weakly seeded, of enough records, nearly all of them made of the template alone."""
    spark = docs.sparkSession
    judge = Judge(known)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those that a seed does not decide already and a weak one speaks for."""
        for b in batches:
            keep = [i for i, t in enumerate(b.column(4).to_pylist()) if weakly(t) and judge.verdict(" ".join(x or "*" for x in t)) in ("content", "menu", "none")]
            if keep:
                yield b.take(pa.array(keep))

    few = stored(mined(docs).where(F.col("few") >= SUPPORT).mapInArrow(open_, _ROWS), "p10-templates")
    n = few.count()
    blocks = -(-n // MOST_TEMPLATES)
    block = F.pmod(F.xxhash64("n", "first", "second", "last", "template"), F.lit(max(1, blocks)))
    for k in range(blocks):
        rows = [r.template for r in few.where(block == k).select("template").collect()]  # MOST_TEMPLATES or so
        held = spark.sparkContext.broadcast(rows)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tree = TemplateTree()
            at: dict[Path, list[int]] = {}
            for i, t in enumerate(held.value):
                tree.hold(t)
                at.setdefault(tree.path(t), []).append(i)
            seen = np.zeros((len(held.value), 2), np.int64)
            for b in slices(batches, "text"):
                for t in b.column(0).to_pylist():
                    met = {at[g[0]][g[1]] for m in messages(t) if (g := tree.match(m))}
                    if met:
                        seen[list(met), 0 if len(sentences(t, FEW)) <= FEW else 1] += 1
            some = np.flatnonzero(seen.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(seen[some, 0]), pa.array(seen[some, 1])], ["i", "few", "other"])

        spread = docs.where("text is not null").select("text").mapInArrow(count, "i bigint, few bigint, other bigint").groupBy("i").agg(F.sum("few").alias("few"), F.sum("other").alias("other"))
        out: dict[str, list[list[str | None]]] = {}
        for r in spread.where((F.col("few") >= SUPPORT) & (F.col("few") >= ALONE * (F.col("few") + F.col("other")))).collect():
            out.setdefault(weakly(rows[r.i]) or "error_page", []).append(rows[r.i])
        yield out


def residue(docs: DataFrame, known: frozenset[str]) -> DataFrame:
    """(doc_id, residue_type) of the residual records."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema, out = f"doc_id {kind}, residue_type string", None
    for block in list(judged(docs, known)) or [{}]:
        held = docs.sparkSession.sparkContext.broadcast((known, block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            judge = Judge(*held.value)
            for b in slices(batches, "text"):
                kinds = [classify_text(t, judge) if t else None for t in b.column(1).to_pylist()]
                at = [i for i, k in enumerate(kinds) if k]
                if at:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([kinds[i] for i in at])], ["doc_id", "residue_type"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    order = F.array_position(F.array(*map(F.lit, ("placeholder", "script_notice", "error_page", "filler"))), F.col("residue_type"))
    return out.groupBy("doc_id").agg(F.min_by("residue_type", order).alias("residue_type"))


def known_words(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """Words of the glossary, a fixed list of some hundred terms of the domain."""
    rows = table(spark, sf_dir, "glossary").where("term is not null").select("term").collect()
    return frozenset(w for r in rows for w in _WORD.findall(r.term.lower()) if len(w) > 2)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(table(spark, sf_dir, "documents"), known_words(spark, sf_dir))
