"""Template residue, filler, error pages and notices that scripts are required, in place of content.

1. *What the host's texts are about.*  One pass counts in how many documents each term stands; the terms of at least
   ``common`` of all documents are the corpus' own vocabulary.  With the terms of a document's address slug and title
   they are what its body should speak of.
2. *Mismatch.*  A body, and each of its segments (sentence or line), is held against these terms: the weight (rarity) of
   its own terms among all its terms.  At most ``mismatch`` of it makes a segment one that answers something else.
3. *Combined evidence* of a mismatched segment, a point each: its whole body is mismatched and low in information; it is
   told again in its document; it holds words of notices; its template (numbers aside) is told by whole mismatched
   bodies of several pages and sources.  A phrase detector (filler, error, script) or a segment that only repeats
   itself counts two.  Two points are a case.  A phrase that makes up its segment needs no mismatch.
4. *Slots* (``placeholder``) of the usual template languages are cases wherever they stand.

A sentence that only speaks of such things says mostly what its corpus speaks of, so it isn't mismatched.

Only counts of terms and evidence of mismatched segments are shuffled; the vocabulary sent to the workers has at most
``1 / common`` times as many terms as a document has on average.  Defined results: null, empty and blank texts are no
cases; repeated rows give their id once; an empty table gives no rows; columns that aren't named are not read; very
long texts are searched whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut_lineage, spread

#: Template slots.  Brackets count with a slot's words or capitals inside, so [sic], [Exhibit C], {a} and tags don't.
PLACEHOLDERS = (
    r"\{\{[^{}\n]{1,60}\}\}",
    r"[$#]\{[^{}\n]{1,60}\}",
    r"[<{]%[^%\n]{1,60}%[>}]",
    r"\[\[[^\[\]\n]{1,60}\]\]",
    r"<<\s*[A-Za-z][^<>\n]{0,60}>>",
    r"[«‹]\s?[A-Za-z][A-Za-z0-9]{0,30}(?:[ _.-][A-Za-z0-9]{1,30}){0,3}\s?[»›]",
    r"%[A-Za-z][A-Za-z_]{2,40}%",
    r"\b__[A-Za-z][A-Za-z_]{1,40}?__\b",
    r"@@[A-Za-z][A-Za-z_ ]{1,40}@@",
    r"\{[A-Za-z][A-Za-z_. ]{2,40}\}",
    r"(?i:[\[<({]\s*(?:insert|enter|add|type|your|fill in|choose|select|specify)\s[^\[\]<>(){}\n]{1,60}[\]>)}])",
    r"[\[<](?!(?:SIC|REPEALED|RESERVED|AMENDED|DELETED|OMITTED|VACANT)[\]>])[A-Z]{2,}(?:[ _.-][A-Z]{2,}){0,4}[\]>]",
    r"(?i:\[\s*(?:first|last|full|sponsor|member|agency|vendor|payee|clerk|council|matter|contract|hearing|passed|fiscal|file|start|end)?[ _.]?(?:name|date|title|number|no|subject|member|amount|address|city|year|term|district|fund|sponsor|signature|summary|description|topic|placeholder|tbd|todo)\s*\])",
    r"(?i:\[\s*(?:summary|text|title|description|content|details)\s(?:pending|missing|to come|to follow|tbd|here)\s*\])",
    r"(?i:\[\s*(?:sponsor|member|agency|vendor|payee|clerk|council|matter|contract|hearing|file)\s*\])",
    r"(?i:[\[<{]\s*[^\s\[\]<>{}_.-]{1,30}(?:[ _.-]+[^\s\[\]<>{}_.-]{1,30}){0,3}[ _.-]+here\s*[\]>}])",
    r"(?<![_\w])_{5,}(?!\w)",
)
#: Phrases of filler, error messages and notices that ask for scripts; each holds a word of ``TRIGGERS``.
FILLER = (
    r"lorem\W+ipsum\W+dolor|dolor sit amet|consectetur adipiscing|nulla facilisi|sed ut aliquam|ut enim ad minim",
    r"(?:sample|dummy|placeholder|your|example) (?:text|copy|content) (?:goes )?(?:here|for layout only|for layout|only)|\btext goes here\b",
    r"replace this (?:paragraph|text|sentence|line|section) with(?: your own \w+)?|(?:body )?copy to follow\b|content coming soon",
    r"\btest (?:matter|record|page|entry),? (?:please )?ignore|please ignore this test",
    r"(?:\w+ (?:of the \w+ )?)?will appear (?:in this space|here)|(?:type|enter|write|put) (?:the|your|a) (?:description|text|summary|title|content) here",
)
ERROR = (
    r"\bhttp error \d{3}|\b[45]\d\d:? (?:bad request|unauthorized|forbidden|not found|gone|gateway timeout|request timeout|bad gateway|internal server error|service unavailable|too many requests)",
    r"\"status\": ?[45]\d\d|<title>\s*(?:error|[45]\d\d)|error al cargar la pagina|no esta disponible",
    r"^access denied\b|do(?:es)? not have permission to (?:open|access|view|see)|\btoo many requests\b|has been rate limited",
    r"database connection failed|could not retrieve (?:file|record|page|document)|session has expired|sign in again to|invalid request token|refresh the form and submit",
    r"something went wrong|^oops\b|page you (?:are looking for|requested)|(?:record|page|document|file) (?:\d+ )?(?:could not be|cannot be) (?:shown|found|displayed|loaded|opened)",
    r"we're sorry, (?:record|page|the|this)|temporarily unavailable while|site can't be reached|took too long to (?:answer|respond)|contact the site administrator",
    r"nullpointerexception|^traceback \(most recent call last\)|^(?:key|value|type|index|attribute|name)error:|undefined (?:index|variable|offset) \w+ in|^(?:fatal|warning|uncaught|unhandled)(?: error)?:|\bat [\w.$]+\(\w+\.java:\d+\)|^file \"[^\"]+\", line \d+",
)
SCRIPT = (
    r"(?:please|must|need to|to continue,?) enable (?:javascript|scripts|cookies)|enable javascript (?:to|and|in)\b|<noscript",
    r"(?:javascript|scripting|scripts) (?:is|are) (?:currently )?(?:disabled|turned off|blocked|required|not enabled)|requires? (?:javascript|scripts)\b|no admite javascript|\bactivelo para ver",
    r"scripts and cookies must be allowed|checking your browser before|turn (?:it|them|javascript) on in your browser|without (?:javascript|scripts) (?:this|the) (?:page|site)",
)
#: Words of notices.
NOTICE_WORDS = frozenset("error errors sorry unavailable denied forbidden unauthorized expired timeout timed reload refresh browser navegador cookies javascript noscript scripts scripting captcha retry maintenance server gateway disponible exception traceback nullpointerexception undefined oops".split())
#: Words without which no phrase above is found.
TRIGGERS = NOTICE_WORDS | frozenset(
    "lorem dolor consectetur nulla sed enim text copy content replace coming test ignore appear type enter write put http bad found gone many status title permission rate database retrieve session sign token form wrong page record document file could cannot site took long administrator keyerror valueerror typeerror indexerror attributeerror nameerror error fatal warning uncaught unhandled java activelo cargar esta allowed requires require access request requests".split()
)

_SLOT_SIGN = re.compile(r"[\[{<«‹%(]|__|@@")
_SLOT = re.compile("|".join(PLACEHOLDERS))
_KINDS = tuple((k, re.compile("|".join(f"(?:{x})" for x in p))) for k, p in (("filler", FILLER), ("error", ERROR), ("script", SCRIPT)))
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SPACE = re.compile(r"[^\S\n\r]+")
_CUT = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_DIGITS = re.compile(r"\d+")
#: Weight of a term outside of the vocabulary, about that of one in four hundred documents.
RARE = 6.0


def plain(text: str) -> str:
    """The text without invisible characters, any white space inside a line as one blank."""
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    return _SPACE.sub(" ", text)


def fold(text: str) -> str:
    """Lower case, accents removed."""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t.replace("’", "'")) if not unicodedata.combining(c))
    return t


class Judge:
    """Holds texts against a vocabulary (term -> weight)."""

    def __init__(self, vocabulary: dict[str, float], mismatch: float, low_terms: int, phrases: bool = True):
        self.own, self.mismatch, self.low_terms, self.phrases = vocabulary, mismatch, low_terms, phrases

    def share(self, terms: set[str], extra: set[str] | frozenset = frozenset()) -> float:
        """How much of the weight of ``terms`` is of the vocabulary or of ``extra``."""
        own = rare = 0.0
        for w in terms:
            x = self.own.get(w)
            if x is not None:
                own += x
            elif w in extra:
                own += RARE
            else:
                rare += RARE
        return own / (own + rare) if own + rare else 1.0

    def look(self, text: str, about: str) -> list[tuple]:
        """(template, kind, points, whole) of the suspicious segments of a text; kind ``slot`` for a placeholder."""
        t = plain(text)
        out = [("", "slot", 2, False)] if _SLOT_SIGN.search(t) and _SLOT.search(t) else []
        extra = frozenset(_WORD.findall(fold(about)))
        parts, body = [], set()
        for s in _CUT.split(fold(t)):
            words = _WORD.findall(s)
            if words:
                terms = set(words)
                body |= terms
                parts.append((s.strip(), words, terms, self.share(terms, extra)))
        if not parts:
            return out
        far = [p for p in parts if p[3] <= self.mismatch]
        whole = len(far) >= 0.75 * len(parts) and len(body) <= self.low_terms and self.share(body, extra) <= self.mismatch
        noticed = whole and any(not NOTICE_WORDS.isdisjoint(p[2]) for p in far)
        told = Counter(p[0] for p in far)
        for s, words, terms, share in parts:
            kind = self.phrase(s, terms, share)
            if share > self.mismatch:
                if kind:
                    out.append((_DIGITS.sub("#", s), kind, 2, False))
                continue
            again = told[s] > 1 or repeats(words)
            if kind == "" and repeats(words):
                kind = "filler"
            points = 2 * bool(kind) + whole + again + (noticed or not NOTICE_WORDS.isdisjoint(terms))
            if points or whole:
                out.append((_DIGITS.sub("#", s), kind, points, whole))
        return out

    def phrase(self, s: str, terms: set[str], share: float) -> str:
        """The kind of detector that fires: in a mismatched segment anywhere, in another only if it makes up most of it."""
        if not self.phrases or TRIGGERS.isdisjoint(terms):
            return ""
        for kind, p in _KINDS:
            if share <= self.mismatch:
                if p.search(s):
                    return kind
            elif sum(len(m.group()) for m in p.finditer(s)) >= 0.7 * len(s):
                return kind
        return ""


def repeats(words: list[str]) -> bool:
    """Whether a segment says the same few words over and over, words of one letter counting as equal."""
    n = len(words)
    if n < 4:
        return False
    few = len({w if len(set(w)) > 1 else w[0] for w in words})
    return few * 4 <= n or n >= 6 and few * 2 <= n


def vocabulary(docs: DataFrame, text: str, common: float, least: int = 5) -> dict[str, float]:
    """The terms of at least ``common`` of the documents (and ``least``), with their rarity as weight."""

    def count(frames):
        import pandas as pd

        for pdf in frames:
            c: Counter = Counter()
            for t in pdf[text]:
                c.update(set(_WORD.findall(fold(plain(t)))))
            yield pd.DataFrame(list(c.items()), columns=["term", "n"])

    n = docs.count()
    terms = docs.select(text).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: math.log(n / r["n"]) for r in terms.where(F.col("n") >= max(least, common * n)).collect()}


def segments(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url", title_cols: tuple[str, ...] = ("matter_type", "file_no"), source_col: str = "source", common: float = 0.02, mismatch: float = 0.25, low_terms: int = 40, phrases: bool = True) -> DataFrame:
    """(id, host, source, template, kind, points, whole) of the suspicious segments, without the evidence of other documents."""
    url = F.col(url_col).cast("string")
    slug = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/(.*)$", 1), r"[^\p{L}]+", " ")
    d = spread(
        docs.where(F.col(text_col).isNotNull()).select(
            F.col(id_col).alias("id"),
            F.regexp_extract(url, r"^[a-zA-Z]+://([^/]+)", 1).alias("host"),
            F.col(source_col).cast("string").alias("source"),
            F.concat_ws(" ", slug, *[F.col(c).cast("string") for c in title_cols]).alias("about"),
            F.col(text_col).cast("string").alias("text"),
        )
    )
    own = d.sparkSession.sparkContext.broadcast(vocabulary(d, "text", common))  # at most 1 / common times the mean number of terms

    def run(frames):
        import pandas as pd

        judge = Judge(own.value, mismatch, low_terms, phrases)
        for pdf in frames:
            rows = [(i, h, s, *r) for i, h, s, a, t in pdf.itertuples(index=False, name=None) for r in judge.look(t, a)]
            yield pd.DataFrame(rows, columns=["id", "host", "source", "template", "kind", "points", "whole"])

    return d.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, host string, source string, template string, kind string, points int, whole boolean")


def evidence(docs: DataFrame, *, id_col: str = "doc_id", least_pages: int = 3, least_sources: int = 2, **options) -> DataFrame:
    """One row per suspicious document: flags, points, how many pages, hosts and sources tell its template, and ``hit``."""
    s = cut_lineage(segments(docs, id_col=id_col, **options).withColumn("digest", F.xxhash64("template")).drop("template"))
    # a template that a third of all pages tell is one group of counters: pages are counted per source first
    told = s.where("whole").select("digest", "host", "source", "id").distinct().groupBy("digest", "host", "source").agg(F.count(F.lit(1)).alias("n"))
    told = told.groupBy("digest").agg(F.sum("n").alias("pages"), F.size(F.collect_set("host")).alias("hosts"), F.count_distinct("source").alias("sources"))
    told = told.where((F.col("pages") >= least_pages) & (F.col("sources") >= least_sources))
    s = s.join(told, "digest", "left").withColumn("score", F.col("points") + F.when(F.col("pages").isNotNull() & (F.col("kind") != "slot"), 1).otherwise(0))
    flag = lambda k: F.max((F.col("kind") == k) & (F.col("score") >= 2))
    return s.groupBy(F.col("id").alias(id_col)).agg(
        flag("slot").alias("placeholder"), flag("filler").alias("filler"), flag("error").alias("error"), flag("script").alias("script"),
        F.max("whole").alias("whole"), F.max("score").cast("int").alias("score"), F.coalesce(F.max("pages"), F.lit(0)).cast("long").alias("pages"), F.coalesce(F.max("hosts"), F.lit(0)).cast("long").alias("hosts"), F.coalesce(F.max("sources"), F.lit(0)).cast("long").alias("sources"),
    ).withColumn("hit", F.col("score") >= 2)


def residue(docs: DataFrame, **options) -> DataFrame:
    """(id) of every document with template residue or a page that stands in for content."""
    return evidence(docs, **options).where("hit").select(options.get("id_col", "doc_id"))


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents without the cases; all columns are kept."""
    id_col = options.get("id_col", "doc_id")
    return docs.join(residue(docs, **options), id_col, "left_anti")
