"""Document retrieval by BM25 (Robertson et al.) over inverted-index DataFrames, and citations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: English stop words (fixed values).
STOP_WORDS = "a an and are as at be but by for from had has have if in into is it its no not of on or that the their then there these they this to was were will with".split()


def tokens_of(text: Column, stop: bool = True) -> Column:
    """Lower-case words of letters."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) > 0)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS)) if stop else words


def porter(word: str) -> str:
    """Stem of an English word (Porter, 1980)."""
    return _Stem(word).run() if len(word) > 2 else word


class _Stem:
    """The five steps of the published algorithm over one word."""

    def __init__(self, w: str):
        self.w = w

    @staticmethod
    def form(s: str) -> str:
        """The word as a pattern of runs of consonants (c) and vowels (v)."""
        out = ""
        for i, ch in enumerate(s):
            v = ch in "aeiou" or ch == "y" and i > 0 and out[-1:] == "c"
            out += "v" if v else "c"
        return out

    def measure(self, s: str) -> int:
        return len(re.findall("v+c+", self.form(s)))

    def cvc(self, s: str) -> bool:
        return self.form(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swap(self, rules: list[tuple[str, str]], least: int) -> bool:
        """The first rule whose ending fits decides; it acts if the stem's measure exceeds ``least``."""
        for end, new in rules:
            if self.w.endswith(end):
                stem = self.w[: len(self.w) - len(end)]
                if self.measure(stem) > least:
                    self.w = stem + new
                return True
        return False

    def run(self) -> str:
        w = self.w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and "v" in self.form(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and self.form(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in self.form(w[:-1]):
            w = w[:-1] + "i"
        self.w = w
        self.swap([(a, b) for a, b in (p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())], 0)
        self.swap([(a, b) for a, b in (p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())], 0)
        for end in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split():
            if self.w.endswith(end) and not any(self.w.endswith(x) for x in "ement ment".split() if len(x) > len(end) and x.endswith(end)):
                stem = self.w[: -len(end)]
                if self.measure(stem) > 1 and (end != "ion" or stem[-1:] in "st"):
                    self.w = stem
                break
        if self.w.endswith("e"):
            stem = self.w[:-1]
            if self.measure(stem) > 1 or self.measure(stem) == 1 and not self.cvc(stem):
                self.w = stem
        if self.w.endswith("ll") and self.measure(self.w) > 1:
            self.w = self.w[:-1]
        return self.w


def stemmed(words: Column) -> Column:
    """Words as their stems; each distinct word of a batch is stemmed once."""

    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return batch.map(lambda ws: [known.setdefault(w, porter(w)) if w not in known else known[w] for w in ws])

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(words)


class Index:
    """Postings (doc_id, term, tf), document lengths and document frequencies of a corpus."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stem: bool = True, stop: bool = True):
        self.stem, self.stop, self.id_col = stem, stop, id_col
        words = tokens_of(F.col(text_col), stop)
        base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (stemmed(words) if stem else words).alias("words"))
        self.lengths = base.select("doc_id", F.size("words").alias("dl")).where("dl > 0")
        self.postings = base.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        self.spark: SparkSession = docs.sparkSession

    def query_terms(self, question: str) -> list[str]:
        words = [w for w in re.split("[^a-z]+", question.lower()) if w and not (self.stop and w in STOP_WORDS)]
        return list(dict.fromkeys(porter(w) if self.stem else w for w in words))

    def search(self, question: str, k: int | None = 3, min_score: float = 0.0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc_id, score) of the best documents; ties by id. Only the query's terms are read from the postings."""
        terms = self.query_terms(question)
        hits = self.postings.where(F.col("term").isin(terms) if terms else F.lit(False))
        df = hits.groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("df"))
        stats = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
        scored = hits.join(F.broadcast(df), F.col("term") == F.col("t")).join(self.lengths, "doc_id").crossJoin(F.broadcast(stats))  # df: at most the query's terms
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        out = scored.groupBy("doc_id").agg(F.sum(part).alias("score")).where(F.col("score") >= min_score)
        return out.orderBy(F.desc("score"), "doc_id").limit(k) if k else out


def context(hits: list[dict], cut: int = 600) -> str:
    """Retrieved documents as a block of text."""
    return "\n\n".join(f"[{h.get('file_no') or h['doc_id']}] {h.get('matter_type') or ''} {h.get('status') or ''} {h.get('intro_date') or ''}\n{(h.get('text') or '')[:cut]}".strip() for h in hits)


def cited(hits: list[dict], answer: str) -> list[dict]:
    """The documents whose file number an answer names: any kind of dash, not inside a longer number or word.

    Numbers of fewer than three characters or of digits alone are no evidence.
    """
    dashes = "[-‐-―−]"
    out = []
    for h in hits:
        no = (h.get("file_no") or "").strip()
        if len(no) < 3 or no.isdigit():
            continue
        body = dashes.join(re.escape(p) for p in re.split(dashes, no))
        if re.search(rf"(?<![\w]){body}(?![\w])(?!{dashes}\w)", answer, re.I):
            out.append(h)
    return out


def swap_corpus(docs: DataFrame, folder: str) -> str:
    """Writes a corpus beside ``folder`` and then puts it in its place; leftovers of broken builds are removed.

    For a local or mounted folder; on object stores write a new folder and change what points to it.
    """
    import glob
    import os
    import shutil

    for old in glob.glob(folder + ".part*"):
        shutil.rmtree(old, ignore_errors=True)
    part, gone = f"{folder}.part{os.getpid()}", f"{folder}.old{os.getpid()}"
    docs.write.mode("overwrite").parquet(part)
    if os.path.exists(folder):
        os.replace(folder, gone)
    os.replace(part, folder)
    shutil.rmtree(gone, ignore_errors=True)
    return folder
