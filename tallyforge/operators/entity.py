"""Draft maps from typed names: clusters of one key, and pairs and prefixes for a reviewer."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C

#: Words with a casing of their own (fixed values).
ACRONYMS = frozenset("LLC LLP LP PLLC PLC PC PA USA US HVAC IT EMS EMT HR PD FD DBA II III IV V VI VII VIII IX X AT&T LG&E UPS IBM HP 3M CDW ADT GE TV AV PPE ID GIS DNA KY NKY NY WY".split())
PARTICLES = frozenset("ST MT FT DR MR MRS MS JR SR WM RD BLVD".split())
LOWER_JOINERS = frozenset("of and the for to in on at or de".split())


def label_of(name: str | None) -> str | None:
    """A name of one case in title case; names of both cases stay.

    Known acronyms are upper, legal forms are words, joining words inside are lower, and short words without vowels
    (y is one) are acronyms.
    """
    if not name or any(c.islower() for c in name) and any(c.isupper() for c in name):
        return name

    def cased(k: int, word: str) -> str:
        bare = word.strip(".,")
        up = bare.upper()
        if up in ACRONYMS:
            return word.upper()
        if up in C.SUFFIXES:
            return word.title()
        if k and bare.lower() in LOWER_JOINERS:
            return word.lower()
        if up not in PARTICLES and up.isalpha() and 2 <= len(up) <= 5 and not set(up) & set("AEIOUY"):
            return word.upper()
        return word.title().replace("'S", "'s")

    return " ".join(cased(k, w) for k, w in enumerate(name.split()))


def title_label(c: Column) -> Column:
    """``label_of`` over a column."""

    def run(names: pd.Series) -> pd.Series:
        return names.map(label_of)

    run.__annotations__ = {"names": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


def weights(df: DataFrame, column: str, amount: str | None, artifact: str | None = None) -> DataFrame:
    """(raw, weight) of a column's values: money if there is an amount, else rows; artifacts don't count."""
    d = df.where(~F.col(artifact)) if artifact and artifact in df.columns else df
    w = F.sum(F.col(amount).try_cast("double")) if amount and amount in df.columns else F.count(F.lit(1)).cast("double")
    return d.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("raw")).agg(F.coalesce(w, F.lit(0.0)).alias("weight"))


def clusters(raw: DataFrame) -> DataFrame:
    """(key, weight, winner, members, canonical) of (raw, weight): one row per key.

    The winner is the heaviest spelling, of equal ones the later in the alphabet.
    """
    keyed = raw.withColumn("key", C.name_key(F.col("raw"))).where("key <> ''")
    per_raw = keyed.groupBy("key", "raw").agg(F.sum("weight").alias("weight"))
    g = per_raw.groupBy("key").agg(F.sum("weight").alias("weight"), F.max(F.struct("weight", "raw")).alias("w"), F.count(F.lit(1)).alias("members"))
    return g.select("key", "weight", F.col("w.raw").alias("winner"), "members", title_label(F.col("w.raw")).alias("canonical"))


def draft_map(raw: DataFrame, min_cluster: int = 2, case_insensitive: bool = False) -> DataFrame:
    """(source, canonical) rows of a draft map: every spelling of a cluster that isn't trivial, each key once."""
    c = clusters(raw).where((F.col("members") >= min_cluster) & ~((F.col("members") == 1) & (F.col("winner") == F.col("canonical"))))
    rows = raw.select("raw", C.name_key(F.col("raw")).alias("key")).distinct().join(c.select("key", "canonical"), "key")
    if case_insensitive:
        w = Window.partitionBy("key", F.upper("raw")).orderBy("raw")
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select(F.col("raw").alias("source"), "canonical")


def merge_drafts(existing: DataFrame, draft: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Existing rows win; new sources are added."""
    fold = (lambda c: F.upper(c)) if case_insensitive else (lambda c: c)
    have = existing.select(fold(F.col("source")).alias("_k")).distinct()
    return existing.select("source", "canonical").unionByName(draft.join(have, fold(F.col("source")) == F.col("_k"), "left_anti").select("source", "canonical"))


def prefix_candidates(raw: DataFrame) -> DataFrame:
    """(prefix, canonical, weight, members) of names with a trailing store code."""
    p = raw.withColumn("prefix", F.regexp_extract(F.upper("raw"), r"^(.*#)\s*\d*\s*$", 1)).where("prefix <> ''").withColumn("key", C.name_key(F.col("raw")))
    c = clusters(raw).select("key", F.col("weight").alias("cw"), "canonical")
    j = p.join(c, "key")
    return j.groupBy("prefix").agg(F.max_by("canonical", F.struct("cw", "key")).alias("canonical"), F.sum("weight").alias("weight"), F.count_distinct("raw").alias("members"))


def initialisms(clustered: DataFrame) -> DataFrame:
    """(short_key, long_key, weight) of keys that spell the initials of another."""
    s = clustered.select(F.col("key").alias("short_key"), F.col("weight").alias("ws"), C.as_initialism(F.col("key")).alias("letters")).where("letters <> ''")
    long = clustered.select(F.col("key").alias("long_key"), F.col("weight").alias("wl"), C.initials_of(F.col("key")).alias("initials")).where(F.size(F.split("key", " ")) >= 2)
    return s.join(long, (F.col("letters") == F.col("initials")) & (F.col("short_key") != F.col("long_key"))).select("short_key", "long_key", (F.col("ws") + F.col("wl")).alias("weight"))


def near_duplicates(clustered: DataFrame, threshold: float = 0.86, top: int | None = None) -> DataFrame:
    """(key_a, key_b, ratio, weight): alike keys with the same first four letters, the heavier first.

    ``top`` is a report's choice to compare only the heaviest; by default all keys are.
    """
    c = clustered.select("key", "weight")
    if top:
        c = c.orderBy(F.desc("weight"), "key").limit(top)
    a = c.select(F.col("key").alias("key_a"), F.col("weight").alias("wa"), F.substring("key", 1, 4).alias("ba"))
    b = c.select(F.col("key").alias("key_b"), F.col("weight").alias("wb"), F.substring("key", 1, 4).alias("bb"))
    heavier = (F.col("wa") > F.col("wb")) | ((F.col("wa") == F.col("wb")) & (F.col("key_a") < F.col("key_b")))
    # the ratio can't reach the threshold when the lengths differ too much
    la, lb = F.length("key_a"), F.length("key_b")
    fits = 2 * F.least(la, lb) >= threshold * (la + lb)
    pairs = a.join(b, (F.col("ba") == F.col("bb")) & heavier & fits)

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            m = difflib.SequenceMatcher(None, p, q)
            out.append(round(m.ratio(), 3) if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold else 0.0)
        return pd.Series(out, dtype="float64")

    ratio.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    scored = pairs.withColumn("ratio", F.pandas_udf(ratio, "double")("key_a", "key_b"))
    return scored.where(F.col("ratio") >= threshold).select("key_a", "key_b", "ratio", (F.col("wa") + F.col("wb")).alias("weight"))


def residual(clustered: DataFrame, suggested: DataFrame, top: int = 40) -> DataFrame:
    """The heaviest single-spelling clusters that no suggestion covers."""
    left = clustered.where("members = 1").join(suggested.select("key").distinct(), "key", "left_anti")
    return left.orderBy(F.desc("weight"), "key").limit(top)


def report(clustered: list[dict], drafts: list[tuple[str, str]], pairs: list[dict], prefixes: list[dict], shorts: list[dict], rest: list[dict], unit: str, compared: int | None = None) -> str:
    """A reviewer's page in Markdown: what was drafted, and what to look at, heaviest first."""
    n = len(clustered)
    bound = "All clusters were compared." if compared is None or compared >= n else f"Compared the {compared} heaviest of {n} clusters. Lighter clusters were not compared."
    out = [f"# Draft map\n\n{n} clusters, {len(drafts)} drafted rows; weights in {unit}. {bound}"]
    for head, rows, cap, show in (
        ("Near duplicates", pairs, 60, lambda r: f"{r['ratio']:.3f} {r['key_a']} | {r['key_b']}"),
        ("Prefixes", prefixes, 60, lambda r: f"{r['prefix']} -> {r['canonical']} ({r['members']})"),
        ("Initialisms", shorts, 40, lambda r: f"{r['short_key']} = {r['long_key']}"),
        ("Not suggested", rest, 40, lambda r: f"{r['key']} {r['weight']:,.0f}"),
    ):
        out.append(f"## {head}\n\n" + ("\n".join(f"- {show(r)}" for r in rows[:cap]) or "none"))
    return "\n\n".join(out) + "\n"
