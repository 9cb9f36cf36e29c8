"""Free-entered values mapped to a reference list.

A trie holds every way in which a reference entry is known: its name, and alias paths (without the words of its kind,
in another order, with shortened words, its initials, spellings that are mapped already).  A typed value is searched
with a Levenshtein automaton: the states are the distances along a band of the value, one step per trie edge, so
branches that can no longer come within the distance are cut, and all entries within it come out.  The distance grows
with the length of the value.  The entry with the least score wins; a tie between entries matches none.

Lists are cut by groups (here: cities).  A group with a long list is split over shards of it, one with many values over
salts, so no group has to fit one task; the best hits of the shards meet in an aggregation.

Defined results: a null, empty or blank value is unmatched; equal values get equal results; an empty reference list
matches nothing; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.lexicon import JOINERS, edits, fold, skeleton, strip_notes, words_of

#: What bodies are called by their kind (fixed values): dropped before and behind a name.
KIND_BEFORE = ("department", "dept", "dpt", "office", "off", "division", "div", "bureau", "board", "metro", "city")
KIND_BEHIND = ("department", "dept", "dpt", "division", "div", "office")
KIND_LAST = ("commission", "authority", "board", "bureau", "network", "district", "trust", "company", "partnership", "administrator", "office", "department", "agency", "division", "council")
#: Short forms that no rule makes from the word (fixed values).
SHORT_FORMS = {"svc": "services", "svcs": "services", "srvcs": "services", "nbhd": "neighborhood", "nbrhd": "neighborhood", "neighbrhd": "neighborhood", "ofc": "office", "st": "street", "hwy": "highway", "mgmt": "management", "govt": "government", "bldg": "building", "xfer": "transfer"}
#: Values that name nothing (fixed values).
NOTHING = ("", "na", "none", "null", "unknown", "misc", "miscellaneous", "various", "tbd", "tbdbyclerk", "seememo", "other", "test", "pending", "blank", "x", "xx", "xxx", "notapplicable", "notstated", "unassigned")


def allowed(n: int) -> int:
    """The distance allowed for a value of n letters."""
    return 0 if n <= 4 else 1 if n <= 7 else 2 if n <= 11 else 3


class Trie:
    """Paths of letters; each end holds (entry, penalty)."""

    __slots__ = ("children", "ends", "below")

    def __init__(self):
        self.children: dict[str, Trie] = {}
        self.ends: dict[int, float] = {}
        self.below: set[int] | None = set()

    def add(self, path: str, entry: int, penalty: float) -> None:
        node = self
        for c in path:
            node = node.children.setdefault(c, Trie())
            node.below.add(entry)
        if node is not self:
            node.ends[entry] = min(penalty, node.ends.get(entry, penalty))

    def search(self, value: str, k: int, open_end: bool = False) -> Iterator[tuple[int, float, int]]:
        """(entry, penalty, distance) of every path within k edits (a swap of neighbours is one) of ``value``.

        With ``open_end`` paths that only begin like the value count too, with their distance to that beginning.
        """
        n = len(value)
        first = {j: j for j in range(min(n, k) + 1)}
        stack = [(self, first, None, "", 0)]
        while stack:
            node, row, before, last, depth = stack.pop()
            if depth:
                d = row.get(n)
                if d is not None and d <= k:
                    for e, p in node.ends.items():
                        yield e, p, d
                    if open_end:
                        for e in node.below:
                            yield e, -1.0, d
            for c, child in node.children.items():
                new: dict[int, int] = {}
                low, high = max(0, depth + 1 - k), min(n, depth + 1 + k)
                for j in range(low, high + 1):
                    best = row.get(j, k) + 1  # the path has a letter more
                    if j:
                        best = min(best, new.get(j - 1, k) + 1, row.get(j - 1, k + 1) + (value[j - 1] != c))
                        if j > 1 and before is not None and value[j - 2] == c and value[j - 1] == last:
                            best = min(best, before.get(j - 2, k) + 1)
                    if best <= k:
                        new[j] = best
                if new:
                    stack.append((child, new, row, c, depth + 1))


def core_words(text: str, group: str | None = None) -> list[str]:
    """The words of a body's name without codes, the group's own name and the words of its kind."""
    t = strip_notes(fold(text))
    t = re.sub(r"^\s*[\d-]+\s*[-:]?\s*|\s*\(\s*\d+\s*\)\s*$", " ", t)
    t = re.sub(r"^\s*[a-z]{2,6}\s+-\s+(?=[a-z]{3})", " ", t)
    if m := re.match(r"^\s*([^,]+?)\s*,\s*([^,]+?)\s*$", t):
        t = f"{m[2]} {m[1]}"
    w = [SHORT_FORMS.get(x, x) for x in words_of(t)]
    if len(w) > 2 and w[1] == "of" and any(edits(w[0], x, 2) <= (2 if len(x) > 5 else 1) for x in ("department", "office", "division", "board")):
        w = w[2:]
    if len(w) > 1 and len(w[-1]) > 6 and edits(w[-1], "department", 2) <= 2:
        w = w[:-1]
    own = words_of(fold(group)) if group else []
    changed = True
    while changed and w:
        changed = False
        while len(w) > 1 and w[0] in ("the", "of"):
            w, changed = w[1:], True
        if len(w) > 1 and own and w[: len(own)] == own:
            w, changed = w[len(own) :], True
        if len(w) > 1 and w[0] in KIND_BEFORE and (w[1] == "of" or w[0] in ("metro", "dept", "dpt")):
            w, changed = w[1:], True
        if len(w) > 1 and w[-1] in KIND_BEHIND:
            w, changed = w[:-1], True
    return w


def initials(words: list[str]) -> str:
    return "".join(w[0] for w in words if w not in JOINERS)


def alias_paths(name: str, group: str | None = None) -> Iterator[tuple[str, float]]:
    """(path, penalty) of the ways an entry is known."""
    core = core_words(name, group)
    yield "".join(words_of(fold(name))), 0.0
    yield "".join(core), 0.0
    forms = [core]
    if len(core) > 2 and core[-1] in KIND_LAST:
        forms.append(core[:-1])
        yield "".join(core[:-1]), 0.1
    if len(core) > 1 and core[-1] in KIND_LAST:
        forms.append(core[:-1]) if core[:-1] not in forms else None
    for f in forms:
        yield "".join(sorted(f)), 0.3
        plain = [w for w in f if w != "and"]
        yield "".join(reversed(plain)), 0.3
        yield "".join(plain), 0.1
        if "and" in f:
            k = f.index("and")
            yield "".join([*f[k + 1 :], "and", *f[:k]]), 0.2
        short = [skeleton(w) if len(w) > 4 else w for w in f]
        yield "".join(short), 0.4
        for i, w in enumerate(f):
            for s in {skeleton(w), w[:3], w[:4], w[:5]} - {w}:
                if len(w) > 4:
                    yield "".join([*f[:i], s, *f[i + 1 :]]), 0.4


class Canon:
    """One group's reference list: entry names, their trie, and their initials."""

    def __init__(self, entries: list[str], aliases: list[tuple[str, str]] = (), group: str | None = None, paths=alias_paths):
        self.entries = sorted(set(entries))
        self.group = group
        at = {e: k for k, e in enumerate(self.entries)}
        self.trie = Trie()
        self.short: dict[str, set[int]] = {}
        for e, k in at.items():
            for path, penalty in paths(e, group):
                if path:
                    self.trie.add(path, k, penalty)
            for words in (words_of(fold(e)), core_words(e, group)):
                if len(s := initials(words)) > 1:
                    self.short.setdefault(s, set()).add(k)
        for source, e in aliases:
            if e in at and len(path := "".join(core_words(source, group))) > 4:
                self.trie.add(path, at[e], 0.2)

    def hits(self, value) -> list[tuple[str, float]]:
        """(entry, score) of every entry within the allowed distance of a typed value."""
        if not isinstance(value, str):
            return []
        core = core_words(value, self.group)
        whole = "".join(core)
        if whole in NOTHING or not any(c.isalpha() for c in whole):
            return []
        best: dict[int, float] = {}

        def note(k: int, score: float) -> None:
            best[k] = min(score, best.get(k, score))

        letters = re.sub(r"[^a-z]", "", fold(value))
        if letters in NOTHING:
            return []
        if len(letters) <= 6 and " " not in fold(value).strip():
            for k in self.short.get(letters, ()):
                note(k, 0.05)
        if len(whole) > 3:
            plain = [w for w in core if w != "and"]
            for form, extra in {whole: 0.0, "".join(plain): 0.1, "".join(sorted(core)): 0.3}.items():
                for e, p, d in self.trie.search(form, allowed(len(form))):
                    note(e, d + max(p, 0.0) + extra)
        if not best and len(whole) >= 4:  # broken off: the value begins a path
            for e, p, d in self.trie.search(whole, 0 if len(whole) < 7 else 1, open_end=True):
                if p < 0:
                    note(e, d + 1.5)
        return [(self.entries[k], s) for k, s in best.items()]


def map_values(table: DataFrame, *, id_col: str, group_col: str, value_col: str, entry_col: str, shard: int = 4000, unmatched: str = "UNMATCHED") -> DataFrame:
    """(id, canonical, score) of every row of ``table`` without an entry: the entry of its group's list, else ``unmatched``.

    The rows with an entry are the reference list and its aliases.  ``shard`` bounds the entries and values of one task.
    """
    t = table.select(F.col(id_col).alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("g"), F.col(value_col).cast("string").alias("value"), F.col(entry_col).cast("string").alias("entry"))
    sizes = t.groupBy("g").agg(
        F.greatest(F.lit(1), F.ceil(F.count("entry") / shard)).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("entry").isNull(), 1)) / shard)).cast("int").alias("salts"),
    )
    t = t.join(sizes, "g")
    known = t.where("entry IS NOT NULL").select("g", "value", "entry", F.expr("pmod(xxhash64(entry), shards)").cast("int").alias("shard"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    asked = t.where("entry IS NULL").select(F.col("g").alias("ag"), F.col("id").alias("aid"), F.col("value").alias("avalue"), F.explode(F.expr("sequence(0, shards - 1)")).alias("ashard"), F.expr("pmod(xxhash64(id), salts)").cast("int").alias("asalt"))
    kind = table.schema[id_col].dataType.simpleString()

    def search(key, refs, values):
        import pandas as pd

        rows = []
        if len(refs) and len(values):
            canon = Canon(list(refs["entry"]), [(s, e) for s, e in zip(refs["value"], refs["entry"]) if isinstance(s, str)], key[0])
            known_hits: dict = {}
            for i, v in zip(values["aid"], values["avalue"]):
                if v not in known_hits:
                    known_hits[v] = canon.hits(v)
                rows += [(i, e, s) for e, s in known_hits[v]]
        return pd.DataFrame(rows, columns=["id", "entry", "score"])

    n = max(2, 2 * table.sparkSession.sparkContext.defaultParallelism)  # small rows, much work: partitions by count, not by size
    known, asked = known.repartition(n, "g", "shard", "salt"), asked.repartition(n, "ag", "ashard", "asalt")
    hits = known.groupBy("g", "shard", "salt").cogroup(asked.groupBy("ag", "ashard", "asalt")).applyInPandas(search, f"id {kind}, entry string, score double")
    per_entry = hits.groupBy("id", "entry").agg(F.min("score").alias("score"))
    least = per_entry.groupBy("id").agg(F.min("score").alias("score"), F.min_by("entry", "score").alias("entry"), F.collect_list("score").alias("scores"))
    won = least.where(F.size(F.filter("scores", lambda s: s == F.col("score"))) == 1).select("id", "entry", "score")
    return t.where("entry IS NULL").select("id").join(won, "id", "left").select(F.col("id").alias(id_col), F.coalesce("entry", F.lit(unmatched)).alias("canonical"), "score")


# ---- chains: values that begin with one of few prefixes, however they are typed ----


def chain_form(value: str) -> str:
    """A payee's name without store numbers, places and notes, as one run of letters and digits."""
    t = strip_notes(fold(value))
    t = re.sub(r"\s+-\s+[^-]*\(\s*\d+\s*\)\s*$", " ", t)
    t = re.sub(r"\b(?:store|shop|no\.?|nr\.?|unit|branch|location)\s*#?\s*\d+\s*$|#\s*\d*\s*$", " ", t)
    t = re.sub(r"\(\s*\d+\s*\)\s*$|(?<=[a-z.])\s+\d+\s*$|^\s*\d{2,}\s+(?=[a-z])", " ", t)
    w = words_of(re.sub(r"^\s*the\s+", "", t.strip()))
    return "".join(w)


class Chains:
    """Prefixes and labels of chains as one trie."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.labels: list[str] = []
        self.trie = Trie()
        for prefix, label in rows:
            if label not in self.labels:
                self.labels.append(label)
            k = self.labels.index(label)
            for name, penalty in ((prefix, 0.0), (label, 0.1)):
                if path := chain_form(name):
                    self.trie.add(path, k, penalty)
        self.alphabet = {p[:1] for p in self.trie.children}

    def scores(self, value) -> dict[str, float]:
        """The labels within the allowed distance, with their least score."""
        form = chain_form(value) if isinstance(value, str) else ""
        best: dict[str, float] = {}
        if len(form) >= 5:
            for e, p, d in self.trie.search(form, min(2, allowed(len(form)))):
                best[self.labels[e]] = min(d + p, best.get(self.labels[e], 9.0))
        return best

    def label(self, value) -> str | None:
        """The one label within the allowed distance, or none."""
        best = self.scores(value)
        low = min(best.values(), default=None)
        won = [k for k, s in best.items() if s == low]
        return won[0] if len(won) == 1 else None


def prefix_parts(chains: DataFrame, prefix_col: str, label_col: str, max_prefixes: int) -> list[DataFrame]:
    """The prefixes (p, c) in parts of about ``max_prefixes`` at most, by a hash of the prefix."""
    known = chains.select(F.col(prefix_col).cast("string").alias("p"), F.col(label_col).cast("string").alias("c")).where("p IS NOT NULL AND c IS NOT NULL").distinct()
    n = -(-known.count() // max(1, max_prefixes))
    return [known] if n <= 1 else [known.where(F.pmod(F.xxhash64("p"), F.lit(n)) == k) for k in range(n)]


def chain_labels(values: DataFrame, chains: DataFrame, prefix_col: str, label_col: str, max_prefixes: int) -> DataFrame:
    """(value, canonical) of the distinct ``values`` (one column ``value``) that are a chain.

    The prefixes are sent to the workers part by part; the least score over all parts wins, a tie of labels none.
    """
    scored = None
    for part in prefix_parts(chains, prefix_col, label_col, max_prefixes):
        rows = sorted((r["p"], r["c"]) for r in part.collect())  # about max_prefixes of them

        def run(frames, rows=rows):
            import pandas as pd

            c = Chains(rows)
            for pdf in frames:
                yield pd.DataFrame([(v, lab, s) for v in pdf["value"] for lab, s in c.scores(v).items()], columns=["value", "label", "score"])

        found = values.mapInPandas(run, "value string, label string, score double")
        scored = found if scored is None else scored.unionByName(found)
    per = scored.groupBy("value", "label").agg(F.min("score").alias("score")).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("score", "label"))).alias("s"))
    return per.where((F.size("s") == 1) | (F.col("s")[0]["score"] < F.get("s", F.lit(1))["score"])).select("value", F.col("s")[0]["label"].alias("canonical"))


def label_chains(lines: DataFrame, chains: DataFrame, *, id_col: str, value_col: str, prefix_col: str = "prefix", label_col: str = "canonical", max_prefixes: int = 100_000) -> DataFrame:
    """(id, canonical) of every line whose value is a chain in any spelling.

    Values are searched once each; about ``max_prefixes`` prefixes at most are sent to the workers at once, more of them
    in several parts.
    """
    lines = lines.select(F.col(id_col).alias("id"), F.col(value_col).cast("string").alias("value")).where("value IS NOT NULL")
    n = max(2, 2 * lines.sparkSession.sparkContext.defaultParallelism)  # the search is Python work: spread it, however small the values are
    labels = chain_labels(lines.select("value").distinct().repartition(n), chains, prefix_col, label_col, max_prefixes)
    return lines.join(labels, "value").select(F.col("id").alias(id_col), "canonical")
