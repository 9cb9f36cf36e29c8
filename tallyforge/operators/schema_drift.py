"""Schemas that drift between the files of a feed: changes from file to file, and one consistent table.

1. One pass over the records makes, per feed, file and field, a profile of bounded size: counts of JSON kinds and of
   value classes (date, year, money, integer, code, text), and bottom-k sketches of values and of words.  Partial
   profiles are made per partition and merged in two steps, so a file or feed with a third of all records is only merged
   as a few sketches.
2. Per feed, neighbouring files are matched by similarity flooding.  Each schema is a graph: fields with their name
   tokens, their values, their value classes, the object they are nested in and their neighbours in the record.  Pairs of
   nodes of both graphs are the propagation graph; it starts with what is known of tokens, values and classes, and
   scores flow between the pairs until they converge.  A field pair itself starts with its name alone: what its
   values, types, nesting and neighbours say reaches it by the flow.  Fields that keep their name anchor the flow.  A
   rename is a pair of a field that went and one that came with a converged score of at least ``ACCEPT``, selected so
   that no field is used twice and no two left over like each other better (stable matching).
3. Each field's names over time form a lineage; lineages are matched against the target schema, and records are cast
   and united.

Defined results: records that are null or no JSON object carry no fields; a field that is null everywhere keeps the
kind and the profile it had; ties in the kind keep the kind before, else string before decimal before integer; repeated
records count as often as they come; a feed of one file and an empty table give no changes; a nested object is a field of
kind ``nested``, and the fields inside of it are fields too, named by their path (``a.b``); lists are values.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import spread

SKETCH = 64
KINDS = ("string", "decimal", "integer", "nested")
CLASSES = ("date", "year", "money", "int", "code", "text", "nested")
PROFILE = "feed string, file_seq int, file_name string, field string, pos double, n long, kinds array<long>, classes array<long>, log_sum double, log_n long, vals array<long>, words array<long>"
_MONEY = re.compile(r"^\(?-?\$?\s*-?[\d,]*\.?\d+\)?-?$")
_ISO = re.compile(r"^(\d{4})-(\d\d)-(\d\d)(?:[T ].*)?$")
_US = re.compile(r"^(\d{1,2})/(\d{1,2})/(\d{4})$")
_YEARS = re.compile(r"^(?:FY\s*)?((?:19|20)\d\d)(?:\s*[-/]\s*(?:(?:19|20)?\d\d))?$", re.I)
DAY_MS = 86_400_000


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def classify(value) -> tuple[str, str]:
    """(class, canonical text) of a JSON value: the same date, year or amount written in another way is the same text."""
    if isinstance(value, bool):
        return "text", str(value).lower()
    if isinstance(value, (dict, list)):
        return "nested", json.dumps(value, sort_keys=True)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and not math.isfinite(value):
            return "text", str(value)
        if 1e11 < abs(value) < 5e12 and float(value).is_integer():
            return "date", _day(int(value))
        if 1900 <= value <= 2100 and float(value).is_integer():
            return "year", str(int(value))
        return ("int", str(value)) if isinstance(value, int) else ("money", f"{value:.2f}")
    s = " ".join(str(value).split())
    if m := _ISO.match(s):
        return "date", f"{m[1]}-{m[2]}-{m[3]}"
    if m := _US.match(s):
        return "date", f"{m[3]}-{int(m[1]):02d}-{int(m[2]):02d}"
    if m := _YEARS.match(s):
        return "year", m[1]
    if s.isdigit():
        return "int", s
    if _MONEY.match(s) and any(c.isdigit() for c in s):
        x = parse_money(s)
        return ("money", f"{x:.2f}") if x is not None else ("code", s)
    low = s.casefold()
    return ("code" if any(c.isdigit() for c in s) and " " not in s else "text"), low


def parse_money(s: str) -> float | None:
    neg = s.startswith("(") and s.endswith(")") or s.strip("$ ").startswith("-") or s.endswith("-")
    try:
        x = float(re.sub(r"[^\d.]", "", s))
    except ValueError:
        return None
    return -x if neg else x


def _day(ms: int) -> str:
    import datetime as dt

    try:
        return (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)).date().isoformat()
    except OverflowError:
        return str(ms)


def _kind(value) -> int | None:
    if value is None:
        return None
    if isinstance(value, (dict, list)):
        return 3
    if isinstance(value, bool) or isinstance(value, str):
        return 0
    return 1 if isinstance(value, float) else 2


def parse_record(text) -> dict:
    """The object of a record; anything else has no fields."""
    try:
        o = json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return {}
    return o if isinstance(o, dict) else {}


def flat(o: dict, prefix: str = "", depth: int = 8) -> dict:
    """The fields of an object, those of nested objects by their path behind their own."""
    out = {}
    for k, v in o.items():
        out[prefix + k] = v
        if isinstance(v, dict) and depth:
            out |= flat(v, f"{prefix}{k}.", depth - 1)
    return out


_WORDS = re.compile(r"[^\W\d_]+")


def traits(value) -> tuple[int, int, float | None, int, tuple[int, ...]]:
    """(kind, class, logarithm of an amount, hash of the value, hashes of its words)."""
    cls, canon = classify(value)
    size = math.log10(abs(x)) if cls == "money" and (x := float(canon)) else None
    return _kind(value), CLASSES.index(cls), size, _hash(canon), tuple(_hash(w) for w in _WORDS.findall(canon)) if cls in ("text", "code", "nested") else ()


class Tally:
    """What is counted of one field; sketches hold the least hashes."""

    __slots__ = ("pos", "n", "kinds", "classes", "log_sum", "log_n", "vals", "words", "cut_v", "cut_w")

    def __init__(self):
        self.pos, self.n, self.log_sum, self.log_n = 0.0, 0, 0.0, 0
        self.kinds, self.classes = [0] * len(KINDS), [0] * len(CLASSES)
        self.vals: set[int] = set()
        self.words: set[int] = set()
        self.cut_v = self.cut_w = 1 << 63

    def add(self, t: tuple) -> None:
        kind, cls, size, value, words = t
        self.kinds[kind] += 1
        self.classes[cls] += 1
        if size is not None:
            self.log_sum += size
            self.log_n += 1
        if value < self.cut_v:
            self.vals.add(value)
            if len(self.vals) >= 4 * SKETCH:
                self.vals = set(sorted(self.vals)[:SKETCH])
                self.cut_v = max(self.vals)
        for w in words:
            if w < self.cut_w:
                self.words.add(w)
                if len(self.words) >= 4 * SKETCH:
                    self.words = set(sorted(self.words)[:SKETCH])
                    self.cut_w = max(self.words)

    def row(self) -> tuple:
        return self.pos, self.n, self.kinds, self.classes, self.log_sum, self.log_n, sorted(self.vals)[:SKETCH], sorted(self.words)[:SKETCH]


def profiles(records: DataFrame) -> DataFrame:
    """One profile per feed, file and field of ``records`` (feed, file_name, file_seq, record)."""

    def run(frames):
        acc: dict[tuple, Tally] = {}
        seen: dict = {}
        for pdf in frames:
            for feed, name, seq, rec in zip(pdf["feed"], pdf["file_name"], pdf["file_seq"], pdf["record"]):
                for k, (f, v) in enumerate(flat(parse_record(rec)).items()):
                    key = (feed, seq, name, f)
                    a = acc.get(key)
                    if a is None:
                        a = acc[key] = Tally()
                    a.pos += k
                    a.n += 1
                    if v is None:
                        continue
                    if isinstance(v, (dict, list)):
                        a.add(traits(v))
                        continue
                    t = seen.get((type(v), v))
                    if t is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        t = seen[(type(v), v)] = traits(v)
                    a.add(t)
            if len(acc) > 20_000:
                yield _rows(acc)
                acc = {}
        if acc:
            yield _rows(acc)

    def _rows(acc):
        import pandas as pd

        return pd.DataFrame([(*k, *a.row()) for k, a in acc.items()], columns=["feed", "file_seq", "file_name", "field", "pos", "n", "kinds", "classes", "log_sum", "log_n", "vals", "words"])

    parts = spread(records.select("feed", "file_name", F.col("file_seq").cast("int"), "record").where("feed IS NOT NULL AND file_seq IS NOT NULL")).mapInPandas(run, PROFILE)
    keys = ["feed", "file_seq", "file_name", "field"]

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        vec = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)
        low = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, SKETCH).alias(c)
        return df.groupBy(*by).agg(
            F.sum("pos").alias("pos"), F.sum("n").alias("n"), vec("kinds", len(KINDS)), vec("classes", len(CLASSES)), F.sum("log_sum").alias("log_sum"), F.sum("log_n").alias("log_n"), low("vals"), low("words")
        )

    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    return merged(merged(salted, [*keys, "salt"]), keys)


# ---- matching on the driver side of a feed (plain Python over profiles of bounded size) ----


@dataclass
class Field:
    name: str
    pos: float
    kind: str | None
    classes: list[int]
    log_mean: float | None
    vals: set = field(default_factory=set)
    words: set = field(default_factory=set)

    @property
    def filled(self) -> int:
        return sum(self.classes)


def name_tokens(name: str) -> list[str]:
    parts = re.sub(r"([a-z\d])([A-Z])", r"\1 \2", name)
    parts = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", parts)
    return [t for t in re.split(r"[^a-z]+", parts.lower()) if t]


def _short_for(a: str, b: str) -> bool:
    """Whether the shorter word abbreviates the longer: same first letter, its letters in order."""
    a, b = sorted((a, b), key=len)
    if not a or a[0] != b[0] or len(a) < 2:
        return False
    it = iter(b)
    return all(c in it for c in a)


def token_sim(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a.startswith(b) or b.startswith(a):
        return 0.85
    return 0.75 if _short_for(a, b) else 0.0


def name_sim(a: str, b: str) -> float:
    if a.casefold() == b.casefold():
        return 1.0
    ta, tb = name_tokens(a), name_tokens(b)
    if not ta or not tb:
        return 0.0
    best = [max(token_sim(x, y) for y in tb) for x in ta], [max(token_sim(x, y) for x in ta) for y in tb]
    return (sum(best[0]) / len(ta) + sum(best[1]) / len(tb)) / 2


def overlap(a: set, b: set) -> float:
    """Shared part of the smaller set, from bottom-k sketches: only hashes below the smaller sketch's reach compare."""
    if not a or not b:
        return 0.0
    reach = min(max(s) if len(s) >= SKETCH else math.inf for s in (a, b))
    x, y = {h for h in a if h <= reach}, {h for h in b if h <= reach}
    return len(x & y) / max(1, min(len(x), len(y)))


def value_sim(a: Field, b: Field) -> float | None:
    """How alike the values are, in [0, 1]; None if one of the fields has no values."""
    if not a.filled or not b.filled:
        return None
    ha, hb = ([c / f.filled for c in f.classes] for f in (a, b))
    ints = CLASSES.index("int")
    money = CLASSES.index("money")
    shared = sum(map(min, ha, hb))
    if ha[money] > 0.5 and hb[ints] > 0.5 or hb[money] > 0.5 and ha[ints] > 0.5:
        shared = max(shared, 0.5)
    top = CLASSES[max(range(len(CLASSES)), key=lambda i: ha[i] + hb[i])]
    vals, words = overlap(a.vals, b.vals), overlap(a.words, b.words)
    if top == "text":
        # two columns of mostly different texts (names) may share few words and still be one field
        spread = min(len(f.vals) / min(SKETCH, f.filled) for f in (a, b))
        return shared * min(1.0, max(words, vals * 2, 0.45 if spread >= 0.5 else 0.0))
    if top == "code":
        return shared * min(1.0, 0.6 + max(words * 0.4, vals * 3))
    if top == "money" and a.log_mean is not None and b.log_mean is not None:
        near = max(0.0, 1 - abs(a.log_mean - b.log_mean))
        return shared * min(1.0, 0.45 + 0.35 * near + vals * 3)
    return shared * min(1.0, 0.65 + vals * 3)


#: Weights with which a field pair takes scores from pairs of values, name tokens, value classes, parents and neighbours.
FLOW = {"values": 0.6, "names": 0.2, "classes": 0.1, "parents": 0.04, "order": 0.06}
#: How much of a pair's score comes by the flow, the rest is what it starts with.
DAMPING = 0.3
#: The converged score from which a field that went and one that came are one.
ACCEPT = 0.37


def _members(lists: list[list], items: list) -> np.ndarray:
    """Fields x items, 1 where the field has the item."""
    at = {x: k for k, x in enumerate(items)}
    out = np.zeros((len(lists), len(items)))
    for i, xs in enumerate(lists):
        for x in xs:
            out[i, at[x]] = 1.0
    return out


def _best(tokens: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fields x fields: how well the tokens of each find a partner among the other's, mean of both directions."""
    to_right = np.stack([tokens[:, r > 0].max(axis=1) if (r > 0).any() else np.zeros(len(tokens)) for r in right], axis=1)
    to_left = np.stack([tokens[x > 0].max(axis=0) if (x > 0).any() else np.zeros(tokens.shape[1]) for x in left], axis=0)
    nl, nr = np.maximum(left.sum(axis=1), 1)[:, None], np.maximum(right.sum(axis=1), 1)[None, :]
    return ((left @ to_right) / nl + (to_left @ right.T) / nr) / 2


def parent_of(name: str) -> str:
    return name.rpartition(".")[0]


def flood(left: list[Field], right: list[Field], rounds: int = 60, eps: float = 1e-3) -> np.ndarray:
    """Similarity flooding over two schema graphs: the converged score in [0, 1] of every pair of their fields.

    ``rounds`` 0 gives what the field pairs start with, their names.
    """
    nl, nr = len(left), len(right)
    if not nl or not nr:
        return np.zeros((nl, nr))
    words_l, words_r = [name_tokens(f.name) for f in left], [name_tokens(f.name) for f in right]
    all_l, all_r = (sorted({w for ws in x for w in ws}) for x in (words_l, words_r))
    in_l, in_r = _members(words_l, all_l), _members(words_r, all_r)
    token0 = np.array([[token_sim(x, y) for y in all_r] for x in all_l]).reshape(len(all_l), len(all_r))
    value0 = np.array([[-1.0 if (v := value_sim(a, b)) is None else v for b in right] for a in left]).reshape(nl, nr)
    valued = value0 >= 0
    hist_l, hist_r = (np.array([[c / max(1, f.filled) for c in f.classes] for f in x]).reshape(len(x), len(CLASSES)) for x in (left, right))
    par_l, par_r = [parent_of(f.name) for f in left], [parent_of(f.name) for f in right]
    ups_l, ups_r = sorted(set(par_l)), sorted(set(par_r))
    up_l, up_r = _members([[x] for x in par_l], ups_l), _members([[x] for x in par_r], ups_r)
    parent0 = np.array([[1.0 if x == y else 0.5 * name_sim(x, y) if x and y else 0.0 for y in ups_r] for x in ups_l])
    next_l, next_r = (np.argsort([f.pos for f in x], kind="stable") for x in (left, right))
    # a field that keeps its name is known to go on: its pair stays 1, and its row and column 0 else
    at = {f.name: j for j, f in enumerate(right)}
    same = [(i, at[f.name]) for i, f in enumerate(left) if f.name in at]
    fixed_i, fixed_j = [i for i, _ in same], [j for _, j in same]

    def anchored(x: np.ndarray) -> np.ndarray:
        x[fixed_i, :] = 0.0
        x[:, fixed_j] = 0.0
        x[fixed_i, fixed_j] = 1.0
        return x

    weight = np.where(valued, sum(FLOW.values()), sum(FLOW.values()) - FLOW["values"] - FLOW["classes"])
    tokens, classes, parents, values = token0, np.eye(len(CLASSES)), parent0, np.where(valued, value0, 0.0)
    score = anchored(_best(tokens, in_l, in_r) if token0.size else np.zeros((nl, nr)))
    share_t, share_c, share_p = np.maximum(in_l.T @ np.ones((nl, nr)) @ in_r, 1), np.maximum(hist_l.T @ np.ones((nl, nr)) @ hist_r, 1e-9), np.maximum(np.minimum(up_l.sum(axis=0)[:, None], up_r.sum(axis=0)[None, :]), 1)
    for _ in range(rounds):
        # from field pairs to the pairs of what they have
        tokens = np.maximum(token0, (1 - DAMPING) * token0 + DAMPING * (in_l.T @ score @ in_r) / share_t)
        classes = (1 - DAMPING) * np.eye(len(CLASSES)) + DAMPING * (hist_l.T @ score @ hist_r) / share_c
        parents = (1 - DAMPING) * parent0 + DAMPING * np.minimum(1.0, (up_l.T @ score @ up_r) / share_p)
        values = np.where(valued, (1 - DAMPING) * value0 + DAMPING * score, 0.0)
        # and back
        near = np.zeros((nl, nr))
        by_order = score[np.ix_(next_l, next_r)]
        if nl > 1 and nr > 1:
            around = np.zeros((nl, nr))
            around[1:, 1:] += by_order[:-1, :-1]
            around[:-1, :-1] += by_order[1:, 1:]
            near[np.ix_(next_l, next_r)] = around / 2
        names = _best(tokens, in_l, in_r) if token0.size else np.zeros((nl, nr))
        flow = FLOW["values"] * values + FLOW["names"] * names + np.where(valued, FLOW["classes"] * (hist_l @ classes @ hist_r.T), 0.0) + FLOW["parents"] * (up_l @ parents @ up_r.T) + FLOW["order"] * near
        new = anchored(flow / weight)
        done = np.abs(new - score).max(initial=0.0) < eps
        score = new
        if done:
            break
    return score


def match_renames(before: list[Field], after: list[Field], accept: float = ACCEPT, rounds: int = 60) -> list[tuple[str, str]]:
    """(old, new) of the fields that go on under another name; a name that only changes its case goes on."""
    names_b, names_a = {f.name for f in before}, {f.name for f in after}
    gone, came = [k for k, f in enumerate(before) if f.name not in names_a], [k for k, f in enumerate(after) if f.name not in names_b]
    if not gone or not came:
        return []
    score = flood(before, after, rounds)
    ranked = []
    for i in gone:
        for j in came:
            same = before[i].name.casefold() == after[j].name.casefold()
            if same or score[i, j] >= accept:
                ranked.append((not same, -score[i, j], before[i].name, after[j].name))
    used: set = set()
    out = []
    for _, _, g, c in sorted(ranked):
        if ("l", g) not in used and ("r", c) not in used:
            used |= {("l", g), ("r", c)}
            out.append((g, c))
    return out


def _as_field(r) -> Field:
    kinds = [int(k) for k in r.kinds]
    top = max(kinds)
    kind = None
    if top:
        kind = KINDS[kinds.index(top)]
    return Field(r.field, r.pos / max(1, r.n), kind, [int(c) for c in r.classes], r.log_sum / r.log_n if r.log_n else None, set(r.vals.tolist()), set(r.words.tolist()))


def feed_changes(pdf) -> list[tuple]:
    """Rows (feed, file_name, change, from, to, file_seq) of one feed's profiles, in the order of its files."""
    by_file: dict[tuple, list] = {}
    for r in pdf.itertuples(index=False):
        by_file.setdefault((r.file_seq, r.file_name), []).append(r)
    files = [(*k, [_as_field(r) for r in rows], {r.field: [int(x) for x in r.kinds] for r in rows}) for k, rows in sorted(by_file.items(), key=lambda x: x[0])]
    out: list[tuple] = []
    state: dict[str, Field] = {}
    feed = pdf["feed"].iloc[0] if len(pdf) else None
    for k, (seq, name, fields, kinds) in enumerate(files):
        now = []
        for f in fields:
            if not f.filled:  # borrow the values the same name has in the nearest later file
                later = next((x for _, _, fs, _ in files[k + 1 :] for x in fs if x.name == f.name and x.filled), None)
                f = Field(f.name, f.pos, None, later.classes, later.log_mean, later.vals, later.words) if later and f.name not in state else f
            now.append(f)
        if k == 0:
            state = {f.name: f for f in now}
            continue
        renames = match_renames(list(state.values()), now)
        old_of = {c: g for g, c in renames}
        news: dict[str, Field] = {}
        have = {f.name for f in now}
        for f in now:
            old = state.get(f.name) or state.get(old_of.get(f.name, ""))
            if f.name in old_of:
                out.append((feed, name, "renamed", old_of[f.name], f.name, seq))
            elif f.name not in state:
                out.append((feed, name, "added", "", f.name, seq))
            own = kinds[f.name]
            kind = f.kind
            if old is not None:
                if not any(own):
                    kind = old.kind
                elif old.kind and own[KINDS.index(old.kind)] == max(own):
                    kind = old.kind
                if old.kind and kind and kind != old.kind:
                    out.append((feed, name, "retyped", old.name, f.name, seq))
                if not f.filled or not any(own):
                    f = Field(f.name, f.pos, kind, old.classes, old.log_mean, old.vals, old.words)
            news[f.name] = Field(f.name, f.pos, kind, f.classes, f.log_mean, f.vals, f.words)
        for g in state:
            if g not in have and g not in old_of.values():
                out.append((feed, name, "removed", g, "", seq))
        state = news
    return out


def changes(records: DataFrame) -> DataFrame:
    """(feed, file_name, change, field_from, field_to, file_seq) of every change between neighbouring files of a feed."""

    def run(pdf):
        import pandas as pd

        return pd.DataFrame(feed_changes(pdf), columns=["feed", "file_name", "change", "field_from", "field_to", "file_seq"])

    return profiles(records).groupBy("feed").applyInPandas(run, "feed string, file_name string, change string, field_from string, field_to string, file_seq int")


# ---- one consistent table ----


@dataclass(frozen=True)
class Target:
    """A column of the consistent table: the names it is known under elsewhere and the classes its values may have."""

    name: str
    known: tuple[str, ...]
    classes: tuple[str, ...]
    type: str


LEDGER = (
    Target("fiscal_year", ("fiscal_year", "budget_year", "FY"), ("year",), "int"),
    Target("extended_amount", ("extended_amount", "distribution_amount", "line_amount", "amount"), ("money", "int"), "double"),
    Target("invoice_amount", ("invoice_amount", "invoice_total"), ("money", "int"), "double"),
    Target("invoice_number", ("invoice_number", "invoice_id", "invoice_no"), ("code", "int"), "string"),
    Target("payee", ("payee", "vendor_name", "supplier_name"), ("text",), "string"),
    Target("agency", ("agency_name", "agency", "dept", "dept_desc", "department_description"), ("text",), "string"),
    Target("payment_date", ("payment_date", "check_date", "record_date", "paid_on"), ("date",), "date"),
)


def lineages(pdf) -> list[list[tuple[str, str]]]:
    """Each field's (file_name, name) over the files of a feed."""
    rows = feed_changes(pdf)
    ren = {(r[1], r[4]): r[3] for r in rows if r[2] == "renamed"}
    out: list[list[tuple[str, str]]] = []
    state: dict[str, list] = {}
    by_file: dict[tuple, list] = {}
    for seq, name, f in zip(pdf["file_seq"], pdf["file_name"], pdf["field"]):
        by_file.setdefault((seq, name), []).append(f)
    for (_, name), fields in sorted(by_file.items()):
        now = {}
        for f in fields:
            line = state.get(ren.get((name, f), f))
            if line is None:
                line = []
                out.append(line)
            line.append((name, f))
            now[f] = line
        state = now
    return out


def feed_mapping(pdf, targets: tuple[Target, ...] = LEDGER) -> list[tuple]:
    """(feed, file_name, field, target) of one feed; a target takes at most one lineage of each file."""
    feed = pdf["feed"].iloc[0]
    prof = {(r.file_name, r.field): r for r in pdf.itertuples(index=False)}
    scored = []
    lines = lineages(pdf)
    for k, line in enumerate(lines):
        classes = [sum(int(prof[x].classes[i]) for x in line) for i in range(len(CLASSES))]
        total = sum(classes)
        for t in targets:
            share = sum(classes[CLASSES.index(c)] for c in t.classes) / total if total else 0.0
            name = max(name_sim(f, n) for _, f in line for n in t.known)
            if share >= 0.5 and name >= 0.5:
                scored.append((name + 0.2 * share, k, t.name))
    taken: set = set()
    out = []
    for _, k, t in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if ("l", k) in taken or any((f, t) in taken for f, _ in lines[k]):
            continue
        taken |= {("l", k), *((f, t) for f, _ in lines[k])}
        out += [(feed, f, n, t) for f, n in lines[k]]
    return out


def unify(records: DataFrame, keep: list[str], targets: tuple[Target, ...] = LEDGER) -> DataFrame:
    """All records as one table: ``keep`` columns, the targets cast to their types, and the rest as JSON text ``others``."""

    def mapping(pdf):
        import pandas as pd

        return pd.DataFrame(feed_mapping(pdf, targets), columns=["feed", "file_name", "field", "target"])

    maps = profiles(records).groupBy("feed").applyInPandas(mapping, "feed string, file_name string, field string, target string")
    per_file = maps.groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "target"))).alias("names"))
    kept = records.select(*dict.fromkeys([*keep, "feed", "file_name", "record"]))
    joined = kept.join(per_file, ["feed", "file_name"], "left").select(*keep, F.col("record").alias("_record"), F.col("names").alias("_names"))
    kinds = {"int": "int", "double": "double", "string": "string", "date": "string"}
    schema = ", ".join([*(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in keep), *(f"{t.name} {kinds[t.type]}" for t in targets), "others string"])

    def run(frames):
        import pandas as pd

        for pdf in frames:
            cols: dict[str, list] = {t.name: [] for t in targets}
            rest = []
            for rec, names in zip(pdf["_record"], pdf["_names"]):
                o, m = flat(parse_record(rec)), dict(names) if names is not None else {}
                got = {m[k]: v for k, v in o.items() if k in m}
                for t in targets:
                    cols[t.name].append(cast_value(got.get(t.name), t.type))
                rest.append(json.dumps({k: v for k, v in sorted(o.items()) if k not in m and not (parent_of(k) and parent_of(k) not in m)}, ensure_ascii=False))
            out = pdf[keep].copy()
            for t in targets:
                out[t.name] = pd.array(cols[t.name], dtype="Int32") if t.type == "int" else pd.Series(cols[t.name], index=out.index, dtype="object" if t.type != "double" else "float64")
            out["others"] = rest
            yield out

    return joined.mapInPandas(run, schema)


def cast_value(v, kind: str):
    """``v`` in the type of its target; what can't be read in it is null."""
    if v is None:
        return None
    cls, canon = classify(v)
    if kind == "int":
        return int(canon) if cls in ("year", "int") and len(canon) < 10 else None
    if kind == "double":
        try:
            return float(canon) if cls in ("money", "int", "year") else None
        except ValueError:
            return None
    if kind == "date":
        return canon if cls == "date" else None
    return " ".join(str(v).split()) if not isinstance(v, (dict, list)) else json.dumps(v, sort_keys=True)
