"""Evaluation items that leak into a corpus.

The normalised words of all items form one generalised suffix automaton.  Each document's words are streamed through
it; at every word the automaton holds the longest run that some item also holds, and its suffix links lead to the
shorter runs of further items, so that each item has its own maximal runs.  A run of ``passage`` words leaks at once,
unless stock phrases (6 words or more that 4 items hold) of up to ``stock_phrase`` words cover all of it, or a longer
one, itself no passage, leaves fewer than ``passage - stock_phrase`` other words.  Items of which shorter runs cover enough are compared exactly: the share of
the item's words, weighted by how few items have them, that the document holds in such runs or beside them.

Normalisation: mark-up removed, compatibility forms and case folded, accents, invisible characters and punctuation
removed, look-alike letters replaced; white space parts words.

The automaton grows with the words of the items, not the corpus: which items hold a state is one interval of the
order in which the tree of suffix links is walked, not a list per state.  The items are an evaluation set that the
driver holds; a worker gets at most ``max_item_words`` words of them at once, and more items are searched in several
passes over parts of them.  Weights and stock phrases are those of all items in every pass, so the rows are the same.

Defined results: null, empty and blank texts leak nothing; items without words are found nowhere; equal items are each
reported; repeated documents give each pair once; an empty table on either side gives no rows; only the id and text
columns are read; texts are searched whole.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import spread

#: Letters that look like Latin ones (fixed values).
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
_LOOK = str.maketrans(LOOK_ALIKES)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_NOT_WORD = re.compile(r"[^a-z0-9ß-\U0010ffff]+")


def words(text) -> list[str]:
    """The normalised words of a text."""
    if not isinstance(text, str) or not text:
        return []
    t = _TAG.sub(" ", text)
    if "&" in t:
        t = html.unescape(t)
    t = t.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", t).casefold())
        t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Me", "Cf", "Cc") or c in "\t\n\r\x0b\x0c").translate(_LOOK)
        return [w for p in t.split() if (w := "".join(c for c in p if c.isalnum()))]
    return [w for p in t.split() if (w := _NOT_WORD.sub("", p))]


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; ``mask(s)`` has the bits of the items that hold state s."""

    def __init__(self, items: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []  # (state of a prefix, item)
        for k, seq in enumerate(items):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                ends.append((last, k))
        self._number(ends)

    def _number(self, ends: list[tuple[int, int]]) -> None:
        """Puts the items of prefixes in the order of a walk over the suffix links: a state's items are one interval."""
        n = len(self.link)
        below = np.zeros(n + 1, np.int64)
        for s, _ in ends:
            below[s] += 1
        by_length = sorted(range(1, n), key=self.length.__getitem__, reverse=True)
        for s in by_length:
            below[self.link[s]] += below[s]
        own = below.copy()
        for s in by_length:
            own[self.link[s]] -= below[s]
        self.first, self.size = np.zeros(n, np.int64), below[:n]
        free = own.copy()  # where the next child's interval begins, behind the state's own prefixes
        for s in reversed(by_length):
            p = self.link[s]
            self.first[s] = self.first[p] + free[p]
            free[p] += below[s]
        self.order = np.zeros(len(ends), np.int32)
        put = self.first.copy()
        for s, k in ends:
            self.order[put[s]] = k
            put[s] += 1
        self.known: dict[int, int] = {}

    def mask(self, s: int) -> int:
        m = self.known.get(s)
        if m is None:
            if len(self.known) >= 20_000:
                self.known.clear()
            m = 0
            for k in np.unique(self.order[self.first[s] : self.first[s] + self.size[s]]).tolist():
                m |= 1 << k
            self.known[s] = m
        return m

    def _new(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: str, q: int) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def runs(self, seq: list[str], least: int):
        """Maximal runs (start, end, mask of items) of at least ``least`` words that seq shares with items."""
        s = n = 0
        nxt, link, length = self.next, self.link, self.length
        for i, w in enumerate(seq):
            if (t := nxt[s].get(w)) is not None:
                s, n = t, n + 1
                continue
            if n >= least:
                yield i - n, i, self.mask(s)
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(w)
            s, n = (t, n + 1) if t is not None else (0, 0)
        if n >= least:
            yield len(seq) - n, len(seq), self.mask(s)

    def held(self, seq: list[str], least: int):
        """For each word of seq: {length: mask of the items whose longest run that ends here is so long}, from ``least`` words."""
        s = n = 0
        nxt, link, length = self.next, self.link, self.length
        for w in seq:
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(w)
            s, n = (t, n + 1) if t is not None else (0, 0)
            at, x, m, seen = {}, s, n, 0
            while m >= least:
                if own := self.mask(x) & ~seen:
                    at[m] = own
                    seen |= own
                x = link[x]
                m = length[x]
            yield at

    def item_runs(self, seq: list[str], least: int):
        """Each item's own maximal runs (start, end, mask of items) of at least ``least`` words that seq shares with it."""
        before: dict[int, int] = {}
        i = 0
        for i, at in enumerate(self.held(seq, least)):
            for n, mask in before.items():
                if ended := mask & ~at.get(n + 1, 0):
                    yield i - n, i, ended
            before = at
        for n, mask in before.items():
            yield i + 1 - n, i + 1, mask


def _bits(mask: int):
    """The numbers of the bits that are set."""
    while mask:
        yield (mask & -mask).bit_length() - 1
        mask &= mask - 1


STOCK_WORDS, STOCK_ITEMS = 6, 4


class Common:
    """What the items have in common: weights of their words, and their stock phrases as an automaton of their own.

    A stock phrase is a run of ``STOCK_WORDS`` words or more that ``STOCK_ITEMS`` items hold; only the parts of the items
    that such runs cover are kept.
    """

    def __init__(self, seqs: list[list[str]]):
        df = Counter(w for s in seqs for w in set(s))
        self.weight = {w: math.log((len(seqs) + 1) / c) for w, c in df.items()}
        held = Counter(g for s in seqs for g in {tuple(s[i : i + STOCK_WORDS]) for i in range(len(s) - STOCK_WORDS + 1)})
        self.grams = {g for g, n in held.items() if n >= STOCK_ITEMS}
        parts: list[list[str]] = []
        for s in seqs:
            parts.append([w if x else "\n" for w, x in zip(s, self.covered(s))])  # no text has such a word
        self.auto = SuffixAutomaton(parts)

    def covered(self, seq: list[str]) -> list[bool]:
        """Which words of an item belong to stock phrases."""
        out = [False] * len(seq)
        for i in range(len(seq) - STOCK_WORDS + 1):
            if tuple(seq[i : i + STOCK_WORDS]) in self.grams:
                out[i : i + STOCK_WORDS] = [True] * STOCK_WORDS
        return out


class LeakIndex:
    """The items, their automaton and their words' weights; ``common`` is of more items if these are a part of them."""

    def __init__(self, items: list[tuple[int, str]], passage: int = 18, least_run: int = 3, cover: float = 0.3, share: float = 0.62, stock_phrase: int = 12, shortest_longest: int = 5, common: Common | None = None):
        seqs = [(i, words(t)) for i, t in items]
        self.ids = [i for i, s in seqs if s]
        self.seqs = [s for _, s in seqs if s]
        self.passage, self.least_run, self.cover, self.share, self.stock_phrase = passage, least_run, cover, share, stock_phrase
        self.shortest_longest = shortest_longest
        self.least_whole = max(least_run, min([passage, *map(len, self.seqs)]))
        self.common = common or Common(self.seqs)
        self.weight = self.common.weight
        self.auto = SuffixAutomaton(self.seqs)
        self.bags = [Counter(w for w, x in zip(s, self.common.covered(s)) if not x) for s in self.seqs]
        self.totals = [sum(self.weight[w] * c for w, c in b.items()) or 1.0 for b in self.bags]

    def find(self, text) -> dict[int, tuple[int, float]]:
        """Item id -> (longest run, weighted share) of the items that leak into a text."""
        seq = words(text)
        longest: dict[int, int] = {}
        covered: dict[int, int] = {}
        phrases = None
        for a, b, mask in self.auto.runs(seq, self.least_run):
            if b - a >= self.least_whole:
                phrases = self._phrases(seq) if phrases is None else phrases
            n = self.passage - 1 if b - a >= self.passage and self._only_stock(a, b, phrases) else b - a
            for k in _bits(mask):
                longest[k] = max(longest.get(k, 0), n)
                covered[k] = covered.get(k, 0) + n
        if phrases is not None:  # passages and whole items that lie inside a longer run of another item
            for a, b, mask in self.auto.item_runs(seq, self.least_whole):
                for k in _bits(mask):
                    if b - a >= len(self.seqs[k]) or b - a >= self.passage:
                        n = self.passage - 1 if b - a >= self.passage and self._only_stock(a, b, phrases) else b - a
                        longest[k] = max(longest.get(k, 0), n)
        out = {}
        bag = None
        for k, n in longest.items():
            full = len(self.seqs[k])
            if n >= self.passage or n >= full:
                out[self.ids[k]] = (n, 1.0 if n >= full else self._share(k, bag := bag or Counter(seq)))
            elif n >= self.shortest_longest and covered.get(k, 0) >= self.cover * full:
                s = self._share(k, bag := bag or Counter(seq))
                if s >= self.share:
                    out[self.ids[k]] = (n, s)
        return out

    def _phrases(self, seq: list[str]) -> list[tuple[int, int]]:
        """A document's stock phrases (start, end): maximal ones that are no passage."""
        out = []
        before = 0
        for i, at in enumerate([*self.common.auto.held(seq, STOCK_WORDS), {}]):
            now = mask = 0
            for n, own in at.items():  # the longest first
                mask |= own
                if mask.bit_count() >= STOCK_ITEMS:
                    now = n
                    break
            if now != before + 1 and STOCK_WORDS <= before < self.passage:
                out.append((i - before, i))
            before = now
        return out

    def _only_stock(self, a: int, b: int, phrases: list[tuple[int, int]]) -> bool:
        """Whether a run is made of stock phrases alone, or of one longer phrase with too few words beside it."""
        own = set(range(a, b))
        for x, y in phrases:
            n = min(y, b) - max(x, a)
            if n > self.stock_phrase and b - a - n < self.passage - self.stock_phrase:
                return True
            if y - x <= self.stock_phrase:
                own.difference_update(range(x, y))
        return not own

    def _share(self, k: int, bag: Counter) -> float:
        return sum(self.weight[w] * min(c, bag[w]) for w, c in self.bags[k].items() if w in bag) / self.totals[k]

    def spans(self, text) -> list[tuple[int, int]]:
        """Character spans of a text that belong to its leaks: runs with a leaked item, close ones joined."""
        hits = set(self.find(text))
        if not hits:
            return []
        pieces = positions(text)
        seq = [w for w, _, _ in pieces]
        own = sum(1 << k for k, i in enumerate(self.ids) if i in hits)
        out: list[list[int]] = []
        runs = [*self.auto.runs(seq, self.least_run), *self.auto.item_runs(seq, self.least_whole)]
        for a, b in sorted({(a, b) for a, b, mask in runs if mask & own}):
            if out and a - out[-1][1] <= 3:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return [(pieces[a][1], pieces[b - 1][2]) for a, b in out if b - a >= 2 * self.least_run]


def positions(text: str) -> list[tuple[str, int, int]]:
    """(normalised word, start, end) of each piece of a text that has a word."""
    blank = _TAG.sub(lambda m: " " * len(m.group()), text)
    return [(w, m.start(), m.end()) for m in re.finditer(r"\S+", blank) if (w := "".join(words(m.group())))]


_INDEX: dict[str, LeakIndex] = {}


def _index(key: str, items: list[tuple[int, str]], common: Common | None, options: dict) -> LeakIndex:
    """The index of a pass; a worker keeps the last one it made."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = LeakIndex(items, common=common, **options)
    return _INDEX[key]


def _passes(items: DataFrame, item_id: str, text_col: str, max_item_words: int) -> tuple[list[list[tuple[int, str]]], Common | None]:
    """The items in parts of at most ``max_item_words`` words (one item at least), and what all have in common."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL").distinct()
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    for i, t in sorted((r["i"], r["t"]) for r in rows.collect()):
        n = len(words(t))
        if parts[-1] and size + n > max_item_words:
            parts.append([])
            size = 0
        parts[-1].append((i, t))
        size += n
    if len(parts) == 1:
        return parts, None
    return parts, Common([w for p in parts for _, t in p if (w := words(t))])


def _searched(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str, max_item_words: int, options: dict, rows_of: Callable, columns: list[str], schema: str) -> DataFrame:
    """The rows that ``rows_of(index, id, text)`` gives of every document, over all passes."""
    texts = spread(docs.select(F.col(doc_id).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL"))
    parts, common = _passes(items, item_id, text_col, max_item_words)
    out = None
    for part in parts:
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part, common))  # at most max_item_words words

        def run(frames, shared=shared):
            import pandas as pd

            ix = _index(*shared.value, options)
            for pdf in frames:
                yield pd.DataFrame([r for d, t in zip(pdf["id"], pdf["text"]) for r in rows_of(ix, d, t)], columns=columns)

        found = texts.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", max_item_words: int = 200_000, **options) -> DataFrame:
    """(doc_id, item_id, longest_run, share) of every document that repeats an item or a passage of it."""
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows_of = lambda ix, d, t: [(d, i, n, s) for i, (n, s) in ix.find(t).items()]
    found = _searched(docs, items, doc_id, item_id, text_col, max_item_words, options, rows_of, ["id", "item", "longest_run", "share"], f"id {kinds[0]}, item {kinds[1]}, longest_run int, share double")
    best = found.groupBy("id", "item").agg(F.max("longest_run").alias("longest_run"), F.max("share").alias("share"))
    return best.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "longest_run", "share")


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", max_item_words: int = 200_000, **options) -> DataFrame:
    """(doc_id, text, removed) of the documents with leaks: the text without the leaked spans, and how many characters went."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows_of = lambda ix, d, t: [(d, t, [list(x) for x in cuts])] if (cuts := ix.spans(t)) else []
    found = _searched(docs, items, doc_id, item_id, text_col, max_item_words, options, rows_of, ["id", "text", "cuts"], f"id {kind}, text string, cuts array<array<int>>")
    passes = found.groupBy("id", "text").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))  # one list per pass

    def cut(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for d, t, spans in pdf.itertuples(index=False, name=None):
                at, keep, gone = 0, [], 0
                for a, b in joined([(int(x[0]), int(x[1])) for x in spans]):
                    keep.append(t[at:a])
                    at, gone = b, gone + b - a
                rows.append((d, "".join(keep) + t[at:], gone))
            yield pd.DataFrame(rows, columns=["id", "text", "removed"])

    return passes.mapInPandas(cut, f"id {kind}, text string, removed long").withColumnRenamed("id", doc_id)
