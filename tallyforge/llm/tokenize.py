"""Encoding of texts with a byte-level BPE tokenizer by tree reduction.

A text is halved until its pieces are at most ``leaf_chars`` long; the pieces are encoded on their own, and
neighbours are joined up the tree.  A join keeps the tokens of the left piece up to the last pre-token that can't have
looked at the cut, and re-encodes a window from there over the cut.  The window doubles until one of its pre-token
starts past the cut is also one of the right piece's: the pre-tokenizer scans from left to right and depends only on
what follows, so from such a start on both scans, and all tokens, are the same.

Defined results: null and empty texts give ``[]``; strings that look like control tokens are ordinary text; nothing is
normalised.  Duplicate ids and rows are kept as they come; an empty table gives an empty result; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import spread

#: Characters past its own end that the pre-tokenizer may look at for one match: two of a contraction, one of a look-ahead.
LOOK_AHEAD = 3
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


class Segment:
    """Tokens of text[start:end] and where each pre-token starts, as (character, index of its first token)."""

    __slots__ = ("start", "end", "ids", "chars", "toks")

    def __init__(self, start: int, end: int, ids: list[int], chars: list[int], toks: list[int]):
        self.start, self.end, self.ids, self.chars, self.toks = start, end, ids, chars, toks


class TreeEncoder:
    """Encodes by halves; ``leaf_chars`` bounds what is encoded at once, ``window`` is the first boundary window."""

    def __init__(self, path: str, leaf_chars: int = 1024, window: int = 48):
        from tokenizers import Tokenizer, processors

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets then count the leading space
        self.leaf_chars, self.window = max(8, leaf_chars), max(4, window)

    def segments(self, spans: list[tuple[str, int, int]]) -> list[Segment]:
        out = []
        encoded = self.tok.encode_batch([t[a:b] for t, a, b in spans], add_special_tokens=False)
        for (_, a, b), e in zip(spans, encoded):
            chars: list[int] = []
            toks: list[int] = []
            last = None
            for k, (w, (c, _)) in enumerate(zip(e.word_ids, e.offsets)):
                if w != last:
                    chars.append(a + c)
                    toks.append(k)
                    last = w
            out.append(Segment(a, b, e.ids, chars, toks))
        return out

    def join(self, text: str, left: Segment, right: Segment) -> Segment:
        keep = len(left.chars)  # pre-tokens of the left that can't have looked at the cut
        while keep and (left.chars[keep] if keep < len(left.chars) else left.end) + LOOK_AHEAD > left.end:
            keep -= 1
        at = left.chars[keep] if keep < len(left.chars) else left.end
        upto = left.toks[keep] if keep < len(left.toks) else len(left.ids)
        starts = {c: k for k, c in enumerate(right.chars)}
        size = self.window
        while True:
            end = min(right.end, right.start + size)
            (mid,) = self.segments([(text, at, end)])
            if end == right.end:
                return Segment(left.start, right.end, left.ids[:upto] + mid.ids, left.chars[:keep] + mid.chars, left.toks[:keep] + [upto + t for t in mid.toks])
            for k, c in enumerate(mid.chars):
                if c + LOOK_AHEAD > end:
                    break
                if c >= right.start and c in starts:
                    r = starts[c]
                    base, skip = upto + mid.toks[k], right.toks[r]
                    return Segment(
                        left.start,
                        right.end,
                        left.ids[:upto] + mid.ids[: mid.toks[k]] + right.ids[skip:],
                        left.chars[:keep] + mid.chars[:k] + right.chars[r:],
                        left.toks[:keep] + [upto + t for t in mid.toks[:k]] + [base + t - skip for t in right.toks[r:]],
                    )
            size *= 2

    def _leaves(self, a: int, b: int, out: list[tuple[int, int]]) -> None:
        if b - a <= self.leaf_chars:
            out.append((a, b))
        else:
            m = (a + b) // 2
            self._leaves(a, m, out)
            self._leaves(m, b, out)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the leaves of all texts are encoded together, the joins are done per text."""
        out: list[list[int]] = [[] for _ in texts]
        whole = [k for k, t in enumerate(texts) if 0 < len(t) <= self.leaf_chars]
        for k, e in zip(whole, self.tok.encode_batch([texts[k] for k in whole], add_special_tokens=False)):
            out[k] = e.ids
        for k, t in enumerate(texts):
            if len(t) > self.leaf_chars:
                leaves: list[tuple[int, int]] = []
                self._leaves(0, len(t), leaves)
                segs = iter(self.segments([(t, a, b) for a, b in leaves]))
                out[k] = self._reduce(t, 0, len(t), segs).ids
        return out

    def _reduce(self, text: str, a: int, b: int, segs: Iterator[Segment]) -> Segment:
        if b - a <= self.leaf_chars:
            return next(segs)
        m = (a + b) // 2
        left = self._reduce(text, a, m, segs)
        return self.join(text, left, self._reduce(text, m, b, segs))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are concatenated up the same tree, so a character split over tokens stays whole."""
        return _concat(ids, 0, len(ids), self.pieces()).decode("utf-8", errors="replace")

    @lru_cache(maxsize=1)  # noqa: B019
    def pieces(self) -> dict[int, bytes]:
        table = _byte_table()
        return {i: bytes(table[c] for c in s) if all(c in table for c in s) else s.encode() for s, i in self.tok.get_vocab().items()}


def _concat(ids: list[int], a: int, b: int, pieces: dict[int, bytes]) -> bytes:
    if b - a <= 4096:
        return b"".join(pieces[i] for i in ids[a:b])
    m = (a + b) // 2
    return _concat(ids, a, m, pieces) + _concat(ids, m, b, pieces)


def _byte_table() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            table[chr(256 + n)] = b
            n += 1
    return table


@lru_cache(maxsize=4)
def _encoder(path: str, leaf_chars: int) -> TreeEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TreeEncoder(path, leaf_chars)


def encode_corpus(docs: DataFrame, name: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, leaf_chars: int = 1024, batch_chars: int = 4_000_000) -> DataFrame:
    """(id, ids array<int>) of every row of ``docs``; one narrow pass; only tables of fewer parts than cores are spread first.

    ``batch_chars`` bounds the text that is encoded at once in a worker; longer single texts go alone.
    """
    path = f"{folder}/{name}"

    def run(frames):
        import pandas as pd

        enc = _encoder(path, leaf_chars)
        for pdf in frames:
            ids, texts = pdf.iloc[:, 0], [t if isinstance(t, str) else "" for t in pdf.iloc[:, 1]]
            a = 0
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (b == a or n + len(texts[b]) <= batch_chars):
                    n += len(texts[b])
                    b += 1
                yield pd.DataFrame({"id": ids.iloc[a:b].array, "ids": enc.encode_many(texts[a:b])})
                a = b

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
