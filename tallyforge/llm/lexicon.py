"""Folding of typed names, and fixed vocabularies shared by the name operators."""

from __future__ import annotations

import re
import unicodedata

#: Digits that scanners put for letters (fixed values).
SCANNED = {"0": "o", "1": "i", "5": "s", "8": "b"}
#: Words that join the words of a name (fixed values).
JOINERS = ("of", "the", "and", "for", "in", "at", "on", "to")
#: Notes typed around a name: (pattern, replacement) in order (fixed values).
NOTES = (
    (r"\*+\s*[a-z]{2,5}\s*\*+", " "),
    (r"\((?:remit|remittance|ach|ap|dba|old|new|inactive|do not use)\)", " "),
    (r"\s-\s?(?:ap|ach|ar)\s*$", " "),
    (r"^\s*(?:dba|d/b/a|m/s|messrs|attn:?|c/o)\b\.?", " "),
)
_NOTES = [(re.compile(p), r) for p, r in NOTES]


def fold(text: str) -> str:
    """Lower case without accents and invisible characters, one space for any white space."""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return " ".join(t.lower().split())


def unscan(word: str) -> str:
    """A word of letters in which a scanner put digits, with letters again; other words stay."""
    if word == "0f":
        return "of"
    letters = sum(c.isalpha() for c in word)
    if letters < 2 or letters == len(word) or word[0].isdigit() and word[1:2].isdigit() or not all(c.isalpha() or c in SCANNED for c in word):
        return word
    return "".join(SCANNED.get(c, c) for c in word)


def strip_notes(t: str) -> str:
    """A folded name without the notes typed around it."""
    for p, r in _NOTES:
        t = p.sub(r, t)
    return " ".join(t.split())


def words_of(t: str) -> list[str]:
    """Letters-and-digits words of a folded name; ``&``, ``+`` and ``/`` between words are the word "and"."""
    t = re.sub(r"[’'`]", "", t)
    t = re.sub(r"\s*(?:-\s*)?[&+]\s*|(?<=[a-z])/(?=[a-z])", " and ", t)
    return [unscan(w) for w in re.findall(r"[^\W_]+", t)]


def skeleton(word: str) -> str:
    """How typists shorten a word: first letter and consonants, doubled ones once, -ing as -g."""
    w = re.sub(r"ing$", "g", word)
    w = w[:1] + re.sub(r"[aeiouy]", "", w[1:])
    return re.sub(r"(.)\1+", r"\1", w)


def edits(a: str, b: str, most: int = 3) -> int:
    """Edit distance (a swap of neighbours is one), or ``most`` + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)
