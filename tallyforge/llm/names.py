"""What a typed payee name states: the kind of payee, proper names, line of business, number, given and last name."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from tallyforge.llm.lexicon import edits, fold, skeleton, strip_notes, unscan

#: Legal forms (fixed values).
LEGAL = frozenset("inc incorporated corp corporation co company llc ltd limited lp llp pllc pc plc".split())
#: Lines of business with short forms that no rule makes (fixed values).
TRADES = {
    "plumbing": ("plbg", "plmbg", "plumber"), "electric": ("elec", "elect", "electrical"), "roofing": ("rfg", "roofg", "roof"), "paving": ("pvg", "pav"), "landscaping": ("lndscpg", "landscape", "lawn"),
    "sprinkler": ("sprnklr", "sprn"), "fencing": ("fence", "fnc"), "demolition": ("demo", "wrecking"), "construction": ("const", "constr", "construct", "cons"), "mechanical": ("mech", "hvac"),
    "veterinary": ("vet", "vetrnry"), "dental": ("dntl", "dentist"), "uniforms": ("unif", "uniform"), "catering": ("caterg", "cater"), "consulting": ("consult", "conslt", "cons"),
    "engineering": ("eng", "engr", "engrg"), "printing": ("prtg", "print"), "transport": ("trans", "trnsprt", "transportation"), "services": ("serv", "svc", "svcs", "service"), "supply": ("sply", "supplies", "supp"),
    "masonry": (), "painting": (), "carpentry": (), "security": (), "cleaning": ("janitorial",), "towing": (), "welding": (), "insulation": (), "surveying": (), "trucking": (), "flooring": (), "excavating": (), "glazing": (),
}
#: Short forms of given names (fixed values).
NICKNAMES = {
    "alex": "alexander", "al": "albert", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chas": "charles", "chuck": "charles", "chris": "christine christopher", "chrissy": "christine", "tina": "christine", "dan": "daniel", "danny": "daniel",
    "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "ed": "edward edwin", "eddie": "edward", "ned": "edward", "ted": "theodore edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "eliza": "elizabeth", "fred": "frederick", "freddy": "frederick",
    "jerry": "gerald", "gerry": "gerald", "greg": "gregory", "jackie": "jacqueline", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jos": "joseph", "john": "john", "jack": "john", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kath": "katherine", "kay": "katherine",
    "larry": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "marge": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "nick": "nicholas", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia",
    "ray": "raymond", "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rich": "richard", "rick": "richard", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "robt": "robert", "ron": "ronald", "ronnie": "ronald", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susan", "susie": "susan", "suzy": "susan",
    "theo": "theodore", "teddy": "theodore", "tom": "thomas", "tommy": "thomas", "thos": "thomas", "tim": "timothy", "timmy": "timothy", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "walt": "walter", "wally": "walter", "bill": "william", "billy": "william", "will": "william", "wm": "william", "willie": "william",
}
GIVEN = {n: frozenset([n]) for v in NICKNAMES.values() for n in v.split()} | {k: frozenset(v.split()) for k, v in NICKNAMES.items()}
#: Societies whose branches are told apart by a number (fixed values).
SOCIETIES = {"lodge": "lodge", "ldg": "lodge", "chapel": "chapel", "chpl": "chapel", "chap": "chapel", "post": "post", "chapter": "chapter"}
_NUMBER_WORDS = frozenset(("no", "nr", "number", "num"))

_FORMS: dict[str, frozenset[str]] = {}
for _t, _s in TRADES.items():
    for _w in {_t, *_s, skeleton(_t)} | {_t[:k] for k in range(4, len(_t))}:
        _FORMS[_w] = _FORMS.get(_w, frozenset()) | {_t}


@lru_cache(maxsize=200_000)
def trade_of(word: str) -> frozenset[str]:
    """The lines of business that a word may state."""
    if (f := _FORMS.get(word)) is not None:
        return f
    if len(word) < 5:
        return frozenset()
    near = [t for t in TRADES if abs(len(t) - len(word)) <= 2 and (t[0] == word[0] or t[1] == word[0]) and edits(word, t, 2) <= (1 if len(t) < 8 else 2)]
    if not near and len(word) >= 6:
        near = [t for t in TRADES if len(t) > len(word) and t[0] == word[0] and edits(word, t[: len(word)], 1) <= 1 and len(word) >= 7]
    return frozenset(near[:1])


@lru_cache(maxsize=200_000)
def given_of(word: str) -> frozenset[str]:
    """The given names that a word may stand for."""
    if (f := GIVEN.get(word)) is not None:
        return f
    if len(word) < 5:
        return frozenset()
    for n in GIVEN:
        if len(n) >= 5 and abs(len(n) - len(word)) <= 1 and edits(word, n, 1) <= 1:
            return GIVEN[n]
    return frozenset()


@lru_cache(maxsize=200_000)
def _society(word: str) -> str | None:
    if word in SOCIETIES:
        return SOCIETIES[word]
    if len(word) >= 4:
        for s, k in SOCIETIES.items():
            if len(s) >= 5 and edits(word, s, 1) <= 1:
                return k
    return None


@dataclass(frozen=True)
class Name:
    """A parsed payee.  ``names`` are the proper names of an organisation, or (last,) of a person."""

    kind: str  # org, society or person
    names: tuple[str, ...]
    trades: frozenset[str] = frozenset()
    number: str = ""
    given: frozenset[str] = frozenset()
    middle: str = ""
    legal: str = ""
    broken: bool = False

    @property
    def complete(self) -> bool:
        """Whether the name states all that tells it from others of its kind."""
        if self.kind == "person":
            return bool(self.middle)
        if self.kind == "society":
            return bool(self.number)
        return len(self.trades) == 1 and len(self.names) > 1 and not self.broken


    def packed(self) -> str:
        """The parts in one text, so that a name is parsed once and travels with its pairs."""
        return "\x1f".join((self.kind, " ".join(self.names), " ".join(sorted(self.trades)), self.number, " ".join(sorted(self.given)), self.middle, self.legal, "1" if self.broken else ""))

    @classmethod
    def unpacked(cls, text: str) -> Name:
        kind, words, trades, number, given, middle, legal, broken = text.split("\x1f")
        return cls(kind, tuple(words.split()), frozenset(trades.split()), number, frozenset(given.split()), middle, legal, broken == "1")


_LEGAL_CUT = {w[:k]: short for w, short in (("company", "co"), ("corporation", "corp"), ("incorporated", "inc"), ("limited", "ltd")) for k in range(4, len(w))}
_LEGAL_KIND = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd"}


def _split(word: str) -> list[str]:
    """Words that lost the space between them, if the second is a line of business."""
    if len(word) < 9:
        return [word]
    for t in TRADES:
        for f in (t, *TRADES[t], skeleton(t)):
            if len(f) >= 3 and word.endswith(f) and 5 <= len(word) - len(f) <= 16 and (len(f) > 3 or len(word) - len(f) in (6, 7, 8)):
                return [word[: -len(f)], f]
    return [word]


def tokens(raw: str) -> list[str]:
    t = re.sub(r"\b([A-Z][a-z]{3,})(?=[A-Z][a-z]{2,})", r"\1 ", raw)
    t = strip_notes(fold(t))
    t = re.sub(r"\bl\.?\s?l\.?\s?c\b\.?|(?<=\s)l\.?\s?l\.?\s*$", "llc", t)
    t = re.sub(r"[’'`]", "", t)
    t = re.sub(r"\s*-?\s*[&+]\s*-?|/", " and ", t)
    t = re.sub(r"#\s*(?=\d)", " no ", t)
    out = [x for w in re.findall(r"[^\W_]+", t) for x in _split("co" if w == "c0" else unscan(w))]
    return [x for w in out for x in ([w[:-2], "of"] if len(w) >= 9 and w.endswith("of") else [w])]


@lru_cache(maxsize=100_000)
def parse(raw: str) -> Name:
    """The parts of a payee's name as typed."""
    words = tokens(raw)
    while len(words) > 1 and words[0] in ("the", "dba"):
        words = words[1:]
    broken = 20 <= len(raw.strip()) <= 26
    legal = ""
    body: list[str] = []
    for k, w in enumerate(words):
        if k and (w in LEGAL or broken and k == len(words) - 1 and w in _LEGAL_CUT):
            legal = _LEGAL_KIND.get(w) or _LEGAL_CUT.get(w, w)
        elif w not in ("and", "of"):
            body.append(w)
    number = next((w for w in reversed(body) if w.isdigit()), "")
    society = next((s for w in body[1:] if (s := _society(w))), None)
    if society and (number or any(w in _NUMBER_WORDS for w in body)):
        names = tuple(w for w in body if not w.isdigit() and w not in _NUMBER_WORDS and not _society(w))
        return Name("society", names, frozenset([society]), number.lstrip("0"))
    if not legal and "and" not in words and "of" not in words and 2 <= len(body) <= 3 and not any(w.isdigit() for w in body):
        g = [k for k, w in enumerate(body) if given_of(w)]
        if g and g[0] < 2 and not any(trade_of(w) and len(w) > 3 for k, w in enumerate(body) if k != g[0]):
            k = g[0]
            rest = body[:k] + body[k + 1 :]
            last, middle = (rest[0], rest[1] if len(rest) > 1 else "") if k == 1 else (rest[-1], rest[0] if len(rest) > 1 else "")
            if len(last) > 1:
                return Name("person", (last,), given=given_of(body[k]), middle=middle, broken=broken)
    trades: frozenset[str] = frozenset()
    names = []
    for k, w in enumerate(body):
        t = trade_of(w)
        if not t and broken and k and k == len(body) - 1 and len(w) >= 4:
            t = frozenset(x for f, ts in _FORMS.items() if f.startswith(w) for x in ts)
        if t and not trades:
            trades = t
        elif not w.isdigit() and not (broken and k == len(body) - 1 and len(w) < 3):
            names.append(w)
    if broken and not trades and len(names) > 1:
        end = names[-1]
        hit = frozenset(t for t in TRADES if t.startswith(end) and len(end) < 5)
        if hit:
            trades, names = hit, names[:-1]
    cut = broken and (len(names) < 2 or bool(body) and body[-1] == names[-1] and len(names[-1]) < 6)
    return Name("org", tuple(names), trades, number, legal=legal, broken=cut)


# ---- codes and comparison ----

#: Classes of consonants that sound alike (fixed values); vowels and h, w, y have none.
_SOUND = {c: d for d, cs in {"1": "bpfv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}


def fine_code(word: str) -> str:
    """Consonants in order, doubled letters once: the same for spellings that differ in vowels."""
    return re.sub(r"[aeiou]", "", re.sub(r"(.)\1+", r"\1", word))


def sound_code(word: str) -> str:
    """Classes of the consonants in order, equal neighbours once."""
    out = ""
    for c in word:
        d = _SOUND.get(c, "")
        if d and out[-1:] != d:
            out += d
    return out


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two words."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    got = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                got.append(c)
                break
    m = len(got)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(got, (c for c, u in zip(b, used) if u))) / 2
    j = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + 0.1 * p * (1 - j)


def close(a: str, b: str, least: float = 0.84, least_one: float = 0.78) -> bool:
    """Whether two words are one word with a slip of the hand: alike by Jaro-Winkler and within two edits.

    A single edit in a long word may weigh more there, as at its beginning.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2:
        return False
    jw = jaro_winkler(a, b)
    if jw < least_one:
        return False
    d, short = edits(a, b, 2), min(len(a), len(b))
    return d <= 1 and (jw >= least or short >= 6) or d == 2 and short >= 6 and jw >= least


def likeness(a: Name, b: Name) -> float:
    """Mean Jaro-Winkler of the best partners of proper names; legal forms that agree add a little."""
    s, t = sorted((a.names, b.names), key=len)
    if not s:
        return 0.0
    return sum(max(jaro_winkler(x, y) for y in t) for x in s) / len(s) + 0.05 * (a.legal == b.legal)


def names_agree(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two lists of proper names are the same, in any order, also where spaces were lost."""
    if not a or not b:
        return False
    if len(a) == len(b):
        if all(map(close, a, b)) or len(a) == 2 and close(a[0], b[1]) and close(a[1], b[0]):
            return True
        if len(a) > 2:
            return sum(any(close(x, y) for y in b) for x in a) == len(a)
        return False
    x, y = "".join(a), "".join(b)
    if min(len(x), len(y)) < 10:
        return False
    return edits(x, y, 3) <= 3 or len(b) == 2 and edits(x, b[1] + b[0], 3) <= 3 or len(a) == 2 and edits(a[1] + a[0], y, 3) <= 3


def begins(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    """Whether a broken-off list of names is the beginning of the other."""
    if not short or len(short) > len(long):
        return False
    if len(long) == 2 and not close(short[0], long[0]):
        long = long[::-1]
    if not all(map(close, short[:-1], long)):
        return False
    end, other = short[-1], long[len(short) - 1]
    return close(end, other) or len(short) > 1 and other.startswith(end) or len(end) >= (3 if len(short) > 1 else 5) and edits(end, other[: len(end)], 1) <= 1


def keys(n: Name) -> set[str]:
    """Blocks of a name: phonetic codes of its sorted tokens, and finer codes of single tokens beside one other trait."""
    out = set()
    if n.kind == "person":
        (last,) = n.names
        f = fine_code(last)
        for g in n.given:
            out |= {f"p|{g}|{f}-", f"p|{g}|{sound_code(last)}"} | {f"p|{g}|{f[:i]}{f[i + 1 :]}-" for i in range(len(f))}
        return out
    names = list(n.names)
    if len(names) == 1 and len(names[0]) >= 12:
        w = names[0]
        names = [w[:7], w[-7:]]
    if len(names) >= 2:
        out.add("o|" + "|".join(sorted(sound_code(w) for w in names[:3])))
        for k, w in enumerate(names[:3]):
            other = names[1 if k == 0 else 0]
            out.add(f"f|{fine_code(w)}|{other[:1]}")
    if names:
        for t in n.trades or {""}:
            out |= {f"t|{fine_code(w)}|{t}{n.number if n.kind == 'society' else ''}" for w in names[:2]}
        if len(names[0]) >= 6:
            out.add(f"s|{names[0][:6]}")
    return out


def compare(a: Name, b: Name) -> str:
    """``same``: certainly one payee; ``may``: one of the two leaves open what would tell; empty: different."""
    if a.kind != b.kind:
        return ""
    if a.kind == "person":
        if not a.given & b.given or not close(a.names[0], b.names[0]):
            return ""
        if not a.middle or not b.middle:
            return "may"
        x, y = sorted((a.middle, b.middle), key=len)
        if len(x) == 1:
            return "same" if x == y[0] else ""
        return "same" if close(x, y) or (a.broken or b.broken) and y.startswith(x) else ""
    if a.kind == "society":
        if a.number != b.number or a.trades != b.trades:
            return ""
        return "same" if names_agree(a.names, b.names) else ""
    if a.trades and b.trades and not a.trades & b.trades:
        return ""
    if names_agree(a.names, b.names):
        return "same" if len(a.trades) == 1 and a.trades == b.trades else "may"
    if (a.broken and begins(a.names, b.names)) or (b.broken and begins(b.names, a.names)):
        return "may" if a.trades & b.trades else ""
    return ""
