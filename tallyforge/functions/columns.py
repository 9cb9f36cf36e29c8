"""Column expressions that behave alike here and in the SQL oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(c: Column) -> Column:
    """Two decimals by scaling, as binary engines round; ``round`` of Spark rounds the decimal text instead."""
    return F.round(c * 100, 0) / 100


def coerce_int(c: Column) -> Column:
    """Long, or null for what can't be read as a whole number."""
    return F.when(c.cast("string").rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.regexp_replace(F.trim(c.cast("string")), r"\.0*$", "").try_cast("long"))


def epoch_ms_date(c: Column) -> Column:
    """Milliseconds since 1970 -> ``YYYY-MM-DD`` (session time zone UTC), or null."""
    return F.date_format(F.timestamp_millis(c.try_cast("long")), "yyyy-MM-dd")


def coerce_text(c: Column) -> Column:
    return c.cast("string")


def fiscal_year_of(day: Column, start_month: int) -> Column:
    """The fiscal year (named by the year it ends in) of a date, for years that start in ``start_month``."""
    return F.year(day) + F.when((F.month(day) >= start_month) & F.lit(start_month > 1), 1).otherwise(0)


def fiscal_year_end_of(year: Column, start_month: int) -> Column:
    """Last day of a fiscal year."""
    return F.make_date(year, F.lit(12), F.lit(31)) if start_month == 1 else F.date_sub(F.make_date(year, F.lit(start_month), F.lit(1)), 1)


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words (trailing blanks of a word count)."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def like_escape(text: str) -> str:
    """A text whose LIKE metacharacters stand for themselves, with a backslash as escape."""
    return "".join("\\" + ch if ch in "\\%_" else ch for ch in text)


def quote_ident(name: str, mark: str = "`") -> str:
    """A name as a quoted identifier."""
    return mark + name.replace(mark, mark * 2) + mark


def month_of(c: Column) -> Column:
    """``YYYY-MM`` of a date or ISO text."""
    return F.substring(c.cast("string"), 1, 7)


#: White space of every script, as Unicode-aware engines take it (fixed values); zero-width characters are none.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def clean_space(c: Column) -> Column:
    """White space runs as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


#: Trailing words of an organisation's name that carry no identity (fixed values).
SUFFIXES = ("INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "LIMITED", "CO", "COMPANY", "CORP", "CORPORATION", "PLLC", "PLC", "PC", "PA", "DBA")


def name_key(c: Column) -> Column:
    """Identity key of an organisation's name: spellings with the same key are one organisation.

    Upper case; dots dropped, ``&`` is AND, a trailing ``#`` store code goes, other signs are blanks; a leading THE and
    trailing legal forms go, but one word always stays.  Null gives an empty key.
    """
    k = F.upper(F.coalesce(c, F.lit("")))
    k = F.regexp_replace(k, r"\.", "")
    k = F.regexp_replace(k, "&", " AND ")
    k = F.regexp_replace(k, rf"{SPACE}*#{SPACE}*\p{{Nd}}*{SPACE}*$", "")
    k = F.trim(F.regexp_replace(k, "[^A-Z0-9]+", " "))
    k = F.regexp_replace(k, "^THE (?=.)", "")
    return F.regexp_replace(k, f"( ({'|'.join(SUFFIXES)}))+$", "")


def store_prefix(c: Column) -> Column:
    """What precedes a trailing ``#`` store code, with the sign; empty without one."""
    return F.regexp_extract(F.upper(c), r"^(.*?\S)\s*#\s*\d*\s*$", 1)


#: Words that initials leave out (fixed values).
JOINERS = ("OF", "AND", "THE", "FOR", "TO", "IN", "ON", "AT", "OR", "DE")


def initials_of(key: Column) -> Column:
    """First letters of a key's words without joining words."""
    words = F.filter(F.split(key, " "), lambda w: ~w.isin(*JOINERS) & (F.length(w) > 0))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def as_initialism(key: Column) -> Column:
    """A key that may be initials: up to three words of two to six letters in all; else empty."""
    joined = F.regexp_replace(key, " ", "")
    ok = (F.size(F.split(key, " ")) <= 3) & F.length(joined).between(2, 6) & joined.rlike("^[A-Z]+$")
    return F.when(ok, joined).otherwise("")
