"""String functions as columns; built-in expressions unless the name says ``exact``.

Every function maps null to the result for ``''`` unless stated otherwise: an
absent value and an empty one are the same here.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def present(c: Column | str, kind: str = "string") -> Column:
    """Whether a value counts as there: not null and not ``''`` / 0 / false."""
    c = col(c)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != (F.lit("") if kind == "string" else F.lit(0)), F.lit(False))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


@lru_cache
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """From Unicode's own decompositions: characters that fold to one ASCII character, and those that fold to several."""
    one_from, one_to, many = [], [], {}
    for o in range(0x80, 0x10000):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        d = unicodedata.normalize("NFKD", c)
        if d == c:
            continue
        a = "".join(x for x in d if x < "\x80")
        if len(a) == 1:
            one_from.append(c)
            one_to.append(a)
        elif a:
            many[c] = a
    return "".join(one_from), "".join(one_to), many


@lru_cache
def _several() -> list[tuple[str, str]]:
    return sorted(_fold_table()[2].items())


def ascii_fold(c: Column | str) -> Column:
    """Compatibility decomposition without anything that is not ASCII; equal to :func:`ascii_fold_exact`.

    Built in for text whose signs unfold to one ASCII character at most; only
    the rows that hold another sign (a ligature, a fraction, an enclosed number)
    or one beyond the basic plane go through Python.
    """
    one_from, one_to, _ = _fold_table()
    plain = F.regexp_replace(F.translate(text(c), one_from, one_to), r"[^\x00-\x7F]+", "")
    return F.when(text(c).rlike(_rare_signs()), ascii_fold_exact(text(c))).otherwise(plain)


@lru_cache
def _rare_signs() -> str:
    """A class of the signs that unfold to several ASCII characters, and of all beyond the basic plane."""
    codes = [ord(s) for s, _ in _several()]
    spans, start = [], None
    for i, o in enumerate(codes):
        start = o if start is None else start
        if i + 1 == len(codes) or codes[i + 1] != o + 1:
            spans.append(rf"\x{{{start:x}}}-\x{{{o:x}}}")
            start = None
    return "[" + "".join(spans) + r"\x{10000}-\x{10FFFF}]"


@F.pandas_udf(StringType())
def ascii_fold_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda v: "" if v is None else v if v.isascii() else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def normalize_title(c: Column | str) -> Column:
    """Folded, lower case, everything but letters, digits and spaces to one space."""
    t = F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9\s]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def slugify(c: Column | str, words: int = 6, chars: int = 60) -> Column:
    parts = F.filter(F.split(F.lower(ascii_fold(c)), r"[^a-z0-9]+"), lambda x: x != "")
    s = F.left(F.array_join(F.slice(parts, 1, words), "_"), F.lit(chars))
    return F.when(s == "", "untitled").otherwise(s)


def short_title(c: Column | str, chars: int = 50) -> Column:
    s = F.regexp_replace(F.lower(ascii_fold(c)), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "^_+|_+$", ""), f"^(.{{{chars}}}).*$", "$1")
    s = F.regexp_replace(s, "_+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def token_sort(c: Column | str) -> Column:
    """The words of a string in order, joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(text(c), r"(?U)\s+"), lambda x: x != "")), " ")


def record_id(doi: Column | str, title: Column | str, *rest: Column | str) -> Column:
    """``doi:`` and the DOI, else ``ttl:`` and a hash of the normalised title, else ``raw:`` and a hash of all of ``rest`` as JSON."""
    d, n = F.lower(strip(doi)), normalize_title(title)
    raw = F.concat(F.lit("raw:"), F.left(F.sha1(F.to_json(F.struct(*rest) if rest else F.struct(col(doi), col(title)))), F.lit(16)))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(n != "", F.concat(F.lit("ttl:"), F.left(F.sha1(n), F.lit(16)))).otherwise(raw)


def host(c: Column | str) -> Column:
    """The host of an address in lower case, without user, port or brackets; ``''`` if there is none."""
    h = F.regexp_extract(text(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(h, r"[\[\]]", ""))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(k)) for k in words), F.lit(False))


def strip_tags(c: Column | str) -> Column:
    return strip(F.regexp_replace(text(c), "<[^>]+>", " "))


def word_count(c: Column | str) -> Column:
    """White-space separated words."""
    return F.size(F.filter(F.split(text(c), r"(?U)\s+"), lambda x: x != "")).cast("int")


def normalize_text(c: Column | str) -> Column:
    """Bracket codes to brackets, line ends to LF, soft hyphens and break marks away, words broken at a line end joined."""
    t = text(c)
    for code, sign in (("-LRB-", "("), ("-RRB-", ")"), ("-LSB-", "["), ("-RSB-", "]"), ("⏎", ""), ("\r\n", "\n"), ("\r", "\n"), ("\xad", "")):
        t = F.replace(t, F.lit(code), F.lit(sign))
    return F.regexp_replace(t, r"(?U)(\w)-\n\s*(\w)", "$1$2")


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(text(c), r"[ \t]+", " "))


def iso_seconds(ts: Column) -> Column:
    """A timestamp as ISO 8601 with seconds and offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def today() -> Column:
    """The date of the run as ISO text."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def whole_number(c: Column | str) -> Column:
    """A string as int, 0 where it is none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(text(c).cast("string"), r"^\s*([+-]?\d{1,9})\s*$", 1), F.lit("S999999999")).cast("int"), F.lit(0))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
