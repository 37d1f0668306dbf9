"""Comparable forms of titles, names and words (Python side, called from Arrow batches)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from urllib.parse import unquote

# Letters of Cyrillic and Greek that are drawn like a Latin letter (public Unicode confusables data).
CYRILLIC_LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
}
GREEK_LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
}
LOOK_ALIKES = CYRILLIC_LOOK_ALIKES | GREEK_LOOK_ALIKES
# Code points that are not drawn (default ignorable).
IGNORABLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]))

_DROP = dict.fromkeys(map(ord, IGNORABLE))
_LATIN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]")
_FOREIGN = re.compile("[" + "".join(LOOK_ALIKES) + "]")
_WORD = re.compile(r"[^\W\d_]+")
_TAGS = re.compile(r"</?[A-Za-z][^<>]{0,60}>")
_TOKEN = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(LOOK_ALIKES)
_DROPPED, _MARKS = re.compile("[" + IGNORABLE + "]"), re.compile("[\u0300-\u036f]+")
_PLAIN = str.maketrans({"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i"})
_STROKES = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")


def _latin_word(m: re.Match) -> str:
    w = m.group()
    return w.translate(_FOLD) if _LATIN.search(w) and _FOREIGN.search(w) else w


def plain(text: str, accents: bool = False) -> str:
    """Lower-cased compatibility form without ignorable characters, look-alikes or (unless ``accents``) accents."""
    if text.isascii():
        return text.lower()
    if _DROPPED.search(text):
        text = text.translate(_DROP)
    text = unicodedata.normalize("NFKC", text)
    if _FOREIGN.search(text):
        text = _WORD.sub(_latin_word, text)
    if not accents:
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_PLAIN) if _STROKES.search(text) else text))
    return text.lower()


# British endings and the American ones, longest first.
_SPELLING = [
    (re.compile(r"isation(s?)$"), r"ization\1"), (re.compile(r"(is)(e[drs]?|ing)$"), r"iz\2"), (re.compile(r"ys(e[drs]?|ing)$"), r"yz\1"),
    (re.compile(r"our(s|ed|ing|al|able|ite|ites|er|ers|ful)?$"), r"or\1"), (re.compile(r"(cent|theat|met|lit|fib)re(s?)$"), r"\1er\2"),
    (re.compile(r"(\w{3,})ll(ed|ing|er|ers|ment|or|ors)$"), r"\1l\2"), (re.compile(r"ogue(s?)$"), r"og\1"), (re.compile(r"^ageing$"), "aging"), (re.compile(r"programme(s?)$"), r"program\1"),
    (re.compile(r"^(def|off|lic)ence(s?)$"), r"\1ense\2"), (re.compile(r"^judgement"), "judgment"), (re.compile(r"^skilful"), "skillful"),
]
_spelled: dict[str, str] = {}


def american(word: str) -> str:
    """One spelling for British and American forms of a word of five to forty letters."""
    if not 5 <= len(word) <= 40:
        return word
    got = _spelled.get(word)
    if got is None:
        got = word
        for pattern, repl in _SPELLING:
            new = pattern.sub(repl, got)
            if new != got:
                got = new
                break
        if len(_spelled) > 500_000:
            _spelled.clear()
        _spelled[word] = got
    return got


# Words that a copy may add or drop.
ARTICLES = frozenset(["a", "an", "and", "the"])


def title_tokens(title: str | None) -> list[str]:
    """The sorted words of a title without markup, case, accents, articles and spelling variants; [] for null or empty."""
    if not title:
        return []
    if "&" in title or "<" in title:
        title = html.unescape(html.unescape(title))
        title = _TAGS.sub(" ", title)
    return sorted(american(w) for w in _TOKEN.findall(plain(title)) if w not in ARTICLES)


def text_words(text: str | None) -> list[str]:
    """The lower-cased words of a text without markup, in order; [] for null or empty."""
    if not text:
        return []
    if "&" in text or "<" in text:
        text = _TAGS.sub(" ", html.unescape(text))
    return _TOKEN.findall(plain(text))


_DOI = re.compile(r"10\.\d{2,9}/\S+")


def doi_key(doi: str | None) -> str | None:
    """A DOI however written (resolver address, prefix, percent signs, case, trailing stop) as its bare lower-case name; None if there is none."""
    if not doi:
        return None
    m = _DOI.search(unquote(doi).lower())
    return (m.group().rstrip(".,;)") or None) if m else None


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours makes ``a`` into ``b`` (or they are equal)."""
    la, lb = len(a), len(b)
    if la > lb:
        a, b, la, lb = b, a, lb, la
    if lb - la > 1:
        return False
    i = 0
    while i < la and a[i] == b[i]:
        i += 1
    if i == la:
        return True
    if la < lb:
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words; ``most + 1`` if there are more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        new = [i]
        for j, cb in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (ca != cb))
            if before is not None and j > 1 and i > 1 and ca == b[j - 2] and cb == a[i - 2]:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def mistyped(a: str, b: str, common: frozenset | set) -> bool:
    """Whether two different words are one word and its slip of the keyboard.

    Words under four letters and numbers have to be equal; two words that are
    both in wide use are two words.  Two edits are forgiven only in a word of
    six letters or more whose other form is in wide use.
    """
    if min(len(a), len(b)) < 3 or max(len(a), len(b)) < 4 or a.isdigit() or b.isdigit():
        return False
    ca, cb = a in common, b in common
    if ca and cb:
        return False
    if within_one(a, b):
        return True
    return (ca or cb) and min(len(a), len(b)) >= 5 and edits(a, b, 2) <= 2


#: Words of a title that may be slips.
MOST_SLIPS = 6


def same_title(x: list[str], y: list[str], common: frozenset | set, most: int = MOST_SLIPS, alike: Callable[[str, str], bool] | None = None) -> bool:
    """Whether two sorted word lists are one title but for slips in at most ``most`` words. Empty lists are never the same. ``alike`` may know more pairs of words that are one."""
    if not x or not y:
        return False
    if x == y:
        return True
    if len(x) != len(y):
        return False
    dx, dy = _difference(x, y)
    if len(dx) > most:
        return False
    # each left-over word needs its own partner; the lists are short, so plain search is exact
    return _match(dx, dy, common, alike)


def _difference(x: list[str], y: list[str]) -> tuple[list[str], list[str]]:
    i = j = 0
    dx, dy = [], []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i += 1
            j += 1
        elif x[i] < y[j]:
            dx.append(x[i])
            i += 1
        else:
            dy.append(y[j])
            j += 1
    return dx + x[i:], dy + y[j:]


def _match(dx: list[str], dy: list[str], common, alike) -> bool:
    if not dx:
        return True
    return any((mistyped(dx[0], w, common) or (alike is not None and alike(dx[0], w))) and _match(dx[1:], dy[:k] + dy[k + 1 :], common, alike) for k, w in enumerate(dy))
