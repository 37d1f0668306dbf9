"""Problem 2: one consistent form for text that looks the same but differs in its characters.

Each word becomes a lattice: a letter that another script draws alike may be
read as either.  Viterbi picks the reading that a character bigram model, made
from all words of the table and consistent in script, scores best.  Before
that, ignorable characters go, full-width forms, joined letters and composed
accents get their plain form, and odd spaces become U+0020.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.textforms import IGNORABLE, LOOK_ALIKES

_DROP = dict.fromkeys(map(ord, IGNORABLE))
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
#: Cost of one change of script inside a word, and of reading a letter as another one, in nats.
SCRIPT_CHANGE, READ_AS_OTHER, UNSEEN = 9.0, 0.5, 7.0
_BACK: dict[str, list[str]] = {}
for _other, _latin in LOOK_ALIKES.items():
    _BACK.setdefault(_latin, []).append(_other)


def script(c: str) -> str:
    """``L``atin, ``C``yrillic, ``G``reek or ``x`` for any other letter."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    return "G" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "C" if 0x400 <= o < 0x530 else "x"


def _compatible(c: str) -> str:
    """The plain form of a full-width letter or digit, a joined letter, a styled letter or an odd space; else ``c``."""
    o = ord(c)
    if o < 0xA0:
        return c
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    d = unicodedata.decomposition(c)
    if d[:1] == "<" and kind[0] in "LN":
        tag = d[1 : d.index(">")]
        if tag in ("wide", "narrow", "font") or (tag == "compat" and kind[0] == "L" and script(c) != "x") or 0xFB00 <= o <= 0xFB06:
            return unicodedata.normalize("NFKC", c)
    return c


_compatible_of: dict[str, str] = {}


def unified(text: str | None, model: dict[str, float] | None = None) -> str | None:
    """The consistent form of ``text``; null stays null, ``''`` stays ``''``.

    Tabs and line breaks between values, dashes, signs, precomposed accents
    and whole words of another script are kept as they are.
    """
    if text is None or text.isascii():
        return text
    out = text.translate(_DROP)
    out = "".join([c if c < "\xa0" else _compatible_of.get(c) or _compatible_of.setdefault(c, _compatible(c)) for c in out])
    out = unicodedata.normalize("NFC", out)
    return _WORD.sub(lambda m: read_word(m.group(), model), out)


def read_word(word: str, model: dict[str, float] | None = None) -> str:
    """The best reading of a word whose letters come from Latin and another script; other words as they are."""
    scripts = {script(c) for c in word}
    if "L" not in scripts or not scripts & {"C", "G"}:
        return word
    model = model or {}
    best: list[tuple[float, str]] = [(0.0, "")]
    for c in word:
        here = [(c, 0.0)]
        if c in LOOK_ALIKES:
            here.append((LOOK_ALIKES[c], READ_AS_OTHER))
        here += [(o, READ_AS_OTHER) for o in _BACK.get(c, ()) if script(o) in scripts]
        new = []
        for to, cost in here:
            new.append(min((score + cost + _step(path[-1:], to, model), path + to) for score, path in best))
        best = new
    return min(best)[1]


def _base(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0].lower()


def _step(before: str, c: str, model: dict[str, float]) -> float:
    if not before:
        return model.get("^" + _base(c), UNSEEN)
    change = SCRIPT_CHANGE if script(before) != script(c) else 0.0
    return change + model.get(_base(before) + _base(c), UNSEEN)


def bigram_model(records: DataFrame, columns: tuple[str, ...]) -> dict[str, float]:
    """``-log P(letter | letter before)`` over every word of one script in the given columns, all rows.

    Keys are pairs of base letters of Latin, Cyrillic and Greek, so there are
    at most some thousands of them whatever the size of the table.
    """
    words = records.select(F.explode(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in columns))).alias("t")).select(F.explode(F.split("t", r"[^\p{L}]+")).alias("w"))
    words = words.where("length(w) > 1").groupBy("w").count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for w, k in zip(b["w"], b["count"], strict=True):
                s = {script(c) for c in w}
                if len(s) == 1 and "x" not in s:
                    w = "^" + "".join(map(_base, w))
                    for i in range(len(w) - 1):
                        n[w[i : i + 2]] += int(k)
        yield pd.DataFrame({"g": list(n), "n": [n[g] for g in n]}, columns=["g", "n"])

    rows = words.mapInPandas(run, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()
    total: Counter = Counter()
    for r in rows:
        total[r.g[0]] += r.n
    return {r.g: min(UNSEEN, -math.log(r.n / total[r.g[0]])) for r in rows}


def unify(records: DataFrame, no: str = "cand_no", columns: tuple[str, ...] = ("title", "authors")) -> DataFrame:
    """``(no, <column>, <column>_changed …)`` for every row: each column in its consistent form, and whether that differs from what is stored.

    A null column stays null and counts as unchanged.
    """
    model = records.sparkSession.sparkContext.broadcast(bigram_model(records, columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {no: b[no]}
            for c in columns:
                new = [unified(t, model.value) for t in b[c]]
                out[c] = new
                out[f"{c}_changed"] = [t is not None and t != n for t, n in zip(b[c], new, strict=True)]
            yield pd.DataFrame(out)

    schema = f"{no} {dict(records.dtypes)[no]}, " + ", ".join(f"{c} string, {c}_changed boolean" for c in columns)
    return records.select(no, *columns).mapInPandas(run, schema)


def changed_fields(records: DataFrame, no: str = "cand_no", columns: tuple[str, ...] = ("title", "authors")) -> DataFrame:
    """``(no, field_name)``: the fields that had to be changed."""
    u = unify(records, no, columns)
    fields = F.filter(F.array(*(F.when(F.col(f"{c}_changed"), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return u.select(F.col(no).cast("bigint").alias(no), F.explode(fields).alias("field_name")).distinct()
