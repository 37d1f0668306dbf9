"""Several values packed in one field: one row per value, with its position.

Ordinary characters of a field are masked, so that what is left is a skeleton
of delimiters and of the kinds of piece between them (``w`` one word, ``f``
several, ``i`` initials, ``Q`` quoted).  A splitting rule is resolved once for
each distinct skeleton, the rules are broadcast (they are few; beyond
``MOST_BROADCAST`` they are joined by a shuffle instead) and applied with
built-in functions only.

Phrases that hold a comma or an "and" of their own ("Hong Kong, China", "give
and take") are learned from the table itself: they occur as whole values in
fields whose delimiter is beyond doubt.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import materialise, tidy

MOST_BROADCAST = 20_000
#: Fields in which a phrase has to be a value.
SUPPORT = 2
#: Delimiters that decide a field on their own, strongest first: (name, sign in the skeleton, pieces).
STRONG = [
    ("line", "\n", r'(?:[^"\n]++|"[^"]*+"|")++'),
    ("tab", "\t", r'(?:[^"\t]++|"[^"]*+"|")++'),
    ("semicolon", ";", r'(?:[^";]++|"[^"]*+"|")++'),
    ("dot", "·", r'(?:[^"·]++|"[^"]*+"|")++'),
    ("bar", "|", r'(?:[^"|]++|"[^"]*+"|")++'),
    ("slash", "\x02", r'(?:[^"\x02]++|"[^"]*+"|")++'),
]
COMMA = r'(?:[^",]++|"[^"]*+"|")++'
PAIRS = rf"{COMMA},{COMMA}"
#: White space, Unicode's separators included.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_COUNT = r"^\s*\d+ match(?:es)?:\s*"
_WIDE = "".join(c for c in _SPACE if unicodedata.category(c) == "Zs" and c != " ")
_BLANKS = f"[{''.join(f'\\x{{{ord(c):x}}}' for c in _SPACE)}]*+"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def _holds(c: str, *signs: str) -> Column:
    out = F.contains(F.col(c), F.lit(signs[0]))
    for s in signs[1:]:
        out = out | F.contains(F.col(c), F.lit(s))
    return out


def _replaced(df: DataFrame, name: str, pattern: str, by: str, *signs: str, lower: bool = False) -> DataFrame:
    """``df`` with a pattern replaced in the column ``name`` of the rows that hold one of the signs.

    Each step is a projection of its own: nested in one expression, a column
    named three times in each step would be worked out again and again.
    """
    if lower:
        df = df.withColumn("_low", F.lower(name))
    return df.withColumn(name, F.when(_holds("_low" if lower else name, *signs), F.regexp_replace(name, pattern, by)).otherwise(F.col(name))).drop("_low")


def with_skeleton(df: DataFrame) -> DataFrame:
    """``df`` with the delimiter skeleton of ``raw``, repeats folded; ``names`` (boolean) is kept as its first letter."""
    s = "skeleton"
    df = _replaced(df.withColumn(s, F.translate("raw", _WIDE, " " * len(_WIDE))), s, _COUNT, "", "match")
    df = _replaced(df, s, r'"[^"]*"', "\x07", '"')
    df = _replaced(df, s, " +/ +", "\x02", " / ")
    df = _replaced(df, s, r"(?i)(^|[,;|·\x02\n\t ])(?:and|&) +", "$1+", "nd ", "ND ", "Nd ", "nD ", "& ")
    piece = r"[^\s,;|·\x02\x07+\[\]]"
    c = F.regexp_replace(s, r" *([,;|·\x02\n\t+\[\]]) *", "$1")
    c = F.regexp_replace(c, r"(?<![^,;|·\x02+\n\t])(?:\p{L}\p{M}*\.?[ -]?){1,3}(?=[,;|·\x02+\n\t]|$)", "\x05")
    c = F.regexp_replace(c, rf"{piece}++(?: +{piece}++)+", "\x06")
    c = F.regexp_replace(c, r"[^,;|·\x02+\n\t\[\]\x05\x06\x07]+", "w")
    c = F.regexp_replace(F.translate(c, "\x05\x06\x07", "ifQ"), r"([wfiQ][,;|·\x02\n\t])\1{2,}", "$1$1*")
    return df.withColumn(s, F.concat(F.when(F.col("names"), "N").otherwise("T"), c))


def resolve(skeleton_: str) -> str:
    """The rule of a skeleton: a delimiter's name, ``json``, ``comma``, ``pairs`` (family, given), ``and`` or ``one``."""
    names, s = skeleton_[0] == "N", skeleton_[1:].strip()
    if s.startswith("[") and s.endswith("]") and "Q" in s:
        return "json"
    for name, sign, _ in STRONG:
        if sign in s:
            return name
    if "," in s:
        pieces = [p for p in re.split(r"[,+]", s.replace("*", "")) if p]
        if names and "Q" not in s:
            if all(p == "w" for p in pieces) or "i" in pieces or pieces == ["w", "f"]:
                return "pairs"
        return "comma"
    return "and" if "+" in s.strip("+") else "one"


#: The sign at which a field without quotes is simply cut, by rule.
_SIGNS = {name: sign for name, sign, _ in STRONG} | {"comma": ",", "and": ","}
_LAST_AND = r"(?iU)(?:,[ \p{Zs}]*|[ \p{Zs}]+)(?:and|&)[ \p{Zs}]+(?=[^,\"]*$|\"[^\"]*\"\s*$)"


def _by_rule(cases: dict[str, Column], otherwise: Column | None = None) -> Column:
    out = None
    for rule, c in cases.items():
        out = F.when(F.col("rule") == rule, c) if out is None else out.when(F.col("rule") == rule, c)
    return out if otherwise is None else out.otherwise(otherwise)


def _with_values(df: DataFrame) -> DataFrame:
    """``df`` with ``values``, the values of ``raw`` by ``rule``.  Most fields hold no quotes and are cut by sign."""
    df = df.withColumn("_quoted", _holds("raw", '"', "\\"))
    df = df.withColumn("_t", F.when(F.col("rule") == "slash", F.regexp_replace("raw", r"(?U)[ \p{Zs}]+/[ \p{Zs}]+", "\x02")).otherwise(F.col("raw")))
    df = df.withColumn("_list", F.col("rule").isin("comma", "and", "pairs", "one") & _holds("_t", "match"))
    df = df.withColumn("_t", F.when(F.col("_list"), F.regexp_replace("_t", _COUNT, "")).otherwise(F.col("_t")))
    df = df.withColumn("_low", F.lower("_t")).withColumn("_list", F.col("rule").isin("comma", "and", "pairs") & _holds("_low", "and", "&"))
    df = df.withColumn("_t", F.when(F.col("_list"), F.regexp_replace("_t", _LAST_AND, ",")).otherwise(F.col("_t")))

    # without quotes: signs with the blanks around them become one sign, an "and" before the last piece goes
    code = {name: f"\\x{{{ord(sign):x}}}" for name, sign in _SIGNS.items()}
    df = df.withColumn("_cut", F.when(~F.col("_quoted"), _by_rule({n: F.btrim(F.regexp_replace("_t", f"{_BLANKS}(?:{q}{_BLANKS})+", _SIGNS[n]), F.lit(_SPACE + _SIGNS[n])) for n, q in code.items()})))
    df = df.withColumn("_low", F.lower("_cut"))
    last = _by_rule({n: F.when(_holds("_low", _SIGNS[n] + "and", _SIGNS[n] + "&"), F.regexp_replace("_cut", rf"(?iU){q}(?:and|&)[ \p{{Zs}}]+(?=[^{q}]*$)", _SIGNS[n])).otherwise(F.col("_cut")) for n, q in code.items()})
    df = df.withColumn("_cut", last).withColumn("_plain", _by_rule({n: F.split("_cut", q) for n, q in code.items()} | {"one": F.when(~F.col("_quoted"), F.array(_strip(F.col("_t"))))}))

    # with quotes, and names in pairs: pieces by pattern
    every = lambda pattern: F.regexp_extract_all("_t", F.lit(pattern), F.lit(1))
    patterns = {"json": r'("(?:[^"\\]|\\.)*")'} | {name: f"({p})" for name, _, p in STRONG} | {"comma": f"({COMMA})", "and": f"({COMMA})", "pairs": f"({PAIRS})"}
    df = df.withColumn("_rest", F.when(F.col("_plain").isNull(), _by_rule({n: every(p) for n, p in patterns.items()}, F.array("_t"))))

    def clean(p: Column, i: Column) -> Column:
        p = _strip(p)
        p = F.when((i == F.size("_rest") - 1) & (F.col("rule") != "one"), F.regexp_replace(p, r"(?iU)^(?:and|&)[ \p{Zs}]+", "")).otherwise(p)
        p = F.when(F.contains(p, F.lit('"')) | F.contains(p, F.lit("\\")), F.regexp_replace(F.regexp_replace(p, r'^"(.*)"$', "$1"), r'\\(["\\])', "$1")).otherwise(p)
        return _strip(p)

    df = df.withColumn("_rest", F.filter("_rest", lambda p: _strip(p) != ""))
    slow = F.filter(F.transform("_rest", clean), lambda p: p != "")
    return df.withColumn("values", F.when(F.col("_plain").isNull(), slow).otherwise(F.array_remove("_plain", ""))).drop("_quoted", "_t", "_list", "_low", "_cut", "_plain", "_rest")


_PROTECT = {",": "\x0e", "&": "\x0f", " and ": "\x10", " And ": "\x11", " AND ": "\x12"}


def _protect(c: Column) -> Column:
    for plain, sign in _PROTECT.items():
        c = F.replace(c, F.lit(plain), F.lit(sign))
    return c


def _unprotect(c: Column) -> Column:
    for plain, sign in _PROTECT.items():
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return c


def _phrases(settled: DataFrame) -> DataFrame:
    """``(field_name, val)``: values that hold a comma or an "and" of their own.

    A phrase has to be a value of ``SUPPORT`` fields, and one of its parts must
    not be a value by itself more often than the phrase is one: else it is a
    list in a field of another delimiter.  In names of people only an "and" is
    looked at.
    """
    marked = F.filter("values", lambda p: p.rlike("(?i) and |&") | (F.contains(p, F.lit(",")) & ~F.col("names")))
    phrases = settled.select("field_name", F.explode(F.array_distinct(marked)).alias("val")).groupBy("field_name", "val").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    phrases = materialise(phrases, "phrases")
    parts = phrases.select("field_name", F.col("val").alias("phrase"), "n", F.explode(F.split("val", r"(?i),\s*| and |\s*&\s*")).alias("val"))
    needed = parts.select("field_name", "val").distinct()
    alone = settled.select("field_name", F.explode("values").alias("val")).join(needed, ["field_name", "val"], "left_semi").groupBy("field_name", "val").agg(F.count("*").alias("k"))
    lists = parts.join(alone, ["field_name", "val"], "left").groupBy("field_name", "phrase").agg(F.min(F.coalesce("k", F.lit(0)) > F.col("n")).alias("list"))
    return phrases.join(lists.where(~F.col("list")).select("field_name", F.col("phrase").alias("val")), ["field_name", "val"], "left_semi").select("field_name", "val")


@tidy
def split_values(records: DataFrame, no: str, fields: tuple[str, ...], name_fields: tuple[str, ...] = (), single: bool = False) -> DataFrame:
    """``(no, field_name, pos, val)``: every value of a field that holds two or more (with ``single``, also of fields that hold one).

    ``pos`` counts the non-empty values from 1.  Null, empty and blank fields,
    and fields of delimiters only, give no row.  ``name_fields`` hold names of
    people, in which ``Family, Given`` is one value.  Repeated rows give
    repeated values, once per ``no`` and position.
    """
    items = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw"), F.lit(f in name_fields).alias("names")) for f in fields))
    f = records.select(F.col(no).alias("no"), F.explode(items).alias("x")).select("no", "x.*").where(F.col("raw").isNotNull() & F.col("raw").rlike(r"(?U)[^\s\p{Z}]"))
    f = materialise(with_skeleton(f), "skeletons")
    skeletons = f.select("skeleton").distinct()
    some = [r.skeleton for r in skeletons.limit(MOST_BROADCAST + 1).collect()]
    if len(some) <= MOST_BROADCAST:
        spark = records.sparkSession
        rules = F.broadcast(spark.createDataFrame([(s, resolve(s)) for s in some] or [("", "one")], "skeleton string, rule string"))
    else:
        rules = skeletons.mapInPandas(lambda bs: (b.assign(rule=[resolve(s) for s in b["skeleton"]]) for b in bs), "skeleton string, rule string")
    f = f.join(rules, "skeleton", "left").drop("skeleton")
    # a comma or an "and" is no sure delimiter: phrases that hold one are kept whole there
    doubted = F.col("rule").isin("comma", "and", "pairs")
    settled = materialise(_with_values(f.where(~doubted)).select("no", "field_name", "names", "rule", "values"), "settled")
    known = _phrases(settled.where(F.col("rule") != "one"))
    doubtful = materialise(f.where(doubted), "doubtful")
    lengths = sorted(r.k for r in known.select(F.size(F.split("val", r",\s*")).alias("k")).distinct().collect())
    bits = doubtful.where(F.col("rule") != "pairs").withColumn("bits", F.split(F.regexp_replace("raw", _COUNT, ""), r",\s*"))
    phrases = F.flatten(F.transform(F.sequence(F.lit(0), F.size("bits") - 1), lambda i: F.array(*(F.array_join(F.slice(F.col("bits"), i + 1, k), ", ") for k in lengths or [1]))))
    phrases = F.array_distinct(F.transform(phrases, lambda p: _strip(F.regexp_replace(p, r"(?iU)^(?:and|&)[ \p{Zs}]+", ""))))
    phrases = F.filter(F.array_union(phrases, F.transform(phrases, lambda p: F.regexp_extract(p, r"(?iU)[ \p{Zs}](?:and|&)[ \p{Zs}]+(.* (?:and|&) .*)$", 1))), lambda p: p.rlike("(?i) and |&|,"))
    found = bits.select("no", "field_name", F.explode(phrases).alias("val")).join(known, ["field_name", "val"], "left_semi")
    found = found.groupBy("no", "field_name").agg(F.array_sort(F.collect_set("val"), lambda x, y: F.length(y) - F.length(x)).alias("kept"))
    f = doubtful.join(found, ["no", "field_name"], "left")
    f = f.withColumn("raw", F.when(F.col("kept").isNull(), F.col("raw")).otherwise(F.aggregate("kept", F.col("raw"), lambda acc, a: F.replace(acc, a, _protect(a)))))
    raw = F.col("raw")
    raw = F.when(F.col("names") & F.contains(raw, F.lit(" and ")), F.regexp_replace(raw, r"((?<!\p{L})(?:for|of) [^,;|\x10]*?) and (?=\p{L})", "$1\x10")).otherwise(raw)
    f = _with_values(f.withColumn("raw", raw).drop("kept"))
    values = F.when(F.col("raw").rlike("[\x0e-\x12]"), F.transform("values", _unprotect)).otherwise(F.col("values"))
    # written, as a filter on the values would be pushed below all these steps and repeat them
    out = settled.select("no", "field_name", "values").unionByName(materialise(f.select("no", "field_name", values.alias("values")), "cut"))
    if not single:
        out = out.where(F.size("values") >= 2)
    out = out.select(F.col("no").alias(no), "field_name", F.posexplode("values").alias("pos", "val"))
    return out.select(no, "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "val")
