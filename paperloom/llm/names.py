"""Problem 5: variant spellings of names, by a prefix-filtered set-similarity join on token q-grams.

Every spelling is parsed, whatever its language, into a form: its plain words,
or words and the initial of a given name.  A form's words become sets of
padded q-grams in one order from rare to frequent.  A slip of the keyboard
destroys at most ``Q + 1`` neighbouring grams of a word, so two forms that
differ by a slip in each word share a gram of the shortest beginning of that
order (the prefix) that holds two grams of one word which no single slip
destroys together.  Only such pairs are joined; parities of the gram sets
prune them, and a soft weighted token similarity, in which rare tokens count
more, verifies them.

A form that says less (an initial, a shortened given name, abbreviations, no
middle name) stays open: it joins the one entity it fits, or is linked to each
of several.  Spellings of one form never meet in the join.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.history import hash_word
from paperloom.llm.textforms import plain, within_one
from paperloom.session import materialise, tidy

Q = 3
#: Soft similarity that verifies a pair.
SOFT = 0.8
#: A word may hold a slip from this length on, and a given name may be shortened to this length.
SLIP_FROM, SHORT_FROM = 4, 3
#: Names of more words than this have no initials, no shortened given name and no middle name.
MOST_PERSON = 4
#: Tokens in this share of the forms or more are weighed by their share, all others as if they had this one; at most ``tokens per form / share`` tokens reach it.
SHARE = 0.0005
#: Gram counts are kept in this many buckets; they only order the grams.
BUCKETS = 1 << 16

# Words of names that carry no meaning of their own.
STOP = frozenset(["and", "at", "for", "of", "the", "univ", "university"])
_WORD = re.compile(r"[^\W_]+\.?")
_NICK = re.compile(r"\([^()]*\)(?=\s*[^\W_])")
_JOINED = str.maketrans({"-": None, "'": None, "’": None, "‐": None, "&": " "})

FULL, INIT, ODD = 0, 1, 2
_ALL = (1 << 64) - 1
_FORM = "kind tinyint, tokens string, initial string, given int, inner int"


def parse(name: str) -> tuple[int, str, str, int, int, str]:
    """``(kind, tokens, initial, given, inner, middle)`` of a spelling.

    ``tokens`` are the sorted words, without words of :data:`STOP` where two others are left; ``kind`` is
    ``FULL`` (two words or more), ``INIT`` (words and the initial of a given
    name) or ``ODD``.  ``given`` and ``inner`` are bits of the tokens that
    stand where a given name stands, and between two others in a name of three
    words.  ``middle`` are further initials.  Abbreviations (words of three-word
    names and longer that end in a stop) keep their stop.

    Case, accents, look-alikes, invisible characters, a nickname in
    parentheses before a word, hyphens and the order of family and given name
    make no difference.
    """
    s = _NICK.sub(" ", plain(name).translate(_JOINED)).strip(" ,;")
    family, comma, rest = s.partition(",")
    words = _WORD.findall(f"{rest} {family}" if comma else s)
    full = [w for w in words if len(w.rstrip(".")) > 1]
    telling = [w for w in full if w.rstrip(".") not in STOP]
    if len(telling) < 2:
        telling = full
    if len(telling) < 3:
        telling = [w.rstrip(".") for w in telling]
    letters = [w[0] for w in words if len(w.rstrip(".")) == 1]
    tokens = sorted(telling)
    if not tokens:
        return ODD, " ".join(letters), "", 0, 0, ""
    leading = len(words[0].rstrip(".")) == 1
    if letters and (leading or len(tokens) == 1):
        return INIT, " ".join(tokens), letters[0], 0, 0, "".join(letters[1:])
    if len(tokens) == 1:
        return ODD, tokens[0], "", 0, 0, ""
    inner = 1 << tokens.index(telling[1]) if len(telling) == len(full) == 3 else 0
    return FULL, " ".join(tokens), "", 1 << tokens.index(telling[0]) if len(tokens) < 31 else 0, inner, "".join(letters)


def writes_out(short: str, word: str) -> bool:
    """Whether ``short`` (without its stop) can abbreviate ``word``: its letters in order from the first on."""
    if not word.startswith(short[0]) or len(short) >= len(word):
        return False
    it = iter(word)
    return all(c in it for c in short)


def grams(word: str) -> list[tuple[str, int]]:
    """The padded q-grams of a word in order, repeats numbered."""
    s = "^" * (Q - 1) + word + "$" * (Q - 1)
    seen: dict[str, int] = {}
    out = []
    for i in range(len(s) - Q + 1):
        g = s[i : i + Q]
        seen[g] = seen.get(g, -1) + 1
        out.append((g, seen[g]))
    return out


def token_similarity(t: str, u: str) -> float:
    """1 for equal tokens, less by the share of one letter for tokens that are one slip apart, 0 for others."""
    if t == u:
        return 1.0
    return 1 - 1 / max(len(t), len(u)) if min(len(t), len(u)) >= SLIP_FROM and within_one(t, u) else 0.0


def similarity(x: list[str], y: list[str], weight: dict[str, float], heavy: float) -> float:
    """Soft weighted similarity of two token lists: every token needs a partner of its own, equal or one slip away; 0 if one has none."""
    if len(x) != len(y):
        return 0.0
    left, got, total = list(y), 0.0, 0.0
    for t in sorted(x, key=lambda t: t not in y):
        best, how = None, 0.0
        for u in left:
            s = token_similarity(t, u)
            if s > how:
                best, how = u, s
        if best is None:
            return 0.0
        left.remove(best)
        w = weight.get(t, heavy) + weight.get(best, heavy)
        got, total = got + how * w, total + w
    return got / total if total else 0.0


def written_out(x: list[str], y: list[str]) -> bool:
    """Whether each token of ``x`` is one of ``y`` (but for a slip) or abbreviates one, each of its own."""
    left = list(y)
    for t in sorted(x, key=lambda t: t.endswith(".")):
        for u in left:
            if t == u or (writes_out(t[:-1], u) if t.endswith(".") and len(t) > 2 else token_similarity(t, u) > 0):
                left.remove(u)
                break
        else:
            return False
    return not left


Form = tuple[int, list[str], str, int, int]


def relation(x: Form, y: Form, weight: dict[str, float], heavy: float) -> int:
    """What two forms ``(kind, tokens, initial, given, inner)`` are: 0 different, 1 the same, 2 ``x`` says less and may stand for ``y``, 3 the other way round."""
    (kx, wx, ix, gx, nx), (ky, wy, iy, gy, ny) = x, y
    if kx == INIT and ky == INIT:
        return int(ix == iy and similarity(wx, wy, weight, heavy) >= SOFT)
    if kx == INIT or ky == INIT:
        if kx != INIT:
            return {2: 3}.get(relation(y, x, weight, heavy), 0)
        if ky != FULL or len(wy) != len(wx) + 1 or len(wy) > MOST_PERSON:
            return 0
        fits = any(w[0] == ix and similarity(wx, wy[:i] + wy[i + 1 :], weight, heavy) >= SOFT for i, w in enumerate(wy))
        return 2 if fits else 0
    if len(wx) == len(wy):
        if similarity(wx, wy, weight, heavy) >= SOFT:
            return 1
        short_x, short_y = (any(w.endswith(".") for w in ws) for ws in (wx, wy))
        if short_x and written_out(wx, wy):
            return 2
        if short_y and written_out(wy, wx):
            return 3
        if len(wx) <= MOST_PERSON:
            dx, dy = [w for w in wx if w not in wy], [w for w in wy if w not in wx]
            if len(dx) == len(dy) == 1 and gx >> wx.index(dx[0]) & 1 and gy >> wy.index(dy[0]) & 1:
                if len(dx[0]) >= SHORT_FROM and dy[0].startswith(dx[0]):
                    return 2
                if len(dy[0]) >= SHORT_FROM and dx[0].startswith(dy[0]):
                    return 3
        return 0
    if len(wx) == 3 and len(wy) == 2:
        return {2: 3}.get(relation(y, x, weight, heavy), 0)
    if len(wx) == 2 and len(wy) == 3 and any(ny >> i & 1 and similarity(wx, wy[:i] + wy[i + 1 :], weight, heavy) >= SOFT for i in range(3)):
        return 2
    return 0


def forms_of(names: DataFrame, name: str = "val") -> tuple[DataFrame, DataFrame]:
    """``(spellings, forms)``: ``(val, form_id, middle)`` for every distinct spelling, and ``(form_id, kind, tokens, initial, given, inner)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = pd.DataFrame([parse(v) for v in b["val"]], columns=["kind", "tokens", "initial", "given", "inner", "middle"])
            p.insert(0, "val", b["val"].to_numpy())
            yield p[p["tokens"] != ""]

    distinct = names.select(F.col(name).alias("val")).where("val is not null and val <> ''").distinct()
    parsed = distinct.mapInPandas(run, f"val string, {_FORM}, middle string").withColumn("form_id", F.xxhash64("kind", "tokens", "initial"))
    parsed = materialise(parsed, "parsed")
    forms = parsed.groupBy("form_id", "kind", "tokens", "initial").agg(F.expr("bit_or(given)").alias("given"), F.expr("bit_or(inner)").alias("inner"))
    return parsed.select("val", "form_id", "middle"), materialise(forms, "forms")


class _Words:
    """Grams, buckets and parities of words, each word worked out once per task."""

    def __init__(self, count: np.ndarray | None = None):
        self.count, self.known, self.hashes = count, {}, {}

    def buckets(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            got = self.known[word] = [self._hash(g) % BUCKETS for g, _ in grams(word)]
        return got

    def _hash(self, g: str) -> int:
        h = self.hashes.get(g)
        if h is None:
            h = self.hashes[g] = hash_word(g)
        return h

    def of(self, word: str) -> tuple[list[tuple[int, int, int, int, int]], int]:
        """``(count, gram, repeat, element, place)`` of each gram, and the 128-bit parity of the word's grams."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            out, bits = [], 0
            for i, (g, k) in enumerate(grams(word)):
                h = self._hash(g)
                e = (h + k * 0x9E3779B97F4A7C15) & _ALL
                bits ^= 1 << ((e * 0xD6E8FEB86659FD93 >> 32) & 127)
                out.append((int(self.count[h % BUCKETS]), h, k, e, i))
            got = self.known[word] = (out, bits)
        return got


def prefix(words: list[str], index: _Words) -> tuple[list[int], int]:
    """The prefix of a list of words, as elements, and the parity of all its grams.

    The grams are taken from rare to frequent until one word has two that lie
    more than ``Q`` places apart, or one gram of a word too short for slips:
    no slip in each word can destroy all of those.
    """
    every, parity = [], 0
    for n, w in enumerate(words):
        own, bits = index.of(w)
        parity ^= bits
        every += [(*g, n) for g in own]
    every.sort()
    out, first, last = [], {}, {}
    for _, _, _, e, i, n in every:
        out.append(e)
        first[n], last[n] = min(i, first.get(n, i)), max(i, last.get(n, i))
        if last[n] - first[n] > Q or len(words[n]) < SLIP_FROM:
            break
    return out, parity


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


class _Places:
    """Where forms meet: two forms meet under one ``key`` if one has a role of bit 1 and the other of bit 2; ``p`` and ``r`` are a parity and ``most`` the bits in which it may differ."""

    def __init__(self, index: _Words):
        self.index, self.rows, self.bases = index, [], {}

    def _under(self, purpose: str, words: list[str], role: int, form_id: int) -> None:
        base = self.bases.get((purpose, len(words)))
        if base is None:
            base = self.bases[purpose, len(words)] = _key(purpose, str(len(words)))
        elements, parity = prefix(words, self.index)
        most = 2 * (Q + 1) * len(words)
        for e in elements:
            self.rows.append(((e ^ base) * 0x9E3779B97F4A7C15 & _ALL, form_id, role, most, parity & _ALL, parity >> 64))

    def add(self, form_id: int, form: Form) -> None:
        kind, words, initial, given, inner = form
        if kind == INIT:
            self._under("i" + initial, words, 3, form_id)
            return
        self._under("f", words, 3, form_id)
        if kind != FULL:
            return
        if len(words) <= MOST_PERSON:
            for i, w in enumerate(words):
                others = words[:i] + words[i + 1 :]
                self._under("i" + w[0], others, 2, form_id)
                if given >> i & 1 and len(w) >= SHORT_FROM:
                    self.rows.append((_key("g", w[:SHORT_FROM], *others), form_id, 3, 0, 0, 0))
                if inner >> i & 1:
                    self._under("m", others, 2, form_id)
        if len(words) == 2:
            self._under("m", words, 1, form_id)
        if len(words) > 2:
            initials, role = "".join(sorted(w[0] for w in words)), 3 if any(w.endswith(".") for w in words) else 2
            self.rows += [(_key("a", initials, w), form_id, role, 0, 0, 0) for w in words if not w.endswith(".")]

    def table(self) -> pd.DataFrame:
        key, form_id, role, most, p, r = zip(*self.rows, strict=True) if self.rows else ((),) * 6
        whole = lambda x: np.array(x, dtype=np.uint64).astype(np.int64)
        self.rows = []
        return pd.DataFrame({"key": whole(key), "form_id": np.array(form_id, dtype=np.int64), "role": np.array(role, dtype=np.int8), "most": np.array(most, dtype=np.int16), "p": whole(p), "r": whole(r)})


def _form(kind, tokens, initial, given, inner) -> Form:
    return kind, tokens.split(" "), initial, given, inner


def _gram_counts(forms: DataFrame) -> np.ndarray:
    """Grams of all forms counted in ``BUCKETS`` buckets, whatever the number of forms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, total = _Words(), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            at = [x for t in b["tokens"] for w in t.split(" ") for x in index.buckets(w)]
            total += np.bincount(at, minlength=BUCKETS) if at else 0
            index.known.clear()
        there = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": there, "n": total[there]})

    n = forms.select("tokens").mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[n["bucket"].to_numpy()] = n["n"].to_numpy()
    return out


def _weights(forms: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the tokens with a share of ``SHARE`` or more of the forms, and the weight of every other."""
    n = max(1, forms.count())
    rows = forms.select(F.explode(F.split("tokens", " ")).alias("t")).groupBy("t").count().where(F.col("count") >= F.lit(SHARE * n)).collect() if n * SHARE > 1 else []
    return {r.t: math.log(1 + n / r["count"]) for r in rows}, math.log(1 + 1 / SHARE)


def links_of(forms: DataFrame) -> DataFrame:
    """``(a, b, how)`` links between forms: ``how`` 1 if they are one name, 2 if ``a`` says less and may stand for ``b``."""
    sent = forms.sparkSession.sparkContext.broadcast((_gram_counts(forms), *_weights(forms)))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = _Places(_Words(sent.value[0]))
        for b in batches:
            for i, *f in b.itertuples(index=False, name=None):
                at.add(i, _form(*f))
            yield at.table()

    cols = ["form_id", "kind", "tokens", "initial", "given", "inner"]
    met = materialise(forms.select(*cols).mapInPandas(places, "key bigint, form_id bigint, role tinyint, most smallint, p bigint, r bigint"), "places")
    a = met.where("role in (1, 3)").select("key", F.col("form_id").alias("a"), F.col("role").alias("ra"), F.col("most").alias("ma"), F.col("p").alias("pa"), F.col("r").alias("qa"))
    b = met.where("role in (2, 3)").select("key", F.col("form_id").alias("b"), F.col("role").alias("rb"), F.col("p").alias("pb"), F.col("r").alias("qb"))
    near = "bit_count(pa ^ pb) + bit_count(qa ^ qb) <= ma"
    pairs = a.join(b, "key").where(f"(a < b or (a <> b and ra + rb < 6)) and {near}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = forms.select(F.col("form_id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in cols[1:]))
    right = forms.select(F.col("form_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in cols[1:]))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, weight, heavy = sent.value
        for x in batches:
            out = []
            for a_, b_, *f in x.itertuples(index=False, name=None):
                how = relation(_form(*f[:5]), _form(*f[5:]), weight, heavy)
                if how:
                    out.append((b_, a_, 2) if how == 3 else (a_, b_, how))
            yield pd.DataFrame(out, columns=["a", "b", "how"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", *(f"{c}_a" for c in cols[1:]), *(f"{c}_b" for c in cols[1:]))
    return both.mapInPandas(verify, "a bigint, b bigint, how int")


def _joining(fits: DataFrame) -> DataFrame:
    """``(e, to)`` of the entities that fit one other; one whose target joins another entity waits for that."""
    one = fits.groupBy("x").agg(F.min("y").alias("y"), F.count("*").alias("k")).where("k = 1").select("x", "y")
    out = one.join(one.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").where("z is null or (z = x and y < x)")
    return out.select(F.col("x").alias("e"), F.col("y").alias("to"))


@tidy
def entities(names: DataFrame, name: str = "val") -> tuple[DataFrame, DataFrame]:
    """``(spellings, also)``: ``(val, middle, entity)`` for every distinct spelling, and ``(entity, other)`` where a spelling that says less may stand for several entities.

    What says less and fits one entity belongs to it, until nothing changes;
    where it fits several (one family name, one initial, different given
    names) it stays an entity of its own that is linked to each of them.
    Spellings of one entity with different ``middle`` initials are different
    persons.  Null and empty names, and names without a letter or digit, are in
    neither table; an empty table gives two.
    """
    spellings, forms = forms_of(names, name)
    links = materialise(links_of(forms), "links")
    of = components(links.where("how = 1"))
    root = materialise(forms.select(F.col("form_id").alias("node")).join(of, "node", "left").select(F.col("node").alias("form_id"), F.coalesce("root", "node").alias("e")), "roots")
    open_ = links.where("how = 2").select("a", "b")
    while True:
        fits = open_.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b").where("x <> y").select("x", "y").distinct()
        fits = materialise(fits, "fits")
        one = materialise(_joining(fits), "joining")
        if one.isEmpty():
            break
        root = materialise(root.join(one, "e", "left").select("form_id", F.coalesce("to", "e").alias("e")), "roots")
    of = spellings.join(root, "form_id").select("val", "middle", F.col("e").alias("entity"))
    return of, fits.select(F.least("x", "y").alias("entity"), F.greatest("x", "y").alias("other")).distinct()


@tidy
def variant_pairs(names: DataFrame, name: str = "val") -> DataFrame:
    """``(name_a, name_b)``: every pair of different spellings of one person or organisation, the smaller (by code point) first."""
    spellings, also = entities(names, name)
    spellings = materialise(spellings, "spellings")
    x, y = spellings.toDF("name_a", "ma", "entity"), spellings.toDF("name_b", "mb", "other")
    agree = F.expr("ma = mb or ma = '' or mb = ''")
    within = x.join(y.withColumnRenamed("other", "entity"), "entity").where(agree & F.expr("name_a < name_b")).select("name_a", "name_b")
    across = also.join(x, "entity").join(y, "other").where(agree)
    return within.unionByName(across.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")))
