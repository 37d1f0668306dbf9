"""Problem 4: near-duplicate records, found by pigeonring filtering on a vector of min-hashes.

A record's abstract becomes a vector of ``SYMBOLS`` min-hashes of its bag of
words (a word's repeats are elements of their own), so the share of symbols in
which two vectors agree estimates just the similarity that is asked for,
whatever the order of the words.  The vector is cut into ``SEGMENTS`` segments
on a ring.  By the pigeonring principle, two vectors that differ in at most
``HAMMING`` symbols have a place on the ring from which the first l segments
together hold at most ``l * HAMMING / SEGMENTS`` differences for every l; the
first of them is then equal.  So equal segments of records with like titles
are joined, pairs whose chain breaks its budget are dropped before the full
Hamming check, and what is left is verified on the texts.  Of pairs at the
least similarity, ``HAMMING`` differences or fewer hold for 0.999.

Titles are classed first, by the prefix-tree hash forest; the class is part of
the key, so one boilerplate abstract under many titles makes no pairs.  Records
of one canonical title and one bag of words are one class with one vector:
copies never meet in the join.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.history import Corrector, HistoryForest, _mix, hash_word
from paperloom.llm.textforms import same_title, text_words, title_tokens
from paperloom.session import materialise, tidy

SYMBOLS, SEGMENTS = 36, 18
#: The full Hamming budget in symbols, and the segments of a chain that are looked at before it.
HAMMING, CHAIN = 17, 4
SIMILARITY = 0.75
_WIDTH = SYMBOLS // SEGMENTS
#: Numbers of records that the driver sends to pick their texts; more are joined.
SENT = 500_000

_SEED = np.random.default_rng(11).integers(1, 2**63, size=(2, SYMBOLS), dtype=np.uint64) | np.uint64(1)
_hashes: dict[str, int] = {}


def elements(words: list[str]) -> np.ndarray:
    """Hashes of the elements of a bag of words: each word with the number of its repeat."""
    if len(_hashes) > 1_000_000:
        _hashes.clear()
    seen: dict[str, int] = {}
    out = []
    for w in words:
        k = seen.get(w, 0)
        seen[w] = k + 1
        h = _hashes.get(w)
        if h is None:
            h = _hashes[w] = hash_word(w)
        out.append(h + k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF if k else h)
    return _mix(np.array(out, dtype=np.uint64))


def vector(bag: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` unsigned 64-bit min-hashes of the elements of a bag."""
    return _mix(bag[:, None] * _SEED[0] + _SEED[1]).min(axis=0)


def shared(x: list[str], y: list[str]) -> float:
    """Shared words of two bags divided by all words of both taken once."""
    a, b = Counter(x), Counter(y)
    both = sum((a & b).values())
    return both / max(1, len(x) + len(y) - both)


def _class_of(canon: str, bag: np.ndarray) -> int:
    key = int(bag.sum(dtype=np.uint64)) ^ int.from_bytes(hashlib.blake2b(canon.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    return key - (1 << 64) if key >> 63 else key


def keys(records: DataFrame, no: str = "cand_no", title: str = "title", text: str = "abstract") -> DataFrame:
    """``(no, class, canon)`` of :func:`classes`, without what only records of like titles need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, t, a in zip(b[no], b[title], b[text], strict=True):
                if not t or not a:
                    continue
                c, w = title_tokens(t), text_words(a)
                if c and w:
                    c = " ".join(c)
                    out.append((n, _class_of(c, elements(w)), c))
            yield pd.DataFrame(out, columns=["no", "class", "canon"])

    return records.select(F.col(no).cast("bigint").alias(no), title, text).mapInPandas(run, "no bigint, class bigint, canon string")


def classes(records: DataFrame, no: str = "cand_no", title: str = "title", text: str = "abstract") -> DataFrame:
    """``(no, class, canon, words, symbols, segments)`` for the rows with a title and a text: a hash of title and bag of words, the canonical title, the text's words in order, one byte of each symbol, and the segments' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, low, cut = [], [], []
            for n, t, a in zip(b[no], b[title], b[text], strict=True):
                if not t or not a:
                    continue
                c, w = title_tokens(t), text_words(a)
                if c and w:
                    bag, c = elements(w), " ".join(c)
                    v = vector(bag)
                    out.append((n, _class_of(c, bag), c, " ".join(w)))
                    low.append(v.astype(np.uint8).tobytes())
                    cut.append(v.reshape(SEGMENTS, _WIDTH))
            got = pd.DataFrame(out, columns=["no", "class", "canon", "words"]).assign(symbols=pd.Series(low, dtype=object))
            k = np.stack(cut) if cut else np.zeros((0, SEGMENTS, _WIDTH), dtype=np.uint64)
            whole = k[:, :, 0]
            for i in range(1, _WIDTH):
                whole = _mix(whole) + k[:, :, i]
            got["segments"] = pd.Series(list(whole.astype(np.int64)), dtype=object)
            yield got

    return records.select(F.col(no).cast("bigint").alias(no), title, text).mapInPandas(run, "no bigint, class bigint, canon string, words string, symbols binary, segments array<bigint>")


def title_classes(reps: DataFrame) -> tuple[DataFrame, set[str]]:
    """``(no, like)`` of the representatives ``(no, canon)`` that are not alone in their class of like titles (one but for slips, directly or through others), and the words in wide use."""
    titles = materialise(reps.groupBy("canon").agg(F.min("no").alias("cid"), F.count("*").alias("n")), "titles")
    forest = HistoryForest(reps.sparkSession)
    links = forest.accept(titles.select("cid", "canon"))
    forest.drop()
    of = components(links).toDF("cid", "root")
    like = materialise(titles.join(of, "cid", "left").select("canon", F.coalesce("root", "cid").alias("like"), "n"), "like")
    several = like.groupBy("like").agg(F.sum("n").alias("k")).where("k > 1").select("like")
    return reps.select("no", "canon").join(like.join(several, "like", "left_semi").select("canon", "like"), "canon").select("no", "like"), forest.common


def ring_pairs(reps: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of like titles that share a segment and whose chain from there stays within its budget; of ``(no, like, symbols, segments)``."""
    ring = F.concat("symbols", F.substring("symbols", 1, CHAIN * _WIDTH))
    seg = reps.select("no", "like", ring.alias("ring"), F.posexplode("segments").alias("at", "hash")).select("no", F.xxhash64("at", "hash", "like").alias("key"), F.expr(f"substring(ring, at * {_WIDTH} + {_WIDTH + 1}, {(CHAIN - 1) * _WIDTH})").alias("follow"))
    met = seg.select("key", F.col("no").alias("a"), F.col("follow").alias("fa")).join(seg.select("key", F.col("no").alias("b"), F.col("follow").alias("fb")), "key").where("a < b")
    so_far, ok = F.lit(0), F.lit(True)
    for k in range(CHAIN - 1):
        for i in range(k * _WIDTH + 1, (k + 1) * _WIDTH + 1):
            so_far = so_far + F.when(F.substring("fa", i, 1) == F.substring("fb", i, 1), 0).otherwise(1)
        ok = ok & (so_far <= F.lit((k + 2) * HAMMING // SEGMENTS))
    return met.where(ok).select("a", "b").distinct()


def representative_pairs(records: DataFrame, reps: DataFrame, similarity: float = SIMILARITY, no: str = "cand_no", title: str = "title", text: str = "abstract") -> DataFrame:
    """``(a, b)`` of different classes' representatives ``(no, canon)`` that carry nearly the same text and title.

    Only records with a like title get words and a vector; they are taken from
    ``records`` once it is known which they are, so no table holds all texts.
    """
    like, common = title_classes(reps)
    like = materialise(like, "like")
    sent = reps.sparkSession.sparkContext.broadcast(frozenset(common))
    few = F.broadcast(like) if like.count() <= SENT else like
    of = records.select(F.col(no).cast("bigint").alias("no"), F.col(title).alias("title"), F.col(text).alias("abstract")).join(few, "no", "left_semi")
    wanted = materialise(classes(of, "no").join(like, "no").select("no", "like", "canon", "words", "symbols", "segments"), "wanted")
    pairs = ring_pairs(wanted.select("no", "like", "symbols", "segments"))
    t = wanted.select("no", "canon", "words", "symbols")
    both = pairs.join(t.toDF("a", "ca", "wa", "va"), "a").join(t.toDF("b", "cb", "wb", "vb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        correct = Corrector(sent.value)
        for b in batches:
            yes = []
            for ca, cb, wa, wb, va, vb in zip(b["ca"], b["cb"], b["wa"], b["wb"], b["va"], b["vb"], strict=True):
                apart = int((np.frombuffer(va, np.uint8) != np.frombuffer(vb, np.uint8)).sum())
                yes.append(apart <= HAMMING and same_title(ca.split(" "), cb.split(" "), sent.value, alike=correct.alike) and shared(wa.split(" "), wb.split(" ")) >= similarity)
            yield b.loc[yes, ["a", "b"]]

    return both.select("a", "b", "ca", "cb", "wa", "wb", "va", "vb").mapInPandas(run, "a bigint, b bigint")


@tidy
def near_duplicates(records: DataFrame, no: str = "cand_no", title: str = "title", text: str = "abstract", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``(no, rep)`` for every row with a title and a text, and ``(a, b)`` between representatives.

    Rows without a title or a text are in neither table.  Exact copies (and
    copies that differ in markup or case) share a representative; no link
    between different texts is dropped and none is expanded over copies.
    """
    rows = materialise(keys(records, no, title, text), "keys")
    of = materialise(rows.groupBy("class").agg(F.min("no").alias("rep"), F.min_by("canon", "no").alias("canon")), "reps")
    members = materialise(rows.select("no", "class").join(of.select("class", "rep"), "class").select("no", "rep"), "members")
    links = materialise(representative_pairs(records, of.select(F.col("rep").alias("no"), "canon"), similarity, no, title, text), "links")
    return members, links


@tidy
def groups(records: DataFrame, no: str = "cand_no", title: str = "title", text: str = "abstract") -> DataFrame:
    """``(no, group_no, n_links)`` for every row with a title and a text: the smallest row of its group and its representative's links to other classes."""
    members, links = near_duplicates(records, no, title, text)
    of = components(links)
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = members.join(of.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select(F.col("no").alias(no), F.coalesce("root", "rep").alias("group_no"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@tidy
def row_pairs(records: DataFrame, no: str = "cand_no", title: str = "title", text: str = "abstract") -> DataFrame:
    """``(cand_a, cand_b)``: every pair of rows, copies included.  For reports that need the pairs themselves; :func:`near_duplicates` stays linear in the copies."""
    members, links = near_duplicates(records, no, title, text)
    within = members.toDF("cand_a", "rep").join(members.where("no <> rep").toDF("cand_b", "rep"), "rep").where("cand_a < cand_b").select("cand_a", "cand_b")
    across = links.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b")
    return within.unionByName(across.select(F.least("x", "y").alias("cand_a"), F.greatest("x", "y").alias("cand_b")))
