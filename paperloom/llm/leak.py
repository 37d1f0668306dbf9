"""Problem 6: test items inside training documents, by size-partitioned min-hash containment search.

Each item is a set of word triples.  Items are partitioned by the size of that
set; an item keeps the bottom-k min-hash sketch that its partition needs to hit
a passage of the wanted containment with the recall target: short items need
their whole set, long ones some forty triples whatever their length.  Every triple of every
document probes the sketches; a hit fixes where the item would start in the
document, and the passage there is verified word by word.

Items go to the tasks in chunks of at most ``CHUNK_TRIPLES`` sketch entries;
more items mean more passes over the documents, never a larger broadcast.
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

from paperloom.session import materialise

SHINGLE = 3
CONTAINMENT = 0.5
REPLACED = 2
RECALL = 0.9999
CHUNK_TRIPLES = 4_000_000
#: First words that this many different texts share are an opening; three words that stand between as many different neighbours are a turn of speech (see :func:`marked`).
SHARED_BY = 3
#: Matched words outside the opening and turns of speech that a passage with opening words needs.
OWN_WORDS = 3
#: Stray words (a page number, a running line) that may stand once inside a passage.
STRAY = 12

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"[-‐‑\xad]\s*\n\s*")
_HYPHENS = dict.fromkeys(map(ord, "-‐‑\xad​﻿'’"))


def passage_words(text: str | None) -> list[str]:
    """Lower-cased words, with words broken at a line end and hyphened ones made whole; [] for null or empty."""
    if not text:
        return []
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.translate(_HYPHENS).lower())


def sketch_size(words: int, containment: float = CONTAINMENT, recall: float = RECALL) -> int:
    """Triples of an item of so many words that its sketch holds: of any passage of the containment, with its replaced words, the larger of two parts that a stray line cuts it into shows one of them with probability ``recall``."""
    n = words - SHINGLE + 1
    intact = math.ceil(math.ceil(words * containment) / 2) - SHINGLE + 1 - REPLACED * SHINGLE
    if intact < 1:
        return max(0, n)
    missed, k = 1.0, 0
    while missed > 1 - recall and k < n:
        missed *= max(0, n - intact - k) / (n - k)
        k += 1
    return k


def _hash(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(17))


class ItemIndex:
    """The sketches of one chunk of items; ``marks`` has the number of opening words of each and where its turns of speech begin."""

    def __init__(self, items: list[tuple[int, list[str]]], marks: list[tuple[int, list[int]]] | None = None):
        self.vocabulary: dict[str, int] = {}
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], dtype=np.int64) for _, ws in items]
        self.base = len(self.vocabulary) + 1
        triples = [self.triples(w) for w in self.words]
        marks = marks or [(0, [])] * len(items)
        self.opening, self.own, self.fresh = [n for n, _ in marks], [], []
        for w, (n, turns) in zip(self.words, marks, strict=True):
            outside = np.arange(len(w)) >= n
            own = outside.copy()
            for p in turns:
                own[p : p + SHINGLE] = False
            self.own.append(own if own.any() else outside)
            fresh = outside[SHINGLE - 1 :].copy()  # triples that are neither opening nor turn of speech
            fresh[turns if own.any() else []] = False
            self.fresh.append(fresh)
        keys, item, at = [], [], []
        largest: dict[int, int] = {}
        for w in self.words:  # partitions: up to 2, 4, 8, ... words
            part = len(w).bit_length()
            largest[part] = max(largest.get(part, 0), sketch_size(len(w)))
        self.whole = [len(t) <= largest[len(w).bit_length()] for t, w in zip(triples, self.words, strict=True)]
        for k, t in enumerate(triples):
            if not len(t):
                continue
            kept = np.argsort(_hash(t), kind="stable")[: largest[len(self.words[k]).bit_length()]]
            keys.append(t[kept])
            item.append(np.full(len(kept), k))
            at.append(kept)
        empty = [np.zeros(0, dtype=np.int64)]
        keys, item, at = (np.concatenate(x or empty) for x in (keys, item, at))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], item[order], at[order]

    def triples(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < SHINGLE:
            return np.zeros(0, dtype=np.int64)
        return (ids[:-2] * self.base + ids[1:-1]) * self.base + ids[2:]

    def found_in(self, words: list[str]) -> list[int]:
        """The items of which a text holds a passage."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        t = self.triples(ids)
        if not len(t) or not len(self.keys):
            return []
        low = np.searchsorted(self.keys, t, "left")
        hit = np.flatnonzero((low < len(self.keys)) & (self.keys[np.minimum(low, len(self.keys) - 1)] == t))
        if not len(hit):
            return []
        high = np.searchsorted(self.keys, t[hit], "right")
        count = high - low[hit]
        where = np.repeat(hit, count)
        entry = np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
        starts: dict[int, dict[int, int]] = {}
        for k, s in zip(self.item[entry].tolist(), (where - self.at[entry]).tolist(), strict=True):
            of = starts.setdefault(k, {})
            of[s] = of.get(s, 0) + 1
        return [int(self.ids[k]) for k, of in starts.items() if self._passage(k, of, ids)]

    def _equal(self, k: int, start: int, ids: np.ndarray) -> np.ndarray:
        w = self.words[k]
        out = np.zeros(len(w), dtype=bool)
        a, b = max(0, start), min(len(ids), start + len(w))
        if a < b:
            out[a - start : b - start] = ids[a:b] == w[a - start : b - start]
        return out

    def _passage(self, k: int, starts: dict[int, int], ids: np.ndarray) -> bool:
        n, own = len(self.words[k]), (self.own[k], self.fresh[k], self.opening[k])
        need = math.ceil(n * CONTAINMENT)
        rows = {s: self._equal(k, s, ids) for s in starts}
        if any(_holds(e, own, need) for e in rows.values()):
            return True
        # a stray line inside the passage shifts what follows it; of a sampled item the smaller part may show no triple
        for s, row in rows.items():
            if int(row.sum()) < (need - REPLACED) / 2:
                continue
            near = [t for t in rows if 0 < abs(t - s) <= STRAY] if self.whole[k] else [t for t in range(s - STRAY, s + STRAY + 1) if t != s]
            for t in near:
                first, second = min(s, t), max(s, t)
                x, y = (rows[u] if u in rows else self._equal(k, u, ids) for u in (first, second))
                if int((x | y).sum()) >= need - REPLACED:
                    for cut in range(2, n - 1):
                        if _holds(np.concatenate([x[:cut], y[cut:]]), own, need):
                            return True
        return False


def _holds(equal: np.ndarray, marks: tuple[np.ndarray, np.ndarray, int], need: int) -> bool:
    """Whether some stretch of ``need`` words or more, ends matched, has at most ``REPLACED`` misses and, if it begins in the opening, enough words of the item's own and an unbroken triple of words not wholly of the opening or a turn of speech."""
    hit = np.flatnonzero(equal)
    if len(hit) < max(1, need - REPLACED):
        return False
    own, fresh, opening = marks
    sums = np.concatenate([[0], np.cumsum(equal & own)])
    whole = np.concatenate([[0], np.cumsum(equal[:-2] & equal[1:-1] & equal[2:] & fresh)])
    least = min(OWN_WORDS, max(1, int(own.sum())))
    for i in range(len(hit)):
        j = i
        while j + 1 < len(hit) and (hit[j + 1] - hit[i]) - (j + 1 - i) <= REPLACED:
            j += 1
        if hit[j] - hit[i] + 1 >= need and (hit[i] >= opening or (sums[hit[j] + 1] - sums[hit[i]] >= least and whole[max(hit[i], hit[j] - 1)] > whole[hit[i]])):
            return True
    return False


def _hashes(words: list[str]) -> list[int]:
    """A signed 64-bit hash of the first 1, 2, 3, ... words."""
    h, out = hashlib.blake2b(digest_size=8), []
    for w in words:
        h.update(w.encode("utf-8", "surrogatepass") + b" ")
        out.append(int.from_bytes(h.copy().digest(), "big", signed=True))
    return out


def marked(items: DataFrame, item: str, text: str) -> DataFrame:
    """``(item, text, opening, turns)`` of the items with a triple of words: what is no evidence beside an opening, and the opening's length.

    The opening is the longest beginning, of at least ``SHINGLE`` words and less than
    half the item, that ``SHARED_BY`` different texts share, those that also
    share the item's first half counted as one: a beginning of half the
    item or more is a common passage.  ``turns`` are the places of triples that
    stand between ``SHARED_BY`` different pairs of neighbours; inside a common
    passage the neighbours are the same.  All items are counted, each text
    once, so copies of an item and the chunks make no difference.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [passage_words(t) for t in b[text]]
            b = b.assign(key=[_hashes([" ".join(x)])[0] for x in w])
            yield b[[len(x) >= SHINGLE for x in w]]

    def beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, t in zip(b["key"], b[text], strict=True):
                p = _hashes(passage_words(t))
                half = math.ceil(len(p) * CONTAINMENT)
                rows += [(key, k, h, k == half, SHINGLE <= k < half) for k, h in enumerate(p, 1) if k >= SHINGLE or k == half]
            yield pd.DataFrame(rows, columns=["key", "k", "p", "half", "short"])

    def triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, t in zip(b["key"], b[text], strict=True):
                w = ["", *passage_words(t), ""]
                rows += [(key, k, " ".join(w[k + 1 : k + 1 + SHINGLE]), f"{w[k]} {w[k + 1 + SHINGLE]}") for k in range(len(w) - SHINGLE - 1)]
            yield pd.DataFrame(rows, columns=["key", "at", "t", "between"])

    known = materialise(items.select(F.col(item).cast("bigint").alias(item), text).where(F.col(item).isNotNull()).mapInPandas(keyed, f"{item} bigint, {text} string, key bigint"), "items")
    texts = materialise(known.dropDuplicates(["key"]).select("key", text), "texts")
    each = materialise(texts.mapInPandas(beginnings, "key bigint, k int, p bigint, half boolean, short boolean"), "beginnings")
    counted = each.where("half or short").join(each.groupBy("p").agg(F.count("*").alias("n")), "p")
    half = counted.where("half").select("key", F.col("n").alias("same"))
    opening = counted.where("short").join(half, "key").where(F.col("n") - F.col("same") >= SHARED_BY - 1).groupBy("key").agg(F.max("k").alias("opening"))
    stand = materialise(texts.mapInPandas(triples, "key bigint, at int, t string, between string"), "triples")
    turns = stand.select("t", "between").distinct().groupBy("t").count().where(F.col("count") >= SHARED_BY)
    turns = stand.join(turns, "t", "left_semi").groupBy("key").agg(F.collect_list("at").alias("turns"))
    out = known.join(opening, "key", "left").join(turns, "key", "left")
    return out.select(item, text, F.coalesce("opening", F.lit(0)).alias("opening"), F.coalesce("turns", F.array().cast("array<int>")).alias("turns"))


def leaked(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc, item)``: each document that holds at least half of an item's words as one passage, at most two of them replaced.

    Null or empty texts and items without a triple of words are never found;
    an item that stands in several places of a document gives one row.
    """
    spark = documents.sparkSession
    out = None
    for chunk in _chunks(materialise(marked(items, item, item_text), "marked")):
        index = spark.sparkContext.broadcast(ItemIndex([x[:2] for x in chunk], [x[2:] for x in chunk]))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(d, i) for d, t in zip(b["_d"], b["_t"], strict=True) if t for i in index.value.found_in(passage_words(t))]
                yield pd.DataFrame(rows, columns=[doc, item])

        found = documents.select(F.col(doc).cast("bigint").alias("_d"), F.col(text).alias("_t")).mapInPandas(run, f"{doc} bigint, {item} bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{doc} bigint, {item} bigint")
    return out.distinct()


def _chunks(items: DataFrame) -> Iterator[list[tuple[int, list[str], int, list[int]]]]:
    """The items in blocks that keep a broadcast below its bound; the driver holds one block at a time."""
    block: list[tuple[int, list[str], int, list[int]]] = []
    size = 0
    for i, t, opening, turns in items.toLocalIterator():
        w = passage_words(t)
        if block and size + len(w) > CHUNK_TRIPLES:
            yield block
            block, size = [], 0
        block.append((i, w, opening, turns))
        size += len(w)
    if block:
        yield block


def report(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item, n_docs, first_doc)`` for every item, also those that leaked nowhere."""
    n = leaked(documents, items, doc, text, item, item_text).groupBy(item).agg(F.count("*").alias("n_docs"), F.min(doc).alias("first_doc"))
    return items.select(F.col(item).cast("bigint").alias(item)).distinct().join(n, item, "left").select(item, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc")
