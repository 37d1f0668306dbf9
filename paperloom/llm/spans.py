"""Problem 8: long exact spans shared between records, by fixed-block anchors.

Every record is cut into non-overlapping reference blocks of half the wanted
length, so a shared span of ``SPAN`` characters always holds one whole block of
either record.  The blocks are indexed by a rolling hash, every rolling window
of every record probes the index, and hits are extended to maximal exact
repeats on the texts themselves.

Probing goes through a bit filter of the index in the shared folder, which the
executors read from there: it holds a fixed number of bits per block, and the
index is probed in as many passes as keep one filter below ``FILTER_BLOCKS``
blocks.  Where that would take more than ``MOST_PASSES`` passes, all window
hashes are shuffled instead.  Either way every window meets the whole index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import materialise, tidy

SPAN = 300
BITS_PER_BLOCK = 32
FILTER_BLOCKS = 16_000_000
MOST_PASSES = 16

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        base = np.full(size, _P if which == "up" else _INV, dtype=np.uint64)
        base[0] = 1
        have = _powers[which] = np.multiply.accumulate(base)
    return have[:n]


def prefix_hashes(text: str) -> np.ndarray:
    """``h[i]`` covers the first i characters, modulo 2**64."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(29)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _power("up", len(codes)), out=out[1:])
    return out


def window_hashes(h: np.ndarray, starts: np.ndarray | slice, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` characters at ``starts`` (a slice: of all from 0)."""
    n = len(h) - 1
    if isinstance(starts, slice):
        got = (h[width:] - h[: n - width + 1]) * _power("down", n - width + 1)
    else:
        got = (h[starts + width] - h[starts]) * _power("down", n + 1)[starts]
    got ^= got >> np.uint64(32)
    got *= np.uint64(0xE9846AF9B1A615D5)
    got ^= got >> np.uint64(29)
    return got


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return h & mask, (h >> np.uint64(24)) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(20) & mask


_loaded: dict[str, np.ndarray] = {}


def _load_filter(path: str, size: int) -> np.ndarray:
    """The filter's bytes, read once per Python worker from the shared folder; an earlier filter is let go."""
    got = _loaded.get(path)
    if got is None:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        _loaded.clear()
        fs, place = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
        t = pq.read_table(place, filesystem=fs, columns=["word", "bits"])
        words = np.zeros(size // 64, dtype=np.int64)
        words[t["word"].to_numpy()] = t["bits"].to_numpy()
        got = _loaded[path] = words.view(np.uint8)
    return got


def _blocks(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs = [np.zeros(0, dtype=np.uint64)]
            for t in b["text"]:
                h = prefix_hashes(t)
                hs.append(window_hashes(h, np.arange(0, len(h) - width, width), width))
            yield pd.DataFrame({"h": np.concatenate(hs).astype(np.int64)})

    return texts.select("text").mapInPandas(run, "h bigint")


def _filter_table(blocks: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = _bits(b["h"].to_numpy().astype(np.uint64), size)
            at = np.concatenate([x, y])
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).astype(np.int64)})

    return blocks.mapInPandas(run, "word bigint, bit bigint").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))


_HITS = "h bigint, no bigint, at int, block boolean, before int, after int, around bigint"


def _hits(texts: DataFrame, width: int, filter_path: str | None, size: int, part: int, parts: int) -> DataFrame:
    """Every window that passes the filter, with hashes of the half blocks before and after it, and of it with a whole block on either side (0 where the text ends before)."""
    half = width // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for no, t in zip(b["no"], b["text"], strict=True):
                h = prefix_hashes(t)
                w = window_hashes(h, slice(None), width)
                at = np.arange(len(w))
                if parts > 1:
                    at = np.flatnonzero((w >> np.uint64(40)) % np.uint64(parts) == np.uint64(part))
                if filter_path:
                    words = _load_filter(filter_path, size)
                    x = (w if parts == 1 else w[at]) & np.uint64(size - 1)
                    at = at[(words[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                    _, y = _bits(w[at], size)
                    at = at[(words[y >> np.uint64(3)] >> (y & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                if len(at):
                    n = len(t)
                    before, after = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                    ok = at >= half
                    before[ok] = window_hashes(h, at[ok] - half, half)
                    ok = at + width + half <= n
                    after[ok] = window_hashes(h, at[ok] + width, half)
                    around = np.zeros(len(at), np.uint64)
                    ok = (at >= width) & (at + 2 * width <= n)
                    around[ok] = window_hashes(h, at[ok] - width, 3 * width) | np.uint64(1)
                    out.append(pd.DataFrame({"around": around.astype(np.int64), "h": w[at].astype(np.int64), "no": no, "at": at.astype(np.int32), "block": at % width == 0, "before": (before & np.uint64(0x7FFFFFFF)).astype(np.int32), "after": (after & np.uint64(0x7FFFFFFF)).astype(np.int32)}))
            if out:
                yield pd.concat(out, ignore_index=True)[[c.split(" ")[0] for c in _HITS.split(", ")]]

    return texts.select("no", "text").mapInPandas(run, _HITS)


def hits_of(texts: DataFrame, width: int) -> DataFrame:
    """All windows of ``width`` that may be a reference block of some text, written once."""
    blocks = materialise(_blocks(texts, width), "blocks")
    n = blocks.count()
    passes = max(1, -(-n // FILTER_BLOCKS))
    found = []
    if passes > MOST_PASSES:
        found.append(_hits(texts, width, None, 0, 0, 1))
    else:
        size = 1 << max(16, (n * BITS_PER_BLOCK // passes - 1).bit_length())
        for part in range(passes):
            own = blocks if passes == 1 else blocks.where(F.shiftrightunsigned("h", 40) % passes == part)
            table = materialise(_filter_table(own, size), "filter")
            path = table.inputFiles()[0].rsplit("/", 1)[0] if n else None
            found.append(_hits(texts, width, path, size, part, passes))
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    return materialise(hits, "hits")


def anchors(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct ``(a, b, at_a, at_b)``, a < b: equal windows of half a span, one of which is a reference block, that may lie in a shared span.

    A span of twice the block's length reaches at least half a block beyond it
    on one side, so hits that agree on neither side are dropped at once.
    """
    hits = hits_of(texts, span // 2)
    ref = hits.where("block").select("h", F.col("no").alias("r"), F.col("at").alias("r_at"), F.col("before").alias("rb"), F.col("after").alias("ra"))
    met = hits.join(ref, "h").where("no <> r and ((before = rb and before <> 0) or (after = ra and after <> 0))")
    return met.select(F.least("no", "r").alias("a"), F.greatest("no", "r").alias("b"), F.when(F.col("no") < F.col("r"), F.col("at")).otherwise(F.col("r_at")).alias("at_a"), F.when(F.col("no") < F.col("r"), F.col("r_at")).otherwise(F.col("at")).alias("at_b")).distinct()


def _common(x: str, i: int, y: str, j: int, way: int) -> int:
    """How many characters agree from i in x and j in y, forwards or (from just before them) backwards."""
    low, high = 0, min(len(x) - i, len(y) - j) if way > 0 else min(i, j)
    while low < high:
        mid = (low + high + 1) // 2
        same = x[i + low : i + mid] == y[j + low : j + mid] if way > 0 else x[i - mid : i - low] == y[j - mid : j - low]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def maximal_repeats(x: str, y: str, at: list[tuple[int, int]], span: int) -> list[tuple[int, int, int]]:
    """``(start_x, start_y, length)`` of the maximal exact repeats of at least ``span`` characters through the given anchors."""
    out: list[tuple[int, int, int]] = []
    end: dict[int, int] = {}
    for i, j in sorted(at):
        if i < end.get(i - j, -1):
            continue
        back, on = _common(x, i, y, j, -1), _common(x, i, y, j, 1)
        end[i - j] = i + on
        if back + on >= span:
            out.append((i - back, j - back, back + on))
    return out


def classed(records: DataFrame, no: str = "doc_id", text: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """``(members, texts)``: ``(no, rep, n)`` for every row whose text has ``span`` characters or more, and the representatives' ``(no, text)``; whole copies share one."""
    rows = records.where(F.length(text) >= span).select(F.col(no).cast("bigint").alias("no"), F.col(text).alias("text"))
    keys = materialise(rows.select("no", F.md5("text").alias("k"), F.length("text").alias("n")), "keys")
    members = materialise(keys.join(keys.groupBy("k", "n").agg(F.min("no").alias("rep")), ["k", "n"]).select("no", "rep", "n"), "members")
    return members, rows.join(members.where("no = rep").select("no"), "no", "left_semi")


@tidy
def shared_spans(records: DataFrame, no: str = "doc_id", text: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """``(members, spans)``: ``(no, rep, n)`` for every row whose text has ``span`` characters or more, and ``(a, b, start_a, start_b, length)`` between representatives.

    Whole copies share a representative and never meet; ``n`` is the text's
    length.  Null and shorter texts are in neither table.
    """
    members, texts = classed(records, no, text, span)
    pairs = anchors(texts, span).groupBy("a", "b").agg(F.collect_list(F.struct("at_a", "at_b")).alias("at"))
    pairs = materialise(pairs, "anchors")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(a, b, *r) for a, b, at, ta, tb in zip(x["a"], x["b"], x["at"], x["ta"], x["tb"], strict=True) for r in maximal_repeats(ta, tb, [(p["at_a"], p["at_b"]) for p in at], span)]
            yield pd.DataFrame(out, columns=["a", "b", "start_a", "start_b", "length"])

    spans = materialise(both.mapInPandas(run, "a bigint, b bigint, start_a int, start_b int, length int"), "spans")
    return members, spans


def shared_parts(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """``(rep, s, e)``: parts of the texts ``(no, text)`` whose union is what stands in spans shared with another text; without pairs of texts.

    Every shared span is covered by windows of half a span that are a reference
    block of one of its texts, each with half a span on either side as far as
    the span reaches.  Texts that agree in a window and all around it are one
    class and share that part at once; only one text of each class, and the
    texts alone, are compared further: by all windows of a whole span that
    hold the block, of which those that two texts have are shared.  So a
    passage in n texts costs n rows.
    """
    width = span // 2
    hits = hits_of(texts, width)
    several = hits.groupBy("h").agg(F.min("no").alias("x"), F.max("no").alias("y")).where("x < y").select("h")
    shared = materialise(hits.select("h", "no", "at", "around").join(several, "h"), "shared")
    alone = F.when(F.col("around") == 0, F.xxhash64("no", "at")).otherwise(F.col("around"))  # cut short by an end of the text
    shared = shared.withColumn("around", alone)
    group = shared.groupBy("h", "around").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    group = materialise(group, "groups")
    whole = shared.join(group.where("first < last").select("h", "around"), ["h", "around"], "left_semi").select(F.col("no").alias("rep"), (F.col("at") - width).alias("s"), (F.col("at") + 2 * width).alias("e"))
    many = group.groupBy("h").count().where("count > 1").select("h")
    one = group.join(many, "h", "left_semi").select("h", "around", F.col("first").alias("no"))
    look = shared.join(one, ["h", "around", "no"], "left_semi").select("no", "at").distinct().groupBy("no").agg(F.collect_list("at").alias("ats"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for no, ats, t in zip(b["no"], b["ats"], b["text"], strict=True):
                h = prefix_hashes(t)
                near = np.asarray(ats, dtype=np.int64)
                starts = np.zeros(len(t) + 2, dtype=np.int32)  # windows that hold a block begin up to half a span before it
                np.add.at(starts, np.maximum(0, near + width - span), 1)
                np.add.at(starts, near + 1, -1)
                at = np.flatnonzero(np.cumsum(starts[: max(0, len(t) - span + 1)]) > 0)
                if len(at):
                    yield pd.DataFrame({"w": window_hashes(h, at, span).astype(np.int64), "no": no, "s": at.astype(np.int32)})

    seen = materialise(look.join(texts, "no").mapInPandas(windows, "w bigint, no bigint, s int"), "windows")
    twice = seen.groupBy("w").agg(F.min("no").alias("x"), F.max("no").alias("y")).where("x < y").select("w")
    parts = seen.join(twice, "w", "left_semi").select(F.col("no").alias("rep"), "s", (F.col("s") + span).alias("e"))
    return whole.unionByName(parts).distinct()


@tidy
def coverage(records: DataFrame, no: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``(no, n_chars, shared_chars)`` for every row: how many of its characters stand in a shared span; a whole copy is shared throughout.

    Null texts have ``n_chars`` and ``shared_chars`` 0.
    """
    members, texts = classed(records, no, text, span)
    parts = shared_parts(texts, span)
    seen = F.max("e").over(Window.partitionBy("rep").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(seen, F.lit(0)))))
    shared = parts.groupBy("rep").agg(F.sum("new").alias("shared"))
    copied = members.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").select("rep", F.lit(True).alias("copied"))
    of = members.join(shared, "rep", "left").join(copied, "rep", "left").select("no", F.when(F.col("copied"), F.col("n")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared"))
    base = records.select(F.col(no).cast("bigint").alias(no), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    return base.join(of.withColumnRenamed("no", "_no"), F.col(no) == F.col("_no"), "left").select(no, "n_chars", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared_chars"))


@tidy
def sharing_pairs(records: DataFrame, no: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """``(doc_a, doc_b)``: every pair of rows with a shared span, whole copies included."""
    members, spans = shared_spans(records, no, text, span)
    m = members.select("no", "rep")
    within = m.toDF("doc_a", "rep").join(m.where("no <> rep").toDF("doc_b", "rep"), "rep").where("doc_a < doc_b").select("doc_a", "doc_b")
    across = spans.select("a", "b").distinct().join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b")
    return within.unionByName(across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")))
