"""Exact and near-duplicate titles by first occurrence, with the greedy rule "a duplicate never stands for others".

A row is a duplicate if an earlier original has its DOI, its normalised title
or a title that is similar enough.  Originals are the lexicographically first
maximal independent set of the match graph, found in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import normalize_title, strip, token_sort
from paperloom.session import drop_materialised, materialise, tidy

#: Similarity (of 100) from which two titles count as one.
THRESHOLD = 92
#: Classes of characters, the most of one that are told apart, and the bits of a title for their counts and for its pairs of characters.
CLASSES, MOST_COUNTED, COUNT_BITS, PAIR_BITS = 96, 255, 320, 1024
#: Titles that get their bits at once, and that are compared with at once.
PIECE, BLOCK = 2_000, 50_000


def first_by_key(records: DataFrame, key: str, order: str) -> DataFrame:
    """``(order, first)`` of each row whose present key occurs in an earlier row, by one aggregation and one join on the key."""
    k = records.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(order).alias("o"), F.col(key).alias("k"))
    first = k.groupBy("k").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1")
    return k.join(first.drop("n"), "k").where("o > first").select(F.col("o").alias(order), "first")


def indel(a: str, b: str) -> int:
    """Insertions and deletions that make ``a`` into ``b``, by the bit-parallel longest common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    s = all_
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & all_
    common = len(a) - s.bit_count()
    return len(a) + len(b) - 2 * common


def _characters(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the strings, and the number of the string each is of."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64), np.repeat(np.arange(len(strings)), sizes)


def _counts(strings: Sequence[str]) -> np.ndarray:
    """How often each string has each class of characters; letters, digits and the space are classes of their own."""
    chars, row = _characters(strings)
    return np.bincount(row * CLASSES + chars % CLASSES, minlength=len(strings) * CLASSES).reshape(len(strings), CLASSES)


def count_steps(titles: DataFrame) -> list[tuple[int, int]]:
    """At most ``COUNT_BITS`` steps ``(class, k)``, those first that divide the titles ``(s)`` most evenly into such with ``k`` characters of the class and such with fewer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((CLASSES, MOST_COUNTED), dtype=np.int64)
        rows = 0
        for b in batches:
            for i in range(0, len(b), PIECE):
                c = np.minimum(_counts(b["s"].iloc[i : i + PIECE].tolist()), MOST_COUNTED)
                rows += len(c)
                for k in range(1, int(c.max(initial=0)) + 1):
                    total[:, k - 1] += (c >= k).sum(axis=0)
        at, k = np.nonzero(total)
        yield pd.DataFrame({"at": np.append(at, -1), "k": np.append(k + 1, 0), "n": np.append(total[at, k], rows)})

    found = {(r.at, r.k): r.n for r in titles.select("s").mapInPandas(run, "at int, k int, n bigint").groupBy("at", "k").agg(F.sum("n").alias("n")).collect()}
    rows = found.pop((-1, 0), 0)
    return sorted((x for x in found if found[x] < rows), key=lambda x: (abs(2 * found[x] - rows), x))[:COUNT_BITS]


def signatures(titles: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """``(o, s, n, bits)`` of titles ``(o, s)``: the length, and ``COUNT_BITS`` bits of the steps, then ``PAIR_BITS`` parities of the pairs of neighbouring characters."""
    at, k = np.array([c for c, _ in steps], dtype=np.int64), np.array([k for _, k in steps], dtype=np.int64)

    def bits(strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), COUNT_BITS + PAIR_BITS), dtype=np.uint8)
        out[:, : len(at)] = np.minimum(_counts(strings), MOST_COUNTED)[:, at] >= k
        chars, row = _characters(strings)
        pair = ((chars[:-1] * 31 + chars[1:]) * 0x9E3779B1 >> 12) % PAIR_BITS
        pair = (row[:-1] * PAIR_BITS + pair)[row[:-1] == row[1:]]
        out[:, COUNT_BITS:] = np.bincount(pair, minlength=len(strings) * PAIR_BITS).reshape(len(strings), PAIR_BITS) & 1
        return np.packbits(out, axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), PIECE):
                part = b.iloc[i : i + PIECE]
                yield part.assign(n=part["s"].str.len().astype(np.int32), bits=pd.Series([x.tobytes() for x in bits(part["s"].tolist())], index=part.index, dtype=object))

    return titles.select("o", "s").mapInPandas(run, "o bigint, s string, n int, bits binary")


def _blocks(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]]:
    """``(o, n, bits, strings)`` of the signatures in ``files``, some thousands at a time, each file sorted by ``n``."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    width = (COUNT_BITS + PAIR_BITS) // 8
    for file in files:
        fs, place = FileSystem.from_uri(file)
        with fs.open_input_file(place) as f:
            for b in pq.ParquetFile(f).iter_batches(BLOCK, columns=["o", "s", "n", "bits"]):
                fixed = b["bits"].cast(pa.binary(width))
                words = np.frombuffer(fixed.buffers()[1], dtype=np.uint64)[fixed.offset * width // 8 :][: len(b) * width // 8].reshape(len(b), -1)
                yield b["o"].to_numpy(), b["n"].to_numpy(), words, lambda at, s=b["s"]: s.take(at).to_pylist()


def similar_pairs(titles: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(a, b)``, a < b, of distinct token-sorted titles ``(o, s)`` with ``100 * (1 - indel / (len a + len b)) >= threshold``; exact.

    An edit changes one character count by one, so it flips one bit at most of
    those that say whether a title has ``k`` of a character, and three at most
    of the parities of its pairs of neighbours.  Titles are written sorted by
    length; each task compares its share with all of the lengths that can be
    similar, two words of bits for every pair and the others for what is left,
    then the strings.  So the comparisons grow with the square of the titles,
    but a pair only becomes a row when it is known to be similar.
    """
    t = titles.where("s <> ''").select("o", "s")
    t = signatures(t, count_steps(t))
    t = materialise(t.repartitionByRange("n", "o").sortWithinPartitions("n"), "signatures")
    files, free, words = sorted(t.inputFiles()), 100 - threshold, COUNT_BITS // 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("n", kind="stable")
            xs, strings = b["o"].to_numpy(), b["s"].tolist()
            nx, bx = b["n"].to_numpy(), np.frombuffer(b"".join(b["bits"]), dtype=np.uint64).reshape(len(b), -1)
            lengths, first = np.unique(nx, return_index=True)
            for ys, ny, by, text in _blocks(files):
                lead = np.ascontiguousarray(by[:, :2].T)
                apart, more = np.empty(len(ny), dtype=np.uint8), np.empty(len(ny), dtype=np.uint8)
                flips = np.empty(len(ny), dtype=np.uint64)
                met: list[tuple[np.ndarray, np.ndarray]] = []

                def similar(met: list[tuple[np.ndarray, np.ndarray]] = met, ys=ys, ny=ny, by=by, text=text) -> pd.DataFrame:
                    i, j = (np.concatenate(x) for x in zip(*met, strict=True))
                    met.clear()
                    room = (nx[i] + ny[j]) * free // 100
                    ok = np.bitwise_count(bx[i, :words] ^ by[j, :words]).sum(axis=1) <= room
                    i, j, room = i[ok], j[ok], room[ok]
                    ok = (np.bitwise_count(bx[i, words:] ^ by[j, words:]).sum(axis=1) <= 3 * room) & ((nx[i] < ny[j]) | (xs[i] < ys[j]))
                    i, j, room = i[ok], j[ok], room[ok]
                    yes = [indel(strings[p], y) <= r for p, y, r in zip(i.tolist(), text(j), room.tolist(), strict=True)]
                    return pd.DataFrame({"a": np.minimum(xs[i], ys[j])[yes], "b": np.maximum(xs[i], ys[j])[yes]})

                waiting = 0
                for n, start, stop in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(b)], strict=True):
                    low, high = np.searchsorted(ny, n, "left"), np.searchsorted(ny, n * (100 + free) // threshold, "right") if threshold > 0 else len(ny)
                    if low >= high:
                        continue
                    (one, two), d, e, x = lead[:, low:high], apart[: high - low], more[: high - low], flips[: high - low]
                    room = np.minimum((n + ny[low:high].astype(np.int64)) * free // 100, 128).astype(np.uint8)
                    for i in range(start, stop):
                        np.bitwise_count(np.bitwise_xor(one, bx[i, 0], out=x), out=d)
                        np.bitwise_count(np.bitwise_xor(two, bx[i, 1], out=x), out=e)
                        np.add(d, e, out=d)
                        j = np.flatnonzero(d <= room) + low
                        if len(j):
                            met.append((np.full(len(j), i), j))
                            waiting += len(j)
                        if waiting > 100_000:
                            yield similar()
                            waiting = 0
                if waiting:
                    yield similar()

    tasks = 4 * int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(tasks, "o").mapInPandas(run, "a bigint, b bigint")


def greedy_leaders(members: DataFrame) -> DataFrame:
    """``(o, leader)`` for every node of the groups ``(g, o)`` in which all members match each other: the first maximal independent set.

    In each round a group yields its earliest leader and its earliest open
    node; a node after a leader of one of its groups is a duplicate, and one
    before all other leaders and open nodes of its groups is a leader.  No
    pair is ever made, so a round is linear in the memberships.  Every round
    decides the earliest open node at least, and rounds go on until none is
    open; a chain of titles each like the next takes a round for two of them.
    """
    state = materialise(members.select("o").distinct().withColumn("leader", F.lit(None).cast("boolean")), "state")
    while True:
        if state.where("leader is null").isEmpty():
            break
        group = members.join(state, "o").groupBy("g").agg(F.min(F.when(F.col("leader"), F.col("o"))).alias("lead"), F.min(F.when(F.col("leader").isNull(), F.col("o"))).alias("open"))
        seen = members.join(state.where("leader is null").select("o"), "o").join(group, "g")
        led = F.coalesce(F.col("lead") < F.col("o"), F.lit(False))
        seen = seen.groupBy("o").agg(F.max(led).alias("dup"), F.max(led | F.coalesce(F.col("open") < F.col("o"), F.lit(False))).alias("waits"))
        new = state.join(seen, "o", "left")
        decided = F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.col("dup"), F.lit(False)).when(~F.col("waits"), F.lit(True))
        old, state = state, materialise(new.select("o", decided.alias("leader")), "state")
        drop_materialised(old)
    return state


@tidy
def deduplicate(records: DataFrame, order: str = "ord", doi: str = "doi", title: str = "title", threshold: int = THRESHOLD, fuzzy: bool = True) -> DataFrame:
    """``(order, duplicate_of)``: the original of every row, null for originals.

    The DOI match is preferred, then the title's, then the earliest similar
    original.  Rows without DOI and title are originals; ``order`` is unique.
    Equal titles are one entry of the similarity join, and two similar titles
    with all their rows are one group.
    """
    r = records.select(F.col(order).cast("bigint").alias("o"), F.lower(strip(doi)).alias("d"), normalize_title(title).alias("t"))
    r = materialise(r.withColumn("s", token_sort("t")), "keys")
    members = None
    for kind, key in ((0, "d"), (1, "t")):
        k = r.where(F.col(key) != "").select(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), key).alias("g"), "o")
        members = k if members is None else members.unionByName(k)
    if fuzzy:
        one = r.where("s <> ''").groupBy("s").agg(F.min("o").alias("o"))
        near = materialise(similar_pairs(one, threshold), "near")
        ends = near.select(F.explode(F.array("a", "b")).alias("rep"), F.xxhash64(F.lit(2), "a", "b").alias("g"))
        ends = ends.unionByName(one.select(F.col("o").alias("rep"), F.xxhash64(F.lit(2), "o").alias("g")))
        same = r.where("s <> ''").select("o", "s").join(one.withColumnRenamed("o", "rep"), "s").select("o", "rep")
        members = members.unionByName(ends.join(same, "rep").select(F.lit(2).alias("kind"), "g", "o"))
    many = members.groupBy("g").count().where("count > 1").select("g")
    members = materialise(members.join(many, "g", "left_semi"), "members")
    leaders = greedy_leaders(members.select("g", "o"))
    lead = leaders.where("leader").select("o")
    of = members.join(lead, "o", "left_semi").groupBy("kind", "g").agg(F.min("o").alias("lead"))
    dup = members.join(leaders.where("not leader").select("o"), "o", "left_semi").join(of, ["kind", "g"]).where("lead < o")
    dup = dup.groupBy("o").agg(F.min_by("lead", F.struct("kind", "lead")).alias("duplicate_of"))
    return r.select("o").join(dup, "o", "left").select(F.col("o").alias(order), "duplicate_of")
