"""Problem 1: new batches against all accepted history, with a prefix-tree hash forest.

A title's features are the letter trigrams of its words, where a rare word that
is one slip away from a word in wide use counts as that word.  ``TREES``
permutations of the features give as many signatures of ``DEPTH`` one-byte
min-hash values.  Accepted titles are kept as runs sorted by tree and
signature (:mod:`paperloom.llm.runs`), with the titles themselves and the DOIs.

A batch locates its entries in every tree by range search: the range of all
signatures with a common prefix.  Prefixes are widened from ``DEPTH`` bytes to
the depth at which pairs of similarity ``SIMILARITY`` are found with the wanted
recall; an entry whose work is found under a longer prefix doesn't widen.  What is
found is verified word by word, the batch becomes a run, and many runs are
merged.  Neither the rows read nor the rows written for a batch grow with the
history, but for merges.

Equal canonical titles of a batch are one entry, so a title that fills a third
of the rows costs one entry a batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.components import components
from paperloom.llm.runs import Reader, by_range, rows_of, size_of, write_run
from paperloom.llm.textforms import MOST_SLIPS, doi_key, same_title, title_tokens, within_one
from paperloom.session import _delete, materialise, shared_dir, tidy

TREES = 10
DEPTH = 8
#: Pairs of this similarity are found with this probability once prefixes are widened.
SIMILARITY, RECALL = 0.82, 0.97
#: A word in this share of the accepted titles (and in so many of them) or more is in wide use; at most ``words per title / share`` words can be.
COMMON_SHARE, COMMON_LEAST = 0.0005, 20
#: Titles whose 64-bit word parities differ in more bits have more slips than a verified pair may have; a slip flips a bit for each of its two forms.
PARITY_BITS = 2 * MOST_SLIPS
#: The trees that hold hashes of whole canonical titles and of DOIs, and the titles themselves by their number.
TITLE_TREE, DOI_TREE, TEXT_TREE = TREES, TREES + 1, TREES + 2

_SEED = np.random.default_rng(7).integers(1, 2**63, size=(2, TREES * DEPTH), dtype=np.uint64) | np.uint64(1)
_TOP = np.uint64(1 << 63)


def prefix_depth(trees: int = TREES, depth: int = DEPTH, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix for which ``trees`` trees find a pair of the given similarity with at least the target probability."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_lowest: dict[str, np.ndarray] = {}


def _grams(tokens: list[str]) -> np.ndarray:
    """Hashes of the letter trigrams of the words, each once."""
    out = set()
    for w in tokens:
        w = f"^{w}$"
        for i in range(len(w) - 2):
            out.add(w[i : i + 3])
    codes = [int.from_bytes(g.encode("utf-32-le", "surrogatepass")[:12].ljust(16, b"\0"), "little") * 0x9E3779B97F4A7C15F39CC0605CEDC835 >> 40 & 0xFFFFFFFFFFFFFFFF for g in out]
    return _mix(np.array(codes, dtype=np.uint64))


def _word_lowest(w: str) -> np.ndarray:
    """The least hash of a word's trigrams under every permutation."""
    got = _lowest.get(w)
    if got is None:
        if len(_lowest) > 50_000:
            _lowest.clear()
        got = _lowest[w] = _mix(_grams([w])[:, None] * _SEED[0] + _SEED[1]).min(axis=0)
    return got


_bits: dict[str, int] = {}


def parity(tokens: list[str]) -> int:
    """A signed 64-bit parity of the words: each word of difference between two lists flips one bit at most."""
    out = 0
    for w in tokens:
        bit = _bits.get(w)
        if bit is None:
            if len(_bits) > 500_000:
                _bits.clear()
            bit = _bits[w] = 1 << (hash_word(w) & 63)
        out ^= bit
    return out - (1 << 64) if out >> 63 else out


def hash_word(w: str) -> int:
    """A hash that is the same in every process."""
    h = 1469598103934665603
    for b in w.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


def tree_keys(tokens: list[str]) -> np.ndarray:
    """One 64-bit key for each tree: ``DEPTH`` min-hash bytes, the first the most significant, moved so that signed numbers keep their order.

    Numbers and words of one or two letters hold no slips, so titles that
    differ in them are different; a hash of those words is mixed into the keys,
    and numbered titles of one pattern do not meet.
    """
    low = np.minimum.reduce([_word_lowest(w) for w in tokens])
    bytes_ = (_mix(low) & np.uint64(0xFF)).astype(np.uint8).reshape(TREES, DEPTH)
    firm = hash_word(" ".join(w for w in tokens if w.isdigit() or len(w) < 3))
    return (np.ascontiguousarray(bytes_).view(">u8").reshape(TREES).astype(np.uint64) ^ _mix(np.array([firm], dtype=np.uint64)) ^ _TOP).view(np.int64)


class Corrector:
    """Words in wide use for rare words that are one slip away from them."""

    def __init__(self, common: set[str] | frozenset[str]):
        self.common, self.known = common, {}
        self.near: dict[str, list[str]] = {}
        for w in sorted(common):
            if len(w) >= 3:
                for x in self._shown(w):
                    self.near.setdefault(x, []).append(w)

    @staticmethod
    def _shown(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    def meant(self, w: str) -> frozenset[str]:
        """The words in wide use that a rare word is one slip away from; none for a word in wide use."""
        if w in self.common or not 3 <= len(w) <= 42 or w.isdigit():
            return frozenset()
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            met = {c for x in self._shown(w) for c in self.near.get(x, ())}
            got = self.known[w] = frozenset(c for c in met if max(len(c), len(w)) >= 4 and not c.isdigit() and within_one(c, w))
        return got

    def __call__(self, w: str) -> str:
        return min(self.meant(w), default=w)

    def alike(self, a: str, b: str) -> bool:
        """Whether two rare words are slips of one word in wide use."""
        return not self.meant(a).isdisjoint(self.meant(b))


def canonical(records: DataFrame, no: str = "cand_no", title: str = "title", doi: str = "doi", id: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(no, *keep, doi_key, canon)``: the bare DOI (of ``doi``, else of an ``id`` made from one) and the canonical title.

    Null or empty titles have ``canon`` null, rows without a DOI ``doi_key``
    null; such rows stay in the result.
    """
    cols = [no, *keep]
    kinds = dict(records.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[cols].copy()
            out["doi_key"] = [doi_key(d) or (doi_key(i) if i and i.startswith("doi:") else None) for d, i in zip(b[doi], b[id], strict=True)]
            out["canon"] = [" ".join(title_tokens(t)) or None for t in b[title]]
            yield out

    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", doi_key string, canon string"
    return records.select(*cols, *(c for c in dict.fromkeys((title, doi, id)) if c not in cols)).mapInPandas(run, schema)


def common_words(titles: DataFrame, canon: str = "canon") -> set[str]:
    """The words in wide use, counted over all distinct titles.

    At most ``words per title / COMMON_SHARE`` words can pass, whatever the
    number of rows; that bound is what lets the result go to every task.
    """
    n = titles.count()
    least = max(COMMON_LEAST, COMMON_SHARE * n)
    words = titles.select(F.explode(F.array_distinct(F.split(canon, " "))).alias("w")).groupBy("w").count().where(F.col("count") >= F.lit(least))
    return {r.w for r in words.collect()}


_KEYS = "tree int, key bigint, cid bigint, parity bigint, words int"
_ENTRY = f"{_KEYS}, canon string"


def forest_rows(titles: DataFrame, common: set[str]) -> DataFrame:
    """The entries of distinct titles ``(cid, canon)``: one for each tree, one with a hash of the whole title and one with the title."""
    sent = titles.sparkSession.sparkContext.broadcast(frozenset(common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        correct = Corrector(sent.value)
        for b in batches:
            tokens = [c.split(" ") for c in b["canon"]]
            if tokens:
                yield pd.DataFrame(
                    {
                        "tree": np.tile(np.arange(TREES, dtype=np.int32), len(tokens)), "key": np.concatenate([tree_keys([correct(w) for w in t]) for t in tokens]), "cid": np.repeat(b["cid"].to_numpy(), TREES),
                        "parity": np.repeat(np.array([parity(t) for t in tokens], dtype=np.int64), TREES), "words": np.repeat(np.array([len(t) for t in tokens], dtype=np.int32), TREES),
                    }
                )

    none = F.lit(None).cast("string").alias("canon")
    whole = titles.select(F.lit(TITLE_TREE).alias("tree"), F.xxhash64("canon").alias("key"), "cid", F.xxhash64(F.lit(1), "canon").alias("parity"), F.lit(0).alias("words"), none)
    text = titles.select(F.lit(TEXT_TREE).alias("tree"), F.xxhash64("cid").alias("key"), "cid", F.lit(0).cast("bigint").alias("parity"), F.lit(0).alias("words"), "canon")
    return titles.select("cid", "canon").mapInPandas(run, _KEYS).withColumn("canon", none).unionByName(whole).unionByName(text)


def doi_rows(dois: DataFrame) -> DataFrame:
    """The entries of the distinct DOIs ``(cid, doi_key)``."""
    return dois.select(F.lit(DOI_TREE).alias("tree"), F.xxhash64("doi_key").alias("key"), "cid", F.xxhash64(F.lit(1), "doi_key").alias("parity"), F.lit(0).alias("words"), F.lit(None).cast("string").alias("canon"))


def range_search(probes: DataFrame, runs: list[str], own: str, least: int) -> DataFrame:
    """Distinct ``(p, r, depth)`` of a probe and another entry of the runs; of the run ``own``, which the probes are, an entry with a smaller ``cid``.

    ``depth`` is the longest common prefix of their keys in any tree, from ``least`` bytes on, for
    pairs of equally many words of which few may differ; it is 9 for equal
    titles and DOIs (128 bits compared).
    """
    free = np.uint64((1 << 8 * (DEPTH - least)) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(runs, ["cid", "parity", "words"])
        for b in batches:
            b = b.sort_values(["tree", "key"], kind="stable")
            out = [pd.DataFrame({"p": [], "r": [], "depth": []}, dtype=np.int64)]
            for tree, part in b.groupby("tree"):
                key, cid, bits, words = (part[c].to_numpy() for c in ("key", "cid", "parity", "words"))
                k = key.view(np.uint64)
                low, high = (key, key) if tree >= TITLE_TREE else ((k & ~free).view(np.int64), (k | free).view(np.int64))
                for probe, rows, file in reader.ranges(int(tree), low, high):
                    apart = np.bitwise_count((bits[probe] ^ rows["parity"]).view(np.uint64))
                    other = rows["cid"] < cid[probe] if file.startswith(own) else rows["cid"] != cid[probe]
                    ok = other & (words[probe] == rows["words"]) & (apart <= (0 if tree >= TITLE_TREE else PARITY_BITS))
                    probe, r = probe[ok], rows["cid"][ok]
                    differ = k[probe] ^ rows["key"][ok].view(np.uint64)
                    depth = np.full(len(probe), least if tree < TITLE_TREE else DEPTH + 1)
                    for d in range(least + 1, DEPTH + 1) if tree < TITLE_TREE else ():
                        depth[differ >> np.uint64(8 * (DEPTH - d)) == 0] = d
                    out.append(pd.DataFrame({"p": cid[probe], "r": r, "depth": depth}))
            yield pd.concat(out, ignore_index=True).groupby(["p", "r"], as_index=False)["depth"].max()

    return probes.select("tree", "key", "cid", "parity", "words").where(F.col("tree") < TEXT_TREE).mapInPandas(run, "p bigint, r bigint, depth int").groupBy("p", "r").agg(F.max("depth").alias("depth"))


def fetch(ids: DataFrame, runs: list[str]) -> DataFrame:
    """``(cid, canon)`` of the distinct titles ``(cid)``, by range search."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(runs, ["cid", "canon"])
        for b in batches:
            b = b.sort_values("key", kind="stable")
            key, cid = b["key"].to_numpy(), b["cid"].to_numpy()
            for probe, rows, _ in reader.ranges(TEXT_TREE, key, key):
                ok = cid[probe] == rows["cid"]
                yield pd.DataFrame({"cid": rows["cid"][ok], "canon": rows["canon"][ok]})

    keyed = ids.select(F.lit(0).alias("tree"), F.xxhash64("cid").alias("key"), "cid")
    return by_range(keyed, 1).mapInPandas(run, "cid bigint, canon string")


def verified(pairs: DataFrame, titles: DataFrame, common: set[str]) -> DataFrame:
    """``(a, b)`` links of ``pairs (p, r, depth)`` whose titles are one but for slips of the keyboard; a probe that is linked under a longer prefix is not compared under shorter ones."""
    t = titles.select("cid", "canon")
    both = pairs.join(t.select(F.col("cid").alias("p"), F.col("canon").alias("cp")), "p").join(t.select(F.col("cid").alias("r"), F.col("canon").alias("cr")), "r")
    sent = pairs.sparkSession.sparkContext.broadcast(frozenset(common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        correct = Corrector(sent.value)
        now, reached = None, 0  # the probe, and the depth at which it was linked
        for b in batches:
            out = []
            for p, r, depth, x, y in zip(b["p"], b["r"], b["depth"], b["cp"], b["cr"], strict=True):
                if p != now:
                    now, reached = p, 0
                if depth >= reached and same_title(x.split(" "), y.split(" "), sent.value, alike=correct.alike):
                    reached = depth
                    out.append((min(p, r), max(p, r)))
            yield pd.DataFrame(out, columns=["a", "b"])

    return both.select("p", "r", "depth", "cp", "cr").repartition("p").sortWithinPartitions("p", F.desc("depth")).mapInPandas(run, "a bigint, b bigint")


class HistoryForest:
    """The persistent index of accepted works in a folder that all executors share; a forest opened on the folder of another goes on where that stopped.

    Words in wide use are those of the accepted titles; they are counted anew,
    and the signatures made anew, when the number of titles has doubled.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, merge_at: int = 8):
        self.spark, self.merge_at = spark, merge_at
        self.folder = folder or f"{shared_dir(spark)}/paperloom/forest-{uuid.uuid4().hex[:12]}"
        self.runs: list[str] = []
        self.common: set[str] = set()
        self.n = self.counted = self.version = 0
        fs, path = self._fs(f"{self.folder}/state")
        if fs.exists(path):
            newest = max(fs.listStatus(path), key=lambda f: f.getPath().getName()).getPath().toString()
            state = json.loads(spark.read.text(newest, wholetext=True).first().value)
            self.runs, self.common = state["runs"], set(state["common"])
            self.n, self.counted, self.version = state["n"], state["counted"], state["version"]

    def _fs(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _save(self) -> None:
        """A new version of the state, written beside it and renamed, so a forest is never seen half changed."""
        self.version += 1
        state = {"runs": self.runs, "common": sorted(self.common), "n": self.n, "counted": self.counted, "version": self.version}
        fs, new = self._fs(f"{self.folder}/new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(self._fs(f"{self.folder}/state")[1])
        fs.rename(new, self._fs(f"{self.folder}/state/{self.version:09d}.json")[1])

    def _rows(self, runs: list[str]) -> DataFrame:
        return rows_of(self.spark, runs, _ENTRY)

    @tidy
    def accept(self, titles: DataFrame, dois: DataFrame | None = None, recall: float = RECALL) -> DataFrame:
        """Append a batch's distinct titles ``(cid, canon)`` and DOIs ``(cid, doi_key)`` as a run, and return its links ``(a, b)``, a < b, among itself and to what was accepted before.

        A ``cid`` names a row of this batch only.  An empty batch changes nothing but the version.
        """
        if not self.counted:
            self.common, self.counted = common_words(titles), titles.count()
        rows = forest_rows(titles, self.common)
        own = write_run(rows if dois is None else rows.unionByName(doi_rows(dois)), self.folder, TEXT_TREE + 1)
        self.runs.append(own)
        met = materialise(range_search(self._rows([own]), self.runs, own, prefix_depth(recall=recall)), "met")
        sure, open_ = met.where(F.col("depth") > DEPTH), met.where(F.col("depth") <= DEPTH)
        known = materialise(fetch(open_.select(F.explode(F.array("p", "r")).alias("cid")).distinct(), self.runs), "fetched")
        links = verified(open_, known, self.common).unionByName(sure.select(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b")))
        links = materialise(links, "links")
        self.n += size_of(own, TEXT_TREE)
        old: list[str] = []
        if self.n >= 2 * self.counted:
            every = self._rows(self.runs)
            titles = every.where(F.col("tree") == TEXT_TREE).select("cid", "canon")
            old, self.common, self.counted = self.runs, common_words(titles), self.n
            self.runs = [write_run(forest_rows(titles, self.common).unionByName(every.where(F.col("tree") == DOI_TREE)), self.folder, TEXT_TREE + 1)]
        elif len(self.runs) > self.merge_at:
            old, self.runs = self.runs, [write_run(self._rows(self.runs), self.folder, TEXT_TREE + 1)]
        self._save()
        for run in old:
            _delete(self.spark, run)
        return links

    def drop(self) -> None:
        """Delete the index."""
        _delete(self.spark, self.folder)


@tidy
def replay(titles: DataFrame, dois: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of works: the batches of ``titles (cid, canon, batch)`` and ``dois (cid, doi_key, batch)`` go through a forest one after the other."""
    spark = titles.sparkSession
    forest = HistoryForest(spark)
    links = []
    for n in sorted({r.batch for t in (titles, dois) for r in t.select("batch").distinct().collect()}):
        links.append(forest.accept(titles.where(F.col("batch") == n), dois.where(F.col("batch") == n)))
    forest.drop()
    out = spark.createDataFrame([], "a bigint, b bigint")
    for x in links:
        out = out.unionByName(x)
    return out


@tidy
def works(records: DataFrame, no: str = "cand_no", title: str = "title", doi: str = "doi", id: str = "id", keep: tuple[str, ...] = (), batch: str | None = None) -> DataFrame:
    """``(no, *keep, work)`` for every row; ``work`` is the smallest ``no`` of the rows of its work.

    Rows are of one work if they bear one DOI or one title (up to typing,
    markup, spelling, order), directly or through other rows.  The batches
    (numbers in ``batch``, which is one of ``keep``; a missing number is 0) are
    go through the forest in order; without ``batch`` all rows are one.  A row without DOI
    and title is its own work.  Repeated rows are the same work; an empty table
    gives none.
    """
    rows = materialise(canonical(records, no, title, doi, id, keep), "rows")
    at = F.coalesce(F.col(batch).cast("bigint"), F.lit(0)) if batch else F.lit(0).cast("bigint")
    row = rows.select(F.col(no).cast("bigint").alias("n"), "doi_key", "canon", at.alias("batch"))
    titles = materialise(row.where("canon is not null").groupBy("canon", "batch").agg(F.min("n").alias("cid")), "titles")
    of_doi = materialise(row.where("doi_key is not null").groupBy("doi_key", "batch").agg(F.min("n").alias("cid")), "of_doi")
    links = replay(titles, of_doi)
    by_title = row.where("canon is not null").select("n", "canon", "batch").join(titles, ["canon", "batch"]).select(F.col("n").alias("a"), F.col("cid").alias("b"))
    by_doi = row.where("doi_key is not null").select("n", "doi_key", "batch").join(of_doi, ["doi_key", "batch"]).select(F.col("n").alias("a"), F.col("cid").alias("b"))
    of = components(by_title.where("a <> b").unionByName(by_doi.where("a <> b")).unionByName(links))
    out = rows.select(no, *keep).join(of.withColumnRenamed("node", "_node"), F.col(no) == F.col("_node"), "left")
    return out.select(no, *keep, F.coalesce("root", F.col(no).cast("bigint")).alias("work"))


def repeats(records: DataFrame, no: str = "cand_no", batch: str = "batch_no", title: str = "title", doi: str = "doi", id: str = "id") -> DataFrame:
    """``(accepted_no, <no>)``: each row of a later batch (``batch`` >= 1) whose work occurs in an earlier row, with the first row of that work."""
    w = works(records, no, title, doi, id, keep=(batch,), batch=batch)
    return w.where((F.col(batch) >= 1) & (F.col("work") < F.col(no))).select(F.col("work").alias("accepted_no"), F.col(no).cast("bigint").alias(no))
