"""Sorted runs in the shared folder, of which tasks read only the row groups that a range of keys can lie in.

A run is a Parquet table of rows ``(tree, key, ...)``, sorted by both inside
each file and cut into small row groups, beside a table of the groups' bounds.
Its order is what a range search uses: a task that holds sorted probes opens
the groups their ranges overlap and finds each range by bisection.  What a
search reads so depends on the probes, not on the size of the run.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import shuffles_freed

#: Rows of a row group, and row groups that a task keeps.
GROUP_ROWS, KEPT = 50_000, 8
BOUNDS = ["file", "group", "n", "low_tree", "high_tree", "low", "high"]


def _open(path: str):
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    if path.startswith("file:") or "://" in path:
        fs, place = FileSystem.from_uri(path)
        return pq.ParquetFile(fs.open_input_file(place))
    return pq.ParquetFile(path)


def _bounds(file: str) -> list[tuple]:
    meta = _open(file).metadata
    at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
    out = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        tree, key = group.column(at["tree"]).statistics, group.column(at["key"]).statistics
        out.append((file, g, group.num_rows, tree.min, tree.max, key.min, key.max))
    return out


def by_range(rows: DataFrame, trees: int) -> DataFrame:
    """``rows`` sorted in partitions that hold ranges of ``(tree, key)``: keys are hashes, so equal steps hold about equally many and no sample is needed."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = (F.col("tree") * 65536 + F.shiftright("key", 48) + 32768) * n / (trees * 65536)
    return rows.repartitionById(n, step.cast("int")).sortWithinPartitions("tree", "key")


def write_run(rows: DataFrame, folder: str, trees: int = 1) -> str:
    """Write ``rows`` (with ``tree`` from 0 to ``trees`` - 1 and ``key``) as a run below ``folder`` and return its path. The driver reads the files' footers, no rows."""
    spark = rows.sparkSession
    path = f"{folder}/run-{uuid.uuid4().hex[:12]}"
    by = by_range(rows, trees)
    with shuffles_freed(spark):
        by.write.option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    files = [f.getPath().toString() for f in found if f.getPath().getName().endswith(".parquet")]
    with ThreadPoolExecutor(8) as pool:
        table = pd.DataFrame([b for bs in pool.map(_bounds, files) for b in bs], columns=BOUNDS)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_bounds"), True)
    out.write(bytearray(table.to_parquet(index=False)))
    out.close()
    return path


def rows_of(spark: SparkSession, runs: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*runs)


def size_of(run: str, tree: int) -> int:
    """Rows of a run's tree; all of them if a row group holds another tree too are told apart by reading that group."""
    n = 0
    for b in _open(f"{run}/_bounds").read().to_pandas().itertuples(index=False):
        if b.low_tree <= tree <= b.high_tree:
            n += b.n if b.low_tree == b.high_tree else int((_open(b.file).read_row_group(b.group, columns=["tree"])["tree"].to_numpy() == tree).sum())
    return n


class Reader:
    """What a task sees of some runs: the rows of ranges, a row group at a time."""

    def __init__(self, runs: list[str], columns: list[str]):
        found = [_open(f"{r}/_bounds").read().to_pandas() for r in runs]
        self.bounds = pd.concat(found, ignore_index=True) if found else pd.DataFrame({c: [] for c in BOUNDS})
        self.low, self.high = self.bounds["low"].to_numpy(dtype=np.int64), self.bounds["high"].to_numpy(dtype=np.int64)
        self.low_tree, self.high_tree = self.bounds["low_tree"].to_numpy(dtype=np.int64), self.bounds["high_tree"].to_numpy(dtype=np.int64)
        self.columns, self.kept, self.opened, self.read = columns, OrderedDict(), OrderedDict(), 0

    def _group(self, at: int) -> dict[str, np.ndarray]:
        got = self.kept.get(at)
        if got is None:
            file = self.bounds["file"].iat[at]
            if file not in self.opened:
                self.opened[file] = _open(file)
                if len(self.opened) > KEPT:
                    self.opened.popitem(last=False)
            t = self.opened[file].read_row_group(int(self.bounds["group"].iat[at]), columns=["tree", "key", *self.columns])
            got = self.kept[at] = {c: t[c].to_numpy(zero_copy_only=False) for c in t.column_names}
            self.read += len(got["key"])
            if len(self.kept) > KEPT:
                self.kept.popitem(last=False)
        return got

    def ranges(self, tree: int, low: np.ndarray, high: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray], str]]:
        """``(probe, rows, file)`` for the sorted ranges ``low`` to ``high`` of a tree: which range each row lies in; in pieces of about ``most`` rows, so that no range has to fit into memory with its rows."""
        if not len(low):
            return
        there = (self.low_tree <= tree) & (self.high_tree >= tree) & ((self.low_tree < self.high_tree) | ((self.low <= high.max()) & (self.high >= low[0])))
        for g in np.flatnonzero(there):
            rows = self._group(int(g))
            a, b = np.searchsorted(rows["tree"], tree, "left"), np.searchsorted(rows["tree"], tree, "right")
            key = rows["key"][a:b]
            first, last = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
            n = last - first
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            upto = np.cumsum(n[hit])
            start = 0
            while start < len(hit):
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
                h = hit[start:stop]
                probe = np.repeat(h, n[h])
                at = a + np.arange(len(probe)) + np.repeat(first[h] - (np.cumsum(n[h]) - n[h]), n[h])
                yield probe, {c: v[at] for c, v in rows.items()}, self.bounds["file"].iat[g]
                start = stop
