"""Files: JSON and CSV tables, landing pages, state, documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.schema import CANDIDATE


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON objects, one a line or (``lines=False``) one array or object a file; malformed records become null rows."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_state(spark: SparkSession, path: str, schema: str = CANDIDATE) -> DataFrame:
    """The saved candidates (Parquet folder, or a JSON array when the name ends so); an empty table if there is none or it is malformed."""
    try:
        if path.endswith(".json"):
            return spark.read.schema(schema).option("multiLine", True).json(path).na.drop("all")
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all strings; quotes are doubled inside quotes and values may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')


def first_there(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            if path.getFileSystem(conf).exists(path):
                return p
    return None


def filesystem(path: str):
    """``(file system, path in it)`` of an address that all executors can reach, for use in tasks."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def list_files(spark: SparkSession, folders: str | list[str], pattern: str = "*.pdf") -> DataFrame:
    """``(path, folder, name, bytes)`` of the files below the folders, empty ones included, without reading them; folders that are not there have none. A folder is listed by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from fnmatch import fnmatch

        from pyarrow.fs import FileSelector, FileType

        for b in batches:
            out = []
            for top in b["top"]:
                fs, place = filesystem(top)
                for f in fs.get_file_info(FileSelector(place, recursive=True, allow_not_found=True)):
                    if f.type == FileType.File and fnmatch(f.base_name, pattern):
                        out.append((f.path, f.path.rsplit("/", 2)[-2] if f.path.count("/") > 1 else "", f.base_name, f.size))
            yield pd.DataFrame(out, columns=["path", "folder", "name", "bytes"])

    tops = [folders] if isinstance(folders, str) else list(folders)
    rows = spark.createDataFrame([(f,) for f in tops], "top string").repartition(max(1, len(tops)), "top")
    return rows.mapInPandas(run, "path string, folder string, name string, bytes bigint").distinct()


def collect_pdfs(spark: SparkSession, root: str, countries: list[str], single: str | None = None) -> DataFrame:
    """The PDF files of the countries' folders in order of country and path, or the one file ``single`` if it is there and is one."""
    if single:
        there = first_there(spark, single) if single.lower().endswith(".pdf") else None
        return spark.createDataFrame([(single, *single.rsplit("/", 2)[-2:])] if there else [], "path string, folder string, name string")
    order = F.array_position(F.array(*map(F.lit, countries)), F.col("folder"))
    return list_files(spark, [f"{root.rstrip('/')}/{c}" for c in countries]).select("path", "folder", "name").orderBy(order, "path")


def with_existence(records: DataFrame, listing: DataFrame, path: str = "path", name: str = "there") -> DataFrame:
    """``records`` with whether the file in column ``path`` is in a listing ``(path)``; null paths are not."""
    known = listing.select(F.col("path").alias("_path")).distinct().withColumn(name, F.lit(True))
    out = records.drop(name).join(known, F.col(path) == F.col("_path"), "left").drop("_path")
    return out.withColumn(name, F.coalesce(name, F.lit(False)))


def pdf_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text, pages)`` of the PDF files below a folder; the first installed reader that yields text counts, none gives ``''`` and 0."""

    def one(content: bytes) -> tuple[str, int]:
        import importlib
        import io

        for name in ("pymupdf", "pdfplumber", "pypdf"):
            try:
                lib = importlib.import_module(name)
                if name == "pymupdf":
                    with lib.open(stream=content, filetype="pdf") as d:
                        parts = [p.get_text() for p in d]
                elif name == "pdfplumber":
                    with lib.open(io.BytesIO(content)) as d:
                        parts = [p.extract_text() or "" for p in d.pages]
                else:
                    parts = [p.extract_text() or "" for p in lib.PdfReader(io.BytesIO(content)).pages]
            except Exception:  # noqa: BLE001  a broken file must not end the job
                continue
            text = "\n".join(parts)
            if text.strip() or name == "pypdf":
                return text, len(parts)
        return "", 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in got], "pages": [n for _, n in got]})

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)
    return f.select("path", "content").mapInPandas(run, "path string, text string, pages int")
