"""Writing: state, review tables, logs, notes, copies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import present, text
from paperloom.rules import CANDIDATE_COLUMNS
from paperloom.sources.files import filesystem

# The columns of the tables that are handed out.
REVIEW_COLUMNS = ["id", "country", "category", "slot", "title", "year", "screening_status", "screening_reason", "workplace_organization_score", "exclusion_medical_score", "category_score", "country_score", "oa_status", "legal_download_status", "pdf_url", "local_pdf_path", "doi", "related_category"]
DUPLICATE_COLUMNS = ["id", "duplicate_of", "country", "category", "title", "doi"]
DOWNLOAD_COLUMNS = ["country", "category", "title", "doi", "pdf_url", "domain", "oa_status", "license", "legal_download_status", "legal_download_reason", "local_pdf_path"]
RENAME_COLUMNS = ["country", "category", "category_number", "sequence", "title", "source_path", "new_path", "status", "note"]
PREPROCESS_COLUMNS = ["country", "pdf_file", "category_number", "category_name", "raw_text_path", "cleaned_text_path", "notes_path", "status", "word_count_raw", "word_count_cleaned", "warnings"]


def fixed_columns(df: DataFrame, columns: list[str] = CANDIDATE_COLUMNS) -> DataFrame:
    """The columns in order as strings, ``''`` for null and for columns that are not there."""
    return df.select(*(text(F.col(c).cast("string")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def review_table(records: DataFrame, shown: Column, order: str) -> DataFrame:
    """The rows for which ``shown`` holds, by country, slot and input order."""
    cols = [c for c in REVIEW_COLUMNS if c in records.columns]
    return records.where(shown).orderBy("country", text("slot"), order).select(*cols)


def duplicates_table(records: DataFrame) -> DataFrame:
    """The rows that name an original, whatever their state."""
    return records.where(present("duplicate_of")).select(*DUPLICATE_COLUMNS)


def write_csv(df: DataFrame, path: str, single: bool = False, windows_lines: bool = False) -> None:
    """CSV with a header and doubled quotes; ``single`` makes one file and is for reports only."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n" if windows_lines else "\n").csv(path)


def write_state(df: DataFrame, path: str) -> None:
    """Parquet as the state.  ``path`` must not be one that ``df`` is read from: write a new version and swap."""
    df.write.mode("overwrite").parquet(path)


def write_log(df: DataFrame, path: str, columns: list[str]) -> None:
    """A log in its fixed columns (:data:`DOWNLOAD_COLUMNS`, :data:`RENAME_COLUMNS`, :data:`PREPROCESS_COLUMNS`), missing ones empty, others left out; one file."""
    write_csv(fixed_columns(df, columns), path, single=True)


def download_log(records: DataFrame, domain: Column, status: Column, reason: Column, path: Column) -> DataFrame:
    """One log row for each candidate that was looked at: its own columns, the host, and what came of it; a row without a new path keeps its own."""
    own = {c: text(c) for c in ("country", "category", "title", "doi", "pdf_url", "oa_status", "license")}
    own |= {"domain": text(domain), "legal_download_status": text(status), "legal_download_reason": text(reason), "local_pdf_path": F.coalesce(F.nullif(path, F.lit("")), text("local_pdf_path"))}
    return records.select(*(c for c in ("cand_no",) if c in records.columns), *(own[c].alias(c) for c in DOWNLOAD_COLUMNS))


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One JSON array in order, two spaces deep, other scripts as they are; one file, for reports."""
    body = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    first = df.agg(F.min(order)).first()[0]
    rows = df.select(F.lit(1).alias("part"), F.col(order).alias("o"), F.concat(F.when(F.col(order) == F.lit(first), "[\n  ").otherwise(",\n  "), F.regexp_replace(body, "\n", "\n  ")).alias("value"))
    end = df.sparkSession.createDataFrame([(2, "]" if first is not None else "[]")], "part int, value string")
    out = rows.orderBy("o").select("part", "o", "value").unionByName(end, allowMissingColumns=True)
    out.orderBy("part", "o").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_all(records: DataFrame, folder: str, shown: Column, open_slots: DataFrame, order: str) -> None:
    """State, candidate CSV and JSON, review table, open places and duplicates, from one cached table."""
    records = records.cache()
    try:
        write_state(records, f"{folder}/candidates.parquet")
        write_json(records, f"{folder}/candidates.json")
        write_csv(fixed_columns(records), f"{folder}/candidates.csv")
        write_csv(review_table(records, shown, order), f"{folder}/candidate_table.csv", single=True)
        write_csv(open_slots, f"{folder}/missing_slots.csv", single=True)
        write_csv(duplicates_table(records), f"{folder}/duplicates.csv")
    finally:
        records.unpersist()


def write_texts(df: DataFrame, folder: str, path: str, content: str) -> DataFrame:
    """Write each row's text to ``folder``/its path on the shared file system; ``(path, bytes)`` of what was written. Opt-in side effect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = []
            for p, c in zip(b["p"], b["c"], strict=True):
                fs, to = filesystem(f"{folder.rstrip('/')}/{p}")
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                data = (c or "").encode()
                with fs.open_output_stream(to + ".part") as f:
                    f.write(data)
                fs.move(to + ".part", to)  # a task that runs again writes the same file
                n.append(len(data))
            yield pd.DataFrame({"path": b["p"], "bytes": n})

    return df.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, "path string, bytes bigint")


def copy_files(plan: DataFrame, source: str = "src", target: str = "dst", dry_run: bool = True) -> DataFrame:
    """``plan`` with ``status``: ``dry_run``, ``copied``, ``exists`` (a target that is there is never overwritten) or the error. Files are copied by the tasks, only if ``dry_run`` is off."""
    if dry_run:
        return plan.withColumn("status", F.lit("dry_run"))

    @F.pandas_udf("string")
    def copy(s: pd.Series, t: pd.Series) -> pd.Series:
        from pyarrow.fs import FileType, copy_files

        out = []
        for a, b in zip(s, t, strict=True):
            try:
                (source_fs, a), (fs, b) = filesystem(a), filesystem(b)
                if fs.get_file_info(b).type != FileType.NotFound:
                    out.append("exists")
                    continue
                fs.create_dir(b.rsplit("/", 1)[0], recursive=True)
                copy_files(a, b + ".part", source_filesystem=source_fs, destination_filesystem=fs)
                fs.move(b + ".part", b)
                out.append("copied")
            except OSError as e:
                out.append(f"error: {e}")
        return pd.Series(out)

    return plan.withColumn("status", copy(source, target))
