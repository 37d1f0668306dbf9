"""Fetching files over HTTP into a landing table, and saving those that are PDFs. Side effects are opt-in and run in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.files import filesystem

# The first bytes of a PDF, the least size of one, and how a response is read.
PDF_MAGIC, LEAST_BYTES, CHUNK, TIMEOUT = b"%PDF", 3000, 8192, 60
_LANDED = "url string, error string, code int, final_url string, content_type string, head binary, size bigint, content binary"


def looks_pdf(head: Column, content_type: Column | None = None) -> Column:
    """Whether the first bytes, or the given type, are those of a PDF; null bytes are not."""
    magic = F.coalesce(F.startswith(head, F.lit(PDF_MAGIC)), F.lit(False))
    return magic if content_type is None else magic | F.coalesce(F.contains(F.lower(content_type), F.lit("application/pdf")), F.lit(False))


def fetch(urls: DataFrame, url: str = "url", agent: str = "paperloom (academic research)") -> DataFrame:
    """A landing table of the addresses: ``(url, error, code, final_url, content_type, head, size, content)``.

    Redirects are followed, an answer is read in chunks, codes other than 200
    are rows without content, and a network error is a row with ``error``.
    Null addresses give no row.  Nothing is retried.
    """

    def one(address: str) -> tuple:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(address, headers={"User-Agent": agent, "Accept": "application/pdf"}), timeout=TIMEOUT) as r:  # noqa: S310
                parts = list(iter(lambda: r.read(CHUNK), b""))
                content = b"".join(parts)
                return address, None, r.status, r.url, r.headers.get("Content-Type"), content[:2048], len(content), content
        except HTTPError as e:
            return address, None, e.code, e.url, e.headers.get("Content-Type"), None, 0, None
        except Exception as e:  # noqa: BLE001  an address that fails is a row
            return address, f"network error: {e}", None, None, None, None, 0, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for u in b["url"]:  # one answer in memory at a time
                yield pd.DataFrame([one(u)], columns=[c.split(" ")[0] for c in _LANDED.split(", ")]).astype({"code": "Int32"})

    return urls.select(F.col(url).alias("url")).where("url is not null").mapInPandas(run, _LANDED)


def save_pdfs(landed: DataFrame, folder: str, path: str = "path", least: int = LEAST_BYTES) -> DataFrame:
    """``(path, bytes, status)``: ``saved`` below ``folder``, ``too_small`` (not kept), ``not_pdf`` or the error, for landed rows with a relative ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, ok, c in zip(b["path"], b["ok"], b["content"], strict=True):
                n = len(c) if c is not None else 0
                status = "not_pdf" if not ok else "too_small" if n < least else "saved"
                if status == "saved":
                    try:
                        fs, place = filesystem(f"{folder.rstrip('/')}/{p}")
                        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        with fs.open_output_stream(place + ".part") as f:
                            f.write(c)
                        fs.move(place + ".part", place)  # a task that runs again writes the same file
                    except OSError as e:
                        status = f"error: {e}"
                out.append((p, n, status))
            yield pd.DataFrame(out, columns=["path", "bytes", "status"])

    rows = landed.select(F.col(path).alias("path"), looks_pdf(F.col("head"), F.col("content_type")).alias("ok"), "content")
    return rows.mapInPandas(run, "path string, bytes bigint, status string")
