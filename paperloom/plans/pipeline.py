"""The search pipeline as one plan: found records become scored candidates of their cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import record_id
from paperloom.operators.keywords import score
from paperloom.operators.upsert import enrich
from paperloom.rules import Words

#: Columns that a candidate starts with empty.
EMPTY = ("slot", "local_pdf_path", "notes", "duplicate_of")


def collect(found: DataFrame, now: Column, lookup: DataFrame | None = None, words: Words = Words()) -> DataFrame:
    """Candidates of normalised records that bear their cell (``country``, ``category``).

    Constants are attached, what a lookup by DOI ``(doi, is_oa, oa_status,
    pdf_url, license, ...)`` knows fills empty columns (an address by it names
    its source), the four scores and their texts are added, then the id.
    Records are not de-duplicated; ``created_at`` stays where it is there.
    """
    out = found.withColumns({c: F.lit("") for c in EMPTY})
    if lookup is not None:
        fill = {"pdf_url": F.col("l_pdf_url"), "oa_status": F.col("l_oa_status"), "license": F.col("l_license")}
        if "oa_source" in found.columns:
            by = F.concat(F.lit("lookup:"), F.coalesce(F.nullif("l_host_type", F.lit("")), F.lit("oa")))
            fill["oa_source"] = F.when(F.coalesce(F.col("l_pdf_url"), F.lit("")) != "", by)
        out = enrich(out, lookup, "doi", fill)
    out = score(out, words)
    created = F.coalesce("created_at", now) if "created_at" in found.columns else now
    return out.withColumns({"id": record_id("doi", "title", *(c for c in ("doi", "title", "authors", "year", "url") if c in found.columns)), "created_at": created, "updated_at": now})
