"""Payloads of search interfaces as candidate columns; each takes a table in the payload's schema (see :mod:`paperloom.schema`).

Missing values become ``''`` in string columns, as in the candidate record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import strip_tags, text


def _s(c: Column | str) -> Column:
    return text(c)


def _first(*cs: Column) -> Column:
    """The first value that is neither null nor ``''``, else ``''``."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def abstract_from_index(index: Column | str) -> Column:
    """The text of an inverted index (word to positions): words by position, then by word; ``''`` for null or empty."""
    index = F.col(index) if isinstance(index, str) else index
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def inverted_index(c: Column | str) -> Column:
    """The reverse: each white-space separated word of a text with its positions; a null or blank text gives an empty map."""
    words = F.filter(F.split(text(c), r"(?U)\s+"), lambda x: x != "")
    at = lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())
    distinct = F.array_distinct(words)
    return F.map_from_arrays(distinct, F.transform(distinct, at))


def works(raw: DataFrame) -> DataFrame:
    """Works with nested locations and an inverted abstract."""
    best, oa, where = F.col("best_oa_location"), F.col("open_access"), F.col("primary_location")
    pdf = _s(best["pdf_url"])
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull() & (x != ""))
    return raw.select(
        F.replace(_s("doi"), F.lit("https://doi.org/"), F.lit("")).alias("doi"),
        _first(F.col("title"), F.col("display_name")).alias("title"),
        F.coalesce(F.array_join(names, "; "), F.lit("")).alias("authors"),
        F.col("publication_year").alias("year"),
        _s(where["source"]["display_name"]).alias("journal_source"),
        _first(where["landing_page_url"], F.col("id")).alias("url"),
        pdf.alias("pdf_url"),
        _s(oa["oa_status"]).alias("oa_status"),
        F.when(pdf != "", F.concat(F.lit("openalex:"), _first(best["version"], F.lit("oa")))).otherwise("").alias("oa_source"),
        _s(best["license"]).alias("license"),
        abstract_from_index("abstract_inverted_index").alias("abstract"),
        F.coalesce(oa["is_oa"], F.lit(False)).alias("is_oa"),
        F.lit("openalex").alias("source_api"),
        _s("id").alias("openalex_id"),
    )


def _year(raw: DataFrame) -> Column:
    """The year of the first date (print, online, issued, created) that has a part; later dates are not asked once one has, even if its year is null."""
    out = F.lit(None).cast("int")
    for c in ("created", "issued", "published-online", "published-print"):
        part = F.get(F.col(f"`{c}`.`date-parts`"), F.lit(0))
        out = F.when(F.size(F.coalesce(part, F.array().cast("array<int>"))) > 0, F.get(part, F.lit(0))).otherwise(out)
    return out


def items(raw: DataFrame) -> DataFrame:
    """Items with arrays of titles and ``given`` / ``family`` names, dates in parts and a marked-up abstract."""
    given, family = (lambda a: F.nullif(a["given"], F.lit(""))), (lambda a: F.nullif(a["family"], F.lit("")))
    names = F.filter(F.transform("author", lambda a: F.concat_ws(" ", given(a), family(a))), lambda x: x != "")
    return raw.select(
        _s("DOI").alias("doi"),
        _s(F.get("title", F.lit(0))).alias("title"),
        F.coalesce(F.array_join(names, "; "), F.lit("")).alias("authors"),
        _year(raw).alias("year"),
        _s(F.get(F.col("`container-title`"), F.lit(0))).alias("journal_source"),
        _s("URL").alias("url"),
        F.lit("").alias("pdf_url"),
        F.lit("").alias("oa_status"),
        F.lit("").alias("oa_source"),
        F.lit("").alias("license"),
        strip_tags("abstract").alias("abstract"),
        F.lit(False).alias("is_oa"),
        F.lit("crossref").alias("source_api"),
        F.lit("").alias("openalex_id"),
    )


def papers(raw: DataFrame, page: str = "https://www.semanticscholar.org/paper/") -> DataFrame:
    """Papers with external ids and an open-access address; empty author names are kept."""
    pdf, open_ = _s(F.col("openAccessPdf.url")), F.coalesce("isOpenAccess", F.lit(False))
    return raw.select(
        _s(F.col("externalIds.DOI")).alias("doi"),
        _s("title").alias("title"),
        F.coalesce(F.array_join(F.transform("authors", lambda a: _s(a["name"])), "; "), F.lit("")).alias("authors"),
        F.col("year"),
        _s("venue").alias("journal_source"),
        F.when(_s("paperId") != "", F.concat(F.lit(page), "paperId")).otherwise("").alias("url"),
        pdf.alias("pdf_url"),
        F.when(open_, "open").otherwise("").alias("oa_status"),
        F.when(pdf != "", "semantic_scholar").otherwise("").alias("oa_source"),
        F.lit("").alias("license"),
        _s("abstract").alias("abstract"),
        open_.alias("is_oa"),
        F.lit("semantic_scholar").alias("source_api"),
        F.lit("").alias("openalex_id"),
    )


def lookup(raw: DataFrame) -> DataFrame:
    """Open-access lookups by DOI, flattened."""
    best = F.col("best_oa_location")
    return raw.select("doi", F.coalesce("is_oa", F.lit(False)).alias("is_oa"), _s("oa_status").alias("oa_status"), _s(best["url_for_pdf"]).alias("pdf_url"), _s(best["license"]).alias("license"), _s(best["host_type"]).alias("host_type"))


def looked_up(records: DataFrame, found: DataFrame, doi: str = "doi") -> DataFrame:
    """``records`` with the flattened lookup of their DOI as ``l_*`` columns; no DOI, none found or an error is the empty record.  ``found`` has one row per DOI, compared stripped and in lower case."""
    one = lookup(found).withColumn("_k", F.lower(F.trim("doi"))).where("_k <> ''").dropDuplicates(["_k"])
    cols = ["oa_status", "pdf_url", "license", "host_type"]
    one = one.select("_k", F.col("is_oa").alias("l_is_oa"), *(F.col(c).alias(f"l_{c}") for c in cols))
    out = records.join(one, F.lower(F.trim(records[doi])) == F.col("_k"), "left").drop("_k")
    return out.withColumns({"l_is_oa": F.coalesce("l_is_oa", F.lit(False))} | {f"l_{c}": _s(f"l_{c}") for c in cols})
