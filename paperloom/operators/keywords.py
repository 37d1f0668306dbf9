"""Keyword containment: which words of a list a text holds, and the scores made of that.

The decision rules that turn scores into workflow states are the caller's; pass
them to :func:`first_match` as ordered cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import col
from paperloom.rules import Words


def haystack(*columns: Column | str) -> Column:
    """The non-empty columns joined by one space, in lower case; ``''`` if all are null or empty."""
    return F.lower(F.array_join(F.filter(F.array(*map(col, columns)), lambda x: x.isNotNull() & (x != "")), " "))


def hits(hay: Column, words: list[str]) -> Column:
    """The words (in list order, each once) that occur anywhere in the text, whatever their case; no shuffle, no join."""
    if not words:
        return F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(hay, F.lower(k))))


def hits_by_key(hay: Column, key: Column | str, words: dict[str, list[str]]) -> Column:
    """As :func:`hits` with the list of a row's key; unknown and null keys have no words."""
    out = F.array().cast("array<string>")
    for k, ws in words.items():
        out = F.when(col(key) == k, hits(hay, ws)).otherwise(out)
    return out


def workplace(records: DataFrame, words: Words = Words(), texts: tuple[str, ...] = ("title", "abstract", "journal_source")) -> DataFrame:
    """``records`` with ``in_workplace`` and ``workplace_hits``: whether and by which words of the organisational list (the check's older name) a text is of a workplace."""
    found = records.withColumn("workplace_hits", hits(haystack(*texts), words.organisation))
    return found.withColumn("in_workplace", F.size("workplace_hits") > 0)


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds; a null condition does not hold."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def score(records: DataFrame, words: Words = Words(), country: str = "country", category: str = "category", texts: tuple[str, ...] = ("title", "abstract", "journal_source")) -> DataFrame:
    """``records`` with the hits of each dimension, the four scores and the texts that explain them.

    Columns of these names that are there already are replaced.  Null texts
    count as empty.
    """
    hay = haystack(*texts)
    out = records.withColumn("_hay", hay)
    out = out.withColumns({"country_hits": hits_by_key(F.col("_hay"), country, words.country), "category_hits": hits_by_key(F.col("_hay"), category, words.category), "organisation_hits": hits(F.col("_hay"), words.organisation), "medical_hits": hits(F.col("_hay"), words.medical), "physical_hits": hits(F.col("_hay"), words.physical)}).drop("_hay")
    joined = lambda c: F.array_join(c, ", ")
    n = lambda c: F.size(c).cast("int")
    physical = F.when(F.size("physical_hits") > 0, F.concat(F.when(F.size("organisation_hits") > 0, " | ").otherwise(""), F.lit("physical-env: "), joined("physical_hits"))).otherwise("")
    out = out.withColumns({"country_score": n("country_hits"), "workplace_organization_score": n("organisation_hits"), "category_score": n("category_hits"), "exclusion_medical_score": (n("medical_hits") + n("physical_hits")).cast("int"), "target_country_region": joined("country_hits"), "research_context": F.concat(joined("organisation_hits"), physical)})
    return out.withColumns({"related_category": F.concat(F.col("category_score").cast("string"), F.lit(" matches: "), joined("category_hits")), "reason_for_inclusion": F.format_string("country=%d, org=%d, category=%d, medical/physical=%d", "country_score", "workplace_organization_score", "category_score", "exclusion_medical_score")})
