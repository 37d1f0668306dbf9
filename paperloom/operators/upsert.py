"""Keyed upsert of new records into existing ones, as one aggregation, and fill-if-absent lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import present


def _there(name: str, kind: str) -> Column:
    if kind == "string":
        return present(name)
    if kind == "boolean":
        return present(name, "boolean")
    if kind in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return present(name, "number")
    return F.col(name).isNotNull()


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "ord", first: tuple[str, ...] = ("slot", "notes"), locked: dict[str, list[str]] | None = None, once: tuple[str, ...] = ("created_at",), touched: dict[str, Column] | None = None) -> DataFrame:
    """One row per key of either table; folding in order of ``order``, existing rows first.

    The last present value of a column wins (``''``, 0, false and null are
    absent and never overwrite), else the first row's own value; ``first``
    columns keep the first present value; a ``locked`` column stops at the
    first value of its list; ``once`` columns keep the first row's; ``touched``
    columns get the given value where a new row came.  A key repeated in
    ``existing`` keeps its last row at its first place.  Null keys fold
    together.  The one shuffle is by key, after a map-side combine, so a key
    that holds a third of all rows costs one partial row per task.
    """
    kinds = dict(existing.dtypes)
    cols = [c for c in existing.columns if c not in (key, order)]
    base = existing.groupBy(key).agg(F.min(order).alias("_at"), *(F.max_by(F.struct(F.col(c)), order).getField(c).alias(c) for c in cols))
    base = base.select(key, F.lit(0).alias("_new"), F.col("_at"), *cols)
    rows = base.unionByName(new.select(key, F.lit(1).alias("_new"), F.col(order).alias("_at"), *cols))
    at = F.struct("_new", "_at")
    locked, touched = locked or {}, touched or {}
    aggs = []
    for c in cols:
        there = _there(c, kinds[c])
        own = F.min_by(F.struct(F.col(c)), at).getField(c)
        last = F.max_by(F.when(there, F.col(c)), F.when(there, at))
        early = F.min_by(F.when(there, F.col(c)), F.when(there, at))
        if c in once:
            value = own
        elif c in touched:
            value = F.when(F.max("_new") == 1, touched[c]).otherwise(own)
        elif c in first:
            value = F.coalesce(early, own)
        elif c in locked:
            hold = F.col(c).isin(locked[c])
            value = F.coalesce(F.min_by(F.when(hold, F.col(c)), F.when(hold, at)), last, own)
        else:
            value = F.coalesce(last, own)
        aggs.append(value.alias(c))
    return rows.groupBy(key).agg(F.min(at).alias("first_at"), *aggs)


def enrich(records: DataFrame, lookup: DataFrame, key: str = "doi", fill: dict[str, Column] | None = None) -> DataFrame:
    """``records`` left-joined to one row per key of ``lookup``; each column of ``fill`` gets its value where it is absent.

    ``fill`` values may use the lookup's columns as ``l_<name>``; they are null
    for keys without a match, and such rows stay as they are.  Keys are
    compared stripped and in lower case; null and empty ones match nothing.
    Of a key repeated in the lookup the smallest row (by all columns) counts.
    """
    fill = fill or {}
    kinds = dict(records.dtypes)
    others = [c for c in lookup.columns if c != key]
    one = lookup.withColumn("_k", F.lower(F.trim(key))).where("_k <> ''").groupBy("_k").agg(F.min(F.struct(*others)).alias("_l")).select("_k", *(F.col(f"_l.{c}").alias(f"l_{c}") for c in others))
    filled = [F.when(~_there(c, kinds[c]) & fill[c].isNotNull(), fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in records.columns]
    own = F.lower(F.trim(records[key]))
    out = records.where(own != "").join(one, own == F.col("_k"), "left").select(*filled)
    return out.unionByName(records.where(own.isNull() | (own == "")))
