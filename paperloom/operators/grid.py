"""Places of a grid: which are open, and the k-th best record for the k-th free place of its cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import present
from paperloom.rules import CATEGORIES, COUNTRIES, PAPERS_PER_SLOT


def slot_name(country: Column, paper: Column, category_no: Column) -> Column:
    return F.format_string("%s_%d-%d", country, paper, category_no)


def grid(spark: SparkSession, countries: list[str] = COUNTRIES, categories: list[str] = CATEGORIES, papers: int = PAPERS_PER_SLOT) -> DataFrame:
    """``(country, category, category_no, paper, slot)``: every place, made from the dimensions, which are parameters."""
    c = spark.createDataFrame([(x,) for x in countries], "country string")
    k = spark.createDataFrame([(x, i) for i, x in enumerate(categories, 1)], "category string, category_no int")
    g = c.join(k, how="cross").withColumn("paper", F.explode(F.sequence(F.lit(1), F.lit(papers))))
    return g.select("country", "category", "category_no", "paper", slot_name(F.col("country"), F.col("paper"), F.col("category_no")).alias("slot"))


def open_places(places: DataFrame, records: DataFrame, filled: Column, slot: str = "slot") -> DataFrame:
    """The places no record for which ``filled`` holds stands in."""
    taken = records.where(filled & present(slot)).select(F.col(slot).alias("slot")).distinct()
    return places.join(taken, "slot", "left_anti")


def weighted(value: Column, weights: dict[str, int], otherwise: int = 0) -> Column:
    """The weight of a value; null and unknown values weigh ``otherwise``."""
    out = F.lit(otherwise)
    for v, n in weights.items():
        out = F.when(value == v, n).otherwise(out)
    return out


def ranked(records: DataFrame, by: list[Column], cell: tuple[str, ...] = ("country", "category"), top: int | None = None) -> DataFrame:
    """``records`` with ``rn``, their rank in their cell; ``by`` has to end with a unique order.  With ``top`` a task keeps that many rows of a cell before the shuffle."""
    out = records.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy(*by)))
    return out.where(F.col("rn") <= top) if top else out


def fill_places(records: DataFrame, places: DataFrame, by: list[Column], eligible: Column, slot: str = "slot", cell: tuple[str, ...] = ("country", "category"), papers: int = PAPERS_PER_SLOT) -> DataFrame:
    """``(slot, *cell, rn)`` joined to the record's columns: the k-th best eligible record without a place takes the k-th free place.

    A place held by any record, eligible or not, is taken.  Cells are far
    fewer than rows: the rank keeps at most ``papers`` rows of a cell per
    task, so a cell of a third of all rows costs no more than another.
    """
    free = places.join(records.where(present(slot)).select(F.col(slot).alias("slot")).distinct(), "slot", "left_anti")
    free = free.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy("paper"))).select(*cell, "rn", F.col("slot").alias("new_slot"))
    best = ranked(records.where(eligible & ~present(slot)), by, cell, papers)
    return best.join(free, [*cell, "rn"])
