"""Row numbers within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import materialise


def group_rank(records: DataFrame, group: list[str], by: list[Column], name: str = "rank") -> DataFrame:
    """``records`` with each row's number (from 1) in its group in the order of ``by``, which has to be unique in a group.

    Rows are cut into ranges of (group, order), so a group of a third of all
    rows is spread over a third of the ranges; ranges are numbered apart and
    shifted by the counts of the group's earlier ranges, of which there are
    at most groups plus partitions.
    """
    if not group:
        raise ValueError("a group is needed")
    spark = records.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = materialise(records.repartitionByRange(n, *[F.asc_nulls_first(g) for g in group], *by).withColumn("_range", F.spark_partition_id()), "ranges")
    same = [F.coalesce(F.col(g).cast("string"), F.lit("\x00")).alias(f"_g{i}") for i, g in enumerate(group)]
    keys = [f"_g{i}" for i in range(len(group))]
    counts = cut.groupBy(*same, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = cut.withColumns(dict(zip(keys, same, strict=True)))
    out = out.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*by))).join(counts, [*keys, "_range"])
    return out.withColumn(name, (F.col("_k") + F.col("_before")).cast("int")).drop("_k", "_before", "_range", *keys)
