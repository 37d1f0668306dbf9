"""Connected components over a table of links, without ever gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import drop_materialised, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of a link between two different nodes; ``root`` is the smallest node of its component.

    Alternating large-star and small-star steps (shuffles by node,
    written to the shared folder), until a round changes nothing; a chain of n nodes
    takes about log n rounds.  Null
    ends and loops are ignored; no links give an empty table.  A hub's least
    neighbour is combined before the shuffle, and the join that hands it out
    can be split; it is a merge join, so no round sends a table to the driver.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct()
        new = materialise(small, "star")
        old, e = e, new
        drop_materialised(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
