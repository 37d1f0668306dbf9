"""Queries of the text operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.history import repeats

    return repeats(_read(spark, d, "candidates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.lookalike import changed_fields

    return changed_fields(_read(spark, d, "candidates"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.lookalike import unify

    return unify(_read(spark, d, "candidates"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.neardup import row_pairs

    return row_pairs(_read(spark, d, "candidates"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.neardup import groups

    return groups(_read(spark, d, "candidates"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p2_unified, p4_found, p4_groups)}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.names import variant_pairs
    from paperloom.operators.split_values import split_values

    return variant_pairs(split_values(_read(spark, d, "candidates"), "cand_no", ("authors",), ("authors",), single=True))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its entity and the number of entities it may also stand for: linear in the spellings."""
    from pyspark.sql import functions as F

    from paperloom.llm.names import entities
    from paperloom.operators.split_values import split_values

    of, also = entities(split_values(_read(spark, d, "candidates"), "cand_no", ("authors",), ("authors",), single=True))
    n = also.select(F.explode(F.array("entity", "other")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_links"))
    return of.join(n, "entity", "left").select("val", "middle", "entity", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.leak import leaked

    return leaked(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.leak import report

    return report(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.mixing import mix

    return mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[0]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.mixing import mix

    return mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.spans import sharing_pairs

    return sharing_pairs(_read(spark, d, "documents"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.spans import coverage

    return coverage(_read(spark, d, "documents"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.llm.spans import shared_spans

    return shared_spans(_read(spark, d, "documents"))[1]


QUERIES |= {f.__name__: f for f in (p5_found, p5_entities, p6_found, p6_items, p7_chosen, p7_mix, p8_found, p8_coverage, p8_spans)}
