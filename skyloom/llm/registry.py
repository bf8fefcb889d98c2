"""The p5_ to p8_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.common import table
from skyloom.llm import leaks, lookalike, matching, mixing


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Detections of the same star in both observatories' lists, with a confidence."""
    return matching.matched(table(spark, d, "starlist"), table(spark, d, "starlist_ext"), table(spark, d, "lists"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of p5_pairs alone."""
    return p5_pairs(spark, d).select("row_id", "ext_id").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The reviews that hold passages of test items, with the items."""
    return leaks.found(table(spark, d, "eval_items"), table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The reviews of the largest mix that gives every source its target share, with their copies."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_stretched(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix twice as large as all sources can fill: what some lack goes to others near them in the tree."""
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"), stretch=2.0)[1]


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every review's class of reviews that look the same."""
    return lookalike.look_classes(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that look the same but differ in their characters."""
    return lookalike.same_look(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p5_found, p5_pairs, p6_found, p7_mix, p7_shares, p7_stretched, p8_classes, p8_found)}
SQL: dict[str, str] = {}
