"""Queries of the problems on texts and typed names: 5 and 7 to 10."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm import abuse, canonical, encode, leaks, variants
from hydroframe.plans.io import table

Query = Callable[[SparkSession, str], DataFrame]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The canonical water body of every typed location."""
    return canonical.map_names(table(spark, d, "field_entries"), table(spark, d, "water_body_aliases"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labels of the same monitoring point."""
    return variants.pairs(table(spark, d, "site_labels"))


def p7_points(spark: SparkSession, d: str) -> DataFrame:
    """The monitoring point of every label, and its number of links."""
    return variants.points_with_links(table(spark, d, "site_labels"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose water body is not on the list."""
    return canonical.unmatched(table(spark, d, "field_entries"), table(spark, d, "water_body_aliases"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain passages of test items."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the passages stand, in words."""
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or explicit language."""
    return abuse.abusive(table(spark, d, "documents"), table(spark, d, "labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "labels")).select("doc_id", "source", F.round("score", 4).alias("score"), "n_abusive")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p5_found, p5_unmatched, p7_found, p7_points, p8_ids, p9_found, p9_spans, p10_found, p10_scores, p10_rates)}
