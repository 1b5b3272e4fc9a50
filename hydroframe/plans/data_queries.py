"""Queries of the data-preparation problems 1 to 4 and 6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.operators import drift, profile, spikes, units, wide
from hydroframe.plans.io import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads whose profile departs from the rest of their feed."""
    return profile.departing_loads(table(spark, d, "measurements"), table(spark, d, "parameters"))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every load and parameter."""
    return profile.profile(table(spark, d, "measurements"), table(spark, d, "parameters"))


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """Every watched metric beside the history of its feed and its control limits."""
    m = profile.metrics(cut(profile.states(table(spark, d, "measurements"), table(spark, d, "parameters"))))
    return profile.against_history(m).select("feed", "load_id", "column_name", "kind", "parameter", *(F.round(c, 9).alias(c) for c in ("metric", "usual", "spread")), "outside_limits", "departs")


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """p1_found from stored states of the earlier loads, merged with those of each feed's last load."""
    m, p = table(spark, d, "measurements"), table(spark, d, "parameters")
    last = m.groupBy("feed").agg(F.max("load_id").alias("last"))
    new = m.join(last, "feed")
    stored = cut(profile.states(new.where("load_id < last"), p))
    return profile.departing(cut(profile.merge_states(stored.unionByName(profile.states(new.where("load_id = last"), p)), *profile.KEYS)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Impossible, stuck and spiking readings."""
    return spikes.implausible(table(spark, d, "probe_readings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stated unit differs from the common unit."""
    return units.rows_converted(table(spark, d, "measurements"), table(spark, d, "parameters"))


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every measurement of a number parameter in the common unit."""
    return units.to_common_units(table(spark, d, "measurements"), table(spark, d, "parameters"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each file against the feed's preceding file."""
    return drift.changes(table(spark, d, "raw_lines"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All files as one table of the canonical schema; what has no canonical field is kept as JSON."""
    return drift.unified(table(spark, d, "raw_lines")).withColumn("other", F.to_json("other"))


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    """The schema version of every file, its fingerprint, and the steps that lead to it."""
    return drift.versions(table(spark, d, "raw_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells that receive disagreeing values."""
    return wide.disagreeing_cells(table(spark, d, "measurements"), table(spark, d, "parameters"))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per sample, one typed column per parameter."""
    return wide.wide(table(spark, d, "measurements"), table(spark, d, "parameters"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_merged, p1_profile, p1_limits, p2_found, p3_found, p3_values, p4_found, p4_table, p4_versions, p6_found, p6_wide)}
