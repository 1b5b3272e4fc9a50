"""Column-level data quality profile with mergeable states (problem 1).

Declarative checks are compiled into one shared aggregate scan that leaves a state per load, parameter and written
unit: counts, ranges, a HyperLogLog sketch of distinct values and a KLL sketch of the numbers. All metrics, also the
units that no other load has, come from the states, which are written once. States of partitions or of later
deliveries merge by summing, widening and sketch union: stored states and those of a new load give the same as a scan
of everything. Metrics are tested against the history of their feed: the stated margins decide, and robust control
limits stand beside them.

Defined cases: null and marker cells are missing; a load without non-missing cells has null shares and departs in
nothing but `missing`; repeated rows count; the median over an even number of loads is the mean of the middle two.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions.measure import Parameters, readings
from hydroframe.functions.units import MISSING
from hydroframe.plans.io import cut, only

#: Size parameter of the KLL sketches: rank errors stay under 0.3 %.
KLL_K = 1000
SHARE_MARGIN = 0.15
CATEGORY_SHARE = 0.20
LEVEL_RATIO = 2.0
LEVEL_PARAMETERS = 0.5
#: Half-width of the control limits in robust standard deviations.
CONTROL_WIDTH = 3.0


@dataclass(frozen=True)
class Check:
    """A share to be profiled: among the cells where `among` holds, those where `holds` does."""

    name: str
    column: str
    among: Column
    holds: Column


def missing(column: str) -> Column:
    """Null, blank, or a marker that stands for no value."""
    return F.col(column).isNull() | F.lower(F.trim(F.col(column), F.lit(" \t\r\n"))).isin(sorted(MISSING))


def checks() -> list[Check]:
    """The declared constraint checks of measurements."""
    number = F.col("kind") == "number"
    return [
        Check("missing", "value", F.lit(True), F.col("missing")),
        Check("missing", "unit", number & (F.col("parameter") != "pH"), F.col("unit_missing")),
        Check("pattern", "value", number & ~F.col("missing"), ~F.col("plain")),
    ]


KEYS = ("feed", "load_id", "parameter", "kind", "unit")


def states(measurements: DataFrame, parameters: DataFrame | Parameters) -> DataFrame:
    """The mergeable states: one row per feed, load, canonical parameter and unit as written (null where missing), from
    one scan."""
    plain = only(measurements, "feed", "load_id", "parameter", "unit", "value", "remarks").withColumn("unit_missing", missing("unit"))
    r = readings(plain, parameters, ("feed", "load_id", "value", "unit", "unit_missing"), ("parameter", "variant", "kind", "missing", "plain", "common_value"))
    level = F.when(F.col("plain") & (F.col("variant") == "") & (F.col("kind") == "number"), F.col("common_value"))
    shares = [a for c in checks() for a in (F.count_if(c.among).alias(f"{c.column}_{c.name}_of"), F.count_if(c.among & c.holds).alias(f"{c.column}_{c.name}_n"))]
    return r.withColumn("unit", F.when(~F.col("unit_missing"), F.col("unit"))).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *shares,
        F.min("common_value").alias("min_value"),
        F.max("common_value").alias("max_value"),
        F.hll_sketch_agg(F.when(~F.col("missing"), F.col("value"))).alias("value_texts"),
        F.count(level).alias("n_level"),
        F.kll_sketch_agg_double(level, F.lit(KLL_K)).alias("level"),
    )


def merge_states(parts: DataFrame, *by: str) -> DataFrame:
    """States of partitions or deliveries merged by the given keys."""
    plain = [c for c in parts.columns if c.startswith(("n_", "value_missing", "unit_missing", "value_pattern"))]
    return parts.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in plain),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.hll_union_agg("value_texts").alias("value_texts"),
        F.kll_merge_agg_double("level").alias("level"),
    )


def metrics(state: DataFrame) -> DataFrame:
    """(feed, load_id, column_name, kind, parameter, metric) from the states, one row per number that is watched.

    kind `level` has a row per number parameter, the others one per load; `categories` is the share of unit cells whose
    text no other load of the feed has.
    """
    row = lambda column, kind, metric: F.struct(F.lit(column).alias("column_name"), F.lit(kind).alias("kind"), F.lit("").alias("parameter"), metric.alias("metric"))
    sums = state.groupBy("feed", "load_id").agg(*(F.sum(f"{c.column}_{c.name}_{k}").alias(f"{c.column}_{c.name}_{k}") for c in checks() for k in ("n", "of")))
    shares = sums.select("feed", "load_id", F.inline(F.array(*(row(c.column, c.name, F.try_divide(F.col(f"{c.column}_{c.name}_n"), F.col(f"{c.column}_{c.name}_of"))) for c in checks()))))
    units = state.where("unit is not null").groupBy("feed", "load_id", "unit").agg(F.sum("n_rows").alias("n"))
    holders = units.groupBy("feed", "unit").agg(F.count(F.lit(1)).alias("loads"), F.min("load_id").alias("load_id"), F.sum("n").alias("own")).where("loads = 1").groupBy("feed", "load_id").agg(F.sum("own").alias("own"))
    of = units.groupBy("feed", "load_id").agg(F.sum("n").alias("n")).join(holders, ["feed", "load_id"], "left")
    own = of.select("feed", "load_id", F.inline(F.array(row("unit", "categories", F.coalesce("own", F.lit(0)) / F.col("n")))))
    level = state.where("n_level > 0").groupBy("feed", "load_id", "parameter").agg(F.kll_merge_agg_double("level").alias("level"))
    levels = level.select("feed", "load_id", F.lit("value").alias("column_name"), F.lit("level").alias("kind"), "parameter", F.kll_sketch_get_quantile_double("level", F.lit(0.5)).alias("metric"))
    return shares.unionByName(own).unionByName(levels)


def against_history(metric: DataFrame) -> DataFrame:
    """Each metric beside the median and the robust control limits over the loads of its feed, and whether it departs
    by the margin of its kind.

    The windows hold one row per load: a feed of any number of rows is a few dozen of them.
    """
    w = W.partitionBy("feed", "column_name", "kind", "parameter")
    m = metric.withColumn("usual", F.percentile("metric", F.lit(0.5)).over(w))
    m = m.withColumn("spread", F.lit(1.4826) * F.percentile(F.abs(F.col("metric") - F.col("usual")), F.lit(0.5)).over(w))
    m = m.withColumn("outside_limits", F.abs(F.col("metric") - F.col("usual")) > CONTROL_WIDTH * F.col("spread"))
    far = (F.col("metric") > LEVEL_RATIO * F.col("usual")) | (F.col("metric") < F.col("usual") / LEVEL_RATIO)
    more = F.col("metric") - F.col("usual") >= SHARE_MARGIN - 1e-9
    return m.withColumn("departs", F.coalesce(F.when(F.col("kind") == "level", far).when(F.col("kind") == "categories", F.col("metric") >= CATEGORY_SHARE).otherwise(more), F.lit(False)))


def departing(state: DataFrame) -> DataFrame:
    """(load_id, column_name, kind) of the loads that depart, from states: a level by at least half of its parameters,
    the others by their one metric."""
    m = against_history(metrics(state)).groupBy("feed", "load_id", "column_name", "kind").agg(F.avg(F.col("departs").cast("double")).alias("share"))
    return m.where(F.col("share") >= LEVEL_PARAMETERS).select("load_id", "column_name", "kind").distinct()


def departing_loads(measurements: DataFrame, parameters: DataFrame) -> DataFrame:
    """(load_id, column_name, kind) of the loads whose profile departs from their feed's; one scan of measurements."""
    return departing(cut(states(measurements, parameters)))


def profile(measurements: DataFrame, parameters: DataFrame) -> DataFrame:
    """The readable profile of every load and parameter, and of what its metrics are outside of."""
    s = cut(states(measurements, parameters))
    units = s.groupBy("feed", "load_id", "parameter", "kind").agg(F.count("unit").alias("unit_texts"))
    s = merge_states(s, "feed", "load_id", "parameter", "kind").join(units.select(*(F.col(c).alias(f"_{c}") for c in ("feed", "load_id", "parameter", "kind")), "unit_texts"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("feed", "load_id", "parameter", "kind")]))
    q = lambda p, name: F.round(F.kll_sketch_get_quantile_double(F.col("level"), F.lit(p)), 6).alias(name)
    quantiles = [F.when(F.col("n_level") > 0, q(p, n)).alias(n) for p, n in ((0.25, "level_q1"), (0.5, "level_median"), (0.75, "level_q3"))]
    body = s.select(
        "feed", "load_id", "parameter", "kind", "n_rows", "value_missing_n", "unit_missing_n", "value_pattern_n",
        F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"),
        F.hll_sketch_estimate("value_texts").alias("value_texts"), "unit_texts", *quantiles,
    )
    return body
