"""Descriptive statistics. Group-bys with partial aggregation throughout; results are rounded to be reproducible."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions import text as X
from hydroframe.functions.names import canonical_names, parse_water_body
from hydroframe.plans.io import cut
from hydroframe.sources.tables import with_row_id

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Ranges that a group's values are cut into to find its quantiles.
RANGES = 64
#: Years of a station by year map.
MAX_YEARS = 10_000


def describe(df: DataFrame, by: str, value: str, digits: int = 6) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max of value per group; a group without numbers keeps count 0."""
    names = ("min", "q1", "median", "q3", "max")
    g = df.groupBy(F.col(by).alias("parameter")).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    q = quantiles(df.withColumn("_by", F.struct(F.col(by).alias("v"))), ["_by"], value)
    j = g.withColumn("_by", F.struct(F.col("parameter").alias("v"))).join(q, "_by", "left")
    return j.select("parameter", "count", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"), *(F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(names)))


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float] = QUARTILES) -> DataFrame:
    """(by, q): exact quantiles of value per group, interpolated between ranks, for few groups of any number of rows.

    Values are counted first; each group's values are cut into RANGES ranges by a sketch, so no task holds a group. Ranks
    are found from the sums of the ranges, and only the ranges that hold one are looked into.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    d = cut(d)
    # Written once: a sketch depends on the order in which its parts are merged, and all that follows must see the same ranges.
    bounds = cut(d.groupBy(*by).agg(F.sum("_n").alias("_total"), F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], F.lit(10 * RANGES)).alias("_cuts")))
    part = d.join(bounds, list(by)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    sums = part.groupBy(*by, "_total", "_part").agg(F.sum("_n").alias("_size"))
    w = W.partitionBy(*by).orderBy("_part")
    sums = sums.withColumn("_end", F.sum("_size").over(w))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_total") - 1)).alias("rank")) for i, p in enumerate(at)))
    asked = bounds.select(*by, F.explode(wanted).alias("_w"))
    ends = asked.select(*by, F.col("_w.i").alias("_i"), F.col("_w.rank").alias("_rank"), F.explode(F.array_distinct(F.array(F.floor("_w.rank"), F.ceil("_w.rank")))).alias("_k"))
    held = ends.join(sums.select(*by, "_part", (F.col("_end") - F.col("_size")).alias("_begin"), "_end"), list(by)).where((F.col("_k") >= F.col("_begin")) & (F.col("_k") < F.col("_end")))
    parts = held.select(*by, "_part", "_begin").distinct()
    inside = part.select(*by, "_part", "_v", "_n").join(parts, [*by, "_part"])
    inside = inside.withColumn("_to", F.col("_begin") + F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_v")))
    found = held.join(inside.select(*by, "_part", "_v", "_n", "_to"), [*by, "_part"]).where((F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("_n")))
    whole = lambda f: F.max(F.when(F.col("_k") == f("_rank"), F.col("_v")))
    q = found.groupBy(*by, "_i").agg(whole(F.floor).alias("_lo"), whole(F.ceil).alias("_hi"), F.first(F.col("_rank") - F.floor("_rank")).alias("_f"))
    value_ = F.when(F.col("_f") == 0, F.col("_lo")).otherwise(F.col("_lo") * (1 - F.col("_f")) + F.col("_hi") * F.col("_f"))
    q = q.select(*by, F.struct("_i", value_.alias("_x")).alias("_q"))
    return q.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("_q")), lambda s: s["_x"]).alias("q"))


def boxplots(df: DataFrame, station: Column, family: Column, year: Column, month: Column, value: Column, digits: int = 4) -> DataFrame:
    """Five numbers per station, family and year, and per station, family and month, by grouping sets (one scan)."""
    d = df.select(station.alias("station"), family.alias("family"), year.alias("year"), month.alias("month"), value.alias("v")).where("v is not null")
    g = d.groupingSets([["station", "family", "year"], ["station", "family", "month"]], "station", "family", "year", "month").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, QUARTILES))).alias("q"))
    return g.select("station", "family", "year", "month", "n", *(F.round(F.col("q")[i], digits).alias(x) for i, x in enumerate(("min", "q1", "median", "q3", "max"))))


def distribution(df: DataFrame, by: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """Box statistics per group with mean, iqr and whiskers at the extreme values within 1.5 iqr."""
    d = df.where(F.col(value).isNotNull())
    g = d.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean")).join(quantiles(d, by, value), list(by))
    fences = g.select(*by, (F.col("q")[1] - 1.5 * (F.col("q")[3] - F.col("q")[1])).alias("low"), (F.col("q")[3] + 1.5 * (F.col("q")[3] - F.col("q")[1])).alias("high"))
    inside = d.join(fences, list(by)).where(F.col(value).between(F.col("low"), F.col("high"))).groupBy(*by).agg(F.min(value).alias("lower_whisker"), F.max(value).alias("upper_whisker"))
    r = lambda c, n: F.round(c, digits).alias(n)
    return g.join(inside, list(by)).select(
        *by, "count", *(r(F.col("q")[i], n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))), r(F.col("mean"), "mean"), r(F.col("q")[3] - F.col("q")[1], "iqr"), r(F.col("lower_whisker"), "lower_whisker"), r(F.col("upper_whisker"), "upper_whisker")
    )


def summary(df: DataFrame, station: str, parameter: str, has_position: Column) -> DataFrame:
    """One row: records, stations, parameters, rows with and without position."""
    return df.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(station).alias("locations"), F.countDistinct(parameter).alias("parameters"), F.count_if(has_position).alias("mapped"), F.count_if(~has_position).alias("unmapped"))


def station_year_means(df: DataFrame, station: str, year: str, value: str, digits: int = 4) -> DataFrame:
    """Mean per station and year over the scaffold of all stations and all years; empty cells are null."""
    cells = df.groupBy(station, year).agg(F.round(F.avg(value), digits).alias("mean"), F.count(value).alias("n"))
    years = [r[0] for r in df.select(year).distinct().limit(MAX_YEARS + 1).collect()]
    if len(years) > MAX_YEARS:
        raise ValueError(f"a map has at most {MAX_YEARS} years")
    axis = F.array(*(F.lit(y).cast(dict(df.dtypes)[year]) for y in sorted(years, key=lambda y: (y is not None, y)))) if years else F.array().cast(f"array<{dict(df.dtypes)[year]}>")
    frame = df.select(station).distinct().withColumn(year, F.explode(axis))
    return frame.join(cells, [station, year], "left").select(station, year, "mean", F.coalesce("n", F.lit(0)).alias("n"))


def station_year_pivot(df: DataFrame, station: str, year: str, value: str, years: Sequence[int], digits: int = 4) -> DataFrame:
    """The same as one row per station and one column per given year."""
    p = df.groupBy(station).pivot(year, list(years)).agg(F.avg(value))
    return p.select(station, *(F.round(F.col(str(y)), digits).alias(f"y{y}") for y in years))


def _hull(points: np.ndarray) -> np.ndarray:
    """Indices of the convex hull of (longitude, latitude) points on a plane around their mean latitude."""
    x = points[:, 0] * math.cos(math.radians(float(points[:, 1].mean())))
    y = points[:, 1]
    order = np.lexsort((y, x)).tolist()

    def chain(ids: list[int]) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    return np.array(sorted({*chain(order), *chain(order[::-1])}))


def position_conflicts(df: DataFrame, station: str, lat: str, lon: str, row_id: str, least_m: float = 500.0, salts: int = 16) -> DataFrame:
    """Stations recorded at positions at least least_m apart: positions, rows, spread, and the position of the first row.

    The farthest two positions are hull points, so positions are counted, reduced to hulls of salted parts of the
    station, then to one hull, and only its points are paired.
    """
    p = df.where(X.valid_position(F.col(lat), F.col(lon))).groupBy(F.col(station).cast("string").alias("station"), F.round(lat, 6).alias("la"), F.round(lon, 6).alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first"))

    def reduce_hull(f: pd.DataFrame) -> pd.DataFrame:
        return f.iloc[_hull(f[["lo", "la"]].to_numpy(float))][["station", "la", "lo"]]

    def widest(f: pd.DataFrame) -> pd.DataFrame:
        f = reduce_hull(f)
        la, lo = np.radians(f["la"].to_numpy(float)), np.radians(f["lo"].to_numpy(float))
        a = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
        return pd.DataFrame({"station": [f["station"].iloc[0]], "spread_m": [2 * X.EARTH_M * float(np.arcsin(np.sqrt(np.clip(a, 0, 1))).max())]})

    box = p.groupBy("station").agg(F.min("la").alias("a"), F.max("la").alias("b"), F.min("lo").alias("c"), F.max("lo").alias("e"))
    # A box that is small even along the meridian and the widest parallel holds no such pair.
    roomy = box.where(F.sqrt(F.pow((F.col("b") - F.col("a")) * X.DEGREE_M, F.lit(2)) + F.pow((F.col("e") - F.col("c")) * X.DEGREE_M, F.lit(2))) * 1.01 >= least_m).select("station")
    wide = p.join(roomy, "station", "left_semi")
    parts = wide.select("station", "la", "lo", F.pmod(F.xxhash64("la", "lo"), F.lit(salts)).alias("salt")).groupBy("station", "salt").applyInPandas(lambda f: reduce_hull(f), "station string, la double, lo double")
    spread = parts.groupBy("station").applyInPandas(widest, "station string, spread_m double")
    used = p.groupBy("station").agg(F.count(F.lit(1)).alias("positions"), F.sum("n").alias("n_rows"), F.min_by(F.struct("la", "lo"), "first").alias("u"))
    return used.join(spread.where(F.col("spread_m") >= least_m), "station").select("station", "positions", "n_rows", F.round("spread_m", 1).alias("spread_m"), F.col("u.la").alias("used_latitude"), F.col("u.lo").alias("used_longitude"))


def station_values(df: DataFrame, digits: int = 4) -> DataFrame:
    """Interval of every (period, family, station): over the years' mean readings, else mean (Min) and (Max).

    df: row_id, family, variant ('', min, max), unit, station, year, value. Periods are the years and all_years. The
    bounds are means over years and swapped if reversed; kind is reading, range, max only or min only.
    """
    v = df.where("value is not null")
    mean = lambda tag: F.avg(F.when(F.col("variant") == tag, F.col("value")))
    years = v.groupBy("family", "station", "year").agg(mean("").alias("r"), mean("min").alias("lo"), mean("max").alias("hi"), F.count("value").alias("n"), F.min_by("unit", "row_id").alias("unit"), F.min("row_id").alias("first"))
    years = years.select("*", F.coalesce("r", "lo").alias("low"), F.coalesce("r", "hi").alias("high"), F.col("r").isNull().cast("int").alias("ranged"))
    periods = years.withColumn("period", F.explode(F.array(F.lit("all_years"), F.col("year").cast("string"))))
    g = periods.groupBy("period", "family", "station").agg(F.avg("low").alias("a"), F.avg("high").alias("b"), F.sum("ranged").alias("ranged"), F.sum("n").alias("sample_count"), F.count(F.lit(1)).alias("year_count"), F.min_by("unit", "first").alias("unit"))
    low, high = F.when(F.col("a") > F.col("b"), F.col("b")).otherwise(F.col("a")), F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(F.col("b"))
    kind = F.when(F.col("ranged") == 0, "reading").when(F.col("a").isNotNull() & F.col("b").isNotNull(), "range").when(F.col("a").isNull(), "max only").otherwise("min only")
    return g.select("period", "family", "station", "unit", F.round(low, digits).alias("lower"), F.round(high, digits).alias("upper"), F.round(F.coalesce((low + high) / 2, low, high), digits).alias("value"), kind.alias("kind"), "sample_count", "year_count")


def popup_means(df: DataFrame, station: str, lat: str, lon: str, value: str, digits: int = 4) -> DataFrame:
    """The mean of every station at every position it is recorded at."""
    return df.where(F.col(value).isNotNull()).groupBy(station, lat, lon).agg(F.round(F.avg(value), digits).alias("mean"))


def station_table(df: DataFrame, station: str, lat: str, lon: str, row_id: str, water_body: str | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(station, latitude, longitude, water_body, parsed): one row a station, with its first valid position, its most
    frequent water body (the first by name of equals, '' unknown) and the one its name says, both by their preferred
    names if aliases (base, name) are given."""
    ok = X.valid_position(F.col(lat), F.col(lon))
    body = F.lit("") if water_body is None else F.trim(F.coalesce(water_body, F.lit("")))
    d = df.where(F.trim(F.coalesce(F.col(station), F.lit(""))) != "").select(F.col(station).alias("station"), F.when(ok, F.struct(F.col(lat).alias("latitude"), F.col(lon).alias("longitude"))).alias("p"), F.col(row_id).alias("r"), body.alias("b"))
    names = d.groupBy("station", "b").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("r"))).alias("p"), F.min(F.when(F.col("p").isNotNull(), F.col("r"))).alias("r"), F.count(F.lit(1)).alias("n"))
    g = names.groupBy("station").agg(F.min_by("p", "r").alias("p"), F.min_by("b", F.when(F.col("b") != "", F.struct(-F.col("n"), "b"))).alias("b"))
    out = g.select("station", "p.latitude", "p.longitude", F.coalesce("b", F.lit("")).alias("water_body"), parse_water_body("station").alias("parsed"))
    return out if aliases is None else canonical_names(canonical_names(out, "water_body", aliases), "parsed", aliases)


def elevation_ranks(stations: DataFrame) -> DataFrame:
    """(station, elevation, rank): stations of known height from the highest down, equals by name; stations of unknown
    height have no rank. The order comes from a range sort, no single task holds all."""
    known = stations.where("elevation is not null and not isnan(elevation)").orderBy(F.col("elevation").desc(), "station").select("station", "elevation")
    ranked = with_row_id(known, "rank").select("station", "elevation", "rank")
    return ranked.unionByName(stations.where("elevation is null or isnan(elevation)").select("station", "elevation", F.lit(None).cast("long").alias("rank")))


def records_in_order(records: DataFrame) -> DataFrame:
    """Records by location group, parameter, sort key and file, equals in file order (a range sort)."""
    return records.orderBy("location_group", "parameter", "sort_key", "file_name", "row_id")


def head(df: DataFrame, n: int = 5, order_by: str = "row_id") -> DataFrame:
    """The first n rows in an order (a top-k report)."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("n is a number of rows")
    return df.orderBy(order_by).limit(n)


def best_rows(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")
