"""Queries over the star-schema tables for the engine's analytical operators, with SQL for comparison.

Suppliers stand for stations (position from the key, a heap-shaped tree of channels: k flows to k/2), line items and
events for measurements, nations for surfaces. Floats are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions import names, utm
from hydroframe.functions import text as X
from hydroframe.operators import channels, graph, identity, interpolate, network, river, screening, series, standardize, stats, surfaces
from hydroframe.plans.io import ensure_checkpoint_dir, table
from hydroframe.sources import tables
from hydroframe.streaming import measurements as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its equivalent SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_BASE_SQL = "array_to_string(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: NOT list_contains({t}, w)), ' ')"


def _base(c: str) -> str:
    return _BASE_SQL.format(c=c, t=[w.lower() for w in names.TYPE_WORDS])


# Measurements made of line items.
def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_suppkey").alias("station"), F.concat("l_returnflag", "l_linestatus").alias("family"), F.col("l_quantity").alias("value"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")
    )


_ITEMS = "SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey AS station, l_returnflag || l_linestatus AS family, l_quantity AS value, year(l_shipdate) AS year, month(l_shipdate) AS month FROM lineitem"


def _stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("surface"), k.alias("id"), (30 + (k * 37 % 100) / 100).alias("lat"), (76 + (k * 61 % 100) / 100).alias("lon"), F.col("s_acctbal").alias("value"))


_STATIONS = "SELECT s_nationkey AS surface, s_suppkey AS id, 30 + (s_suppkey * 37 % 100) / 100.0 AS lat, 76 + (s_suppkey * 61 % 100) / 100.0 AS lon, s_acctbal AS value FROM supplier"
_HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)))))"


def _d(a: str, b: str) -> str:
    return _HAVERSINE.format(a=a, b=b)


_QUARTILES = "round(min({v}), {n}) AS min, round(quantile_cont({v}, 0.25), {n}) AS q1, round(quantile_cont({v}, 0.5), {n}) AS median, round(quantile_cont({v}, 0.75), {n}) AS q3, round(max({v}), {n}) AS max"
_NUM = r"'^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$'"


def _q(v: str, n: int) -> str:
    return _QUARTILES.format(v=v, n=n)


@query(f"SELECT event_type AS parameter, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, {_q('value', 6)} FROM events GROUP BY event_type")
def describe_by_parameter(spark: SparkSession, d: str) -> DataFrame:
    """F1 over events."""
    return stats.describe(table(spark, d, "events"), "event_type", "value")


@query(
    f"""WITH m AS (SELECT trim(regexp_replace(coalesce(parameter, ''), '\\s+', ' ', 'g')) AS parameter, CASE WHEN regexp_matches(trim(value), {_NUM}) THEN TRY_CAST(trim(value) AS DOUBLE) END AS v FROM measurements)
    SELECT parameter, count(v) AS count, round(avg(v) + 1e-9, 6) AS mean, round(stddev_samp(v) + 1e-9, 6) AS std, round(min(v) + 1e-9, 6) AS min, round(quantile_cont(v, 0.25) + 1e-9, 6) AS q1, round(quantile_cont(v, 0.5) + 1e-9, 6) AS median, round(quantile_cont(v, 0.75) + 1e-9, 6) AS q3, round(max(v) + 1e-9, 6) AS max FROM m GROUP BY parameter"""
)
def describe_measurements(spark: SparkSession, d: str) -> DataFrame:
    """F1 with the stricter table numbers (C3) over the delivered parameters."""
    m = table(spark, d, "measurements").select(X.clean(F.col("parameter")).alias("parameter"), X.frame_number(F.col("value")).alias("v"))
    s = stats.describe(m, "parameter", "v", 14)
    # The nudge keeps exact halves from being rounded apart.
    return s.select("parameter", "count", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")))


@query(f"WITH m AS ({_ITEMS}) SELECT station, family, year, NULL::INTEGER AS month, count(*) AS n, {_q('value', 4)} FROM m GROUP BY station, family, year UNION ALL SELECT station, family, NULL, month, count(*), {_q('value', 4)} FROM m GROUP BY station, family, month")
def boxplot_year_month(spark: SparkSession, d: str) -> DataFrame:
    """F2 by grouping sets."""
    return stats.boxplots(_items(spark, d), *(F.col(c) for c in ("station", "family", "year", "month", "value")))


@query(
    f"""WITH m AS ({_ITEMS}), g AS (SELECT family, year, count(value) AS count, avg(value) AS mean, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM m GROUP BY family, year)
    SELECT g.family, g.year, any_value(g.count) AS count, {_q('m.value', 4)}, round(any_value(g.mean), 4) AS mean, round(any_value(b - a), 4) AS iqr,
           round(min(m.value) FILTER (m.value >= a - 1.5 * (b - a)), 4) AS lower_whisker, round(max(m.value) FILTER (m.value <= b + 1.5 * (b - a)), 4) AS upper_whisker
    FROM m JOIN g USING (family, year) GROUP BY g.family, g.year"""
)
def distribution_whiskers(spark: SparkSession, d: str) -> DataFrame:
    """F3 per family and year."""
    return stats.distribution(_items(spark, d), ["family", "year"], "value")


_YEARS = list(range(1992, 2003))


@query(f"WITH m AS ({_ITEMS}) SELECT station, " + ", ".join(f"round(avg(value) FILTER (year = {y}), 4) AS y{y}" for y in _YEARS) + " FROM m GROUP BY station")
def station_year_pivot(spark: SparkSession, d: str) -> DataFrame:
    """F8: one column per year."""
    return stats.station_year_pivot(_items(spark, d), "station", "year", "value", _YEARS)


@query(f"WITH m AS ({_ITEMS}), c AS (SELECT station, year, round(avg(value), 4) AS mean, count(value) AS n FROM m GROUP BY ALL) SELECT s.station, y.year, c.mean, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT station FROM m) s CROSS JOIN (SELECT DISTINCT year FROM m) y LEFT JOIN c ON c.station = s.station AND c.year = y.year")
def station_year_map(spark: SparkSession, d: str) -> DataFrame:
    """The scaffold of stations and years."""
    return stats.station_year_means(_items(spark, d), "station", "year", "value")


@query(
    f"""WITH m AS (SELECT *, CASE substr(family, 2, 1) WHEN 'F' THEN 'min' ELSE CASE WHEN station % 3 = 0 THEN '' ELSE 'max' END END AS variant, substr(family, 1, 1) AS fam FROM ({_ITEMS})),
    y AS (SELECT fam, station, year, avg(value) FILTER (variant = '') AS r, avg(value) FILTER (variant = 'min') AS lo, avg(value) FILTER (variant = 'max') AS hi, count(*) AS n FROM m GROUP BY ALL),
    z AS (SELECT *, coalesce(r, lo) AS l, coalesce(r, hi) AS h, (r IS NULL)::INT AS ranged FROM y),
    p AS (SELECT 'all_years' AS period, * FROM z UNION ALL SELECT year::VARCHAR, * FROM z),
    g AS (SELECT period, fam AS family, station, avg(l) AS a, avg(h) AS b, sum(ranged) AS ranged, sum(n) AS sample_count, count(*) AS year_count FROM p GROUP BY ALL),
    s AS (SELECT *, CASE WHEN a > b THEN b ELSE a END AS lower_, CASE WHEN a > b THEN a ELSE b END AS upper_ FROM g)
    SELECT period, family, station, 'u' AS unit, round(lower_, 4) AS lower, round(upper_, 4) AS upper, round(coalesce((lower_ + upper_) / 2, lower_, upper_), 4) AS value,
           CASE WHEN ranged = 0 THEN 'reading' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'range' WHEN a IS NULL THEN 'max only' ELSE 'min only' END AS kind, sample_count::BIGINT AS sample_count, year_count FROM s"""
)
def station_values_interval(spark: SparkSession, d: str) -> DataFrame:
    """intervals of stations per period."""
    tag = F.when(F.substring("family", 2, 1) == "F", "min").when(F.col("station") % 3 == 0, "").otherwise("max")
    return stats.station_values(_items(spark, d).select("row_id", F.substring("family", 1, 1).alias("family"), tag.alias("variant"), F.lit("u").alias("unit"), "station", "year", "value"))


_CELLS = ["row_id", "load_id", "feed", "sample_id", "sr_no", "parameter", "unit", "month", "value", "data_source", "year", "location", "latitude", "longitude", "remarks", "loaded_at"]


def _missing(c: str) -> str:
    m = f"lower(trim(coalesce({c}::VARCHAR, ''))) IN ('', 'na', 'n/a', 'null', 'none', 'nan')"
    return m + " AND lower(trim(parameter)) <> 'ph'" if c == "unit" else m


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({_missing(c)}) AS missing FROM measurements" for c in _CELLS))
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """missing cells of every column in one pass."""
    m = table(spark, d, "measurements").select(*_CELLS).withColumnsRenamed({"parameter": "Parameter", "row_id": "number"})
    return standardize.missing_cells(m).withColumn("column_name", F.lower(F.when(F.col("column_name") == "number", "row_id").otherwise(F.col("column_name"))))


@query("SELECT count(*) AS records, count(DISTINCT location) AS locations, count(DISTINCT parameter) AS parameters, count(*) FILTER (coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false)) AS mapped, count(*) FILTER (NOT coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false)) AS unmapped FROM measurements")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """F5, D6."""
    return stats.summary(table(spark, d, "measurements"), "location", "parameter", X.valid_position(F.col("latitude"), F.col("longitude")))


_TEXTS = ["feed", "parameter", "unit", "month", "value", "data_source", "year", "location", "remarks"]


@query("SELECT row_id, " + ", ".join(f"trim(regexp_replace(translate(coalesce({c}, ''), '–﻿Â', '-'), '[\\s\u00a0]+', ' ', 'g')) AS {c}" for c in _TEXTS) + " FROM measurements")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """C1 over every text column."""
    return table(spark, d, "measurements").select("row_id", *(X.clean(F.col(c)).alias(c) for c in _TEXTS))


@query(
    f"""WITH t AS (SELECT row_id, trim(value) AS p, replace(trim(value), ',', '') AS t FROM measurements)
    SELECT row_id, round(CASE WHEN regexp_matches(t, '^(\\d+(\\.\\d+)?)x10\\^(\\d+)$') THEN regexp_extract(t, '^(\\d+(\\.\\d+)?)x10', 1)::DOUBLE * pow(10, regexp_extract(t, '\\^(\\d+)$', 1)::DOUBLE) WHEN regexp_matches(t, {_NUM}) THEN TRY_CAST(t AS DOUBLE) END, 6) AS number,
           round(CASE WHEN regexp_matches(p, {_NUM}) THEN TRY_CAST(p AS DOUBLE) END, 6) AS frame_number FROM t"""
)
def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The two number readings."""
    return table(spark, d, "measurements").select("row_id", F.round(X.number(F.col("value")), 6).alias("number"), F.round(X.frame_number(F.col("value")), 6).alias("frame_number"))


@query(
    r"""WITH p AS (SELECT DISTINCT parameter FROM measurements), c AS (SELECT parameter, trim(regexp_replace(parameter, '\s+', ' ', 'g')) AS t FROM p),
    f AS (SELECT *, trim(regexp_replace(t, '\s*\((max|min)\)\s*$', '', 'i')) AS base FROM c)
    SELECT parameter, CASE WHEN regexp_full_match(t, '(t[.\-\s]*coliform|total\s+coliform)\s*(\((max|min)\))?', 'i') THEN 'Total Coliform' || CASE lower(regexp_extract(t, '\((max|min)\)$', 1, 'i')) WHEN 'max' THEN ' (Max)' WHEN 'min' THEN ' (Min)' ELSE '' END ELSE t END AS normalized,
           CASE WHEN regexp_full_match(base, '(t[.\-\s]*|total\s+)coliform', 'i') THEN 'Total Coliform' WHEN regexp_full_match(base, 'f(a?ecal)?[.\-\s]*coliform', 'i') THEN 'Faecal Coliform' ELSE base END AS family,
           lower(regexp_extract(trim(parameter), '\(\s*(max|min)\s*\)$', 1, 'i')) AS variant,
           CASE WHEN regexp_matches(trim(parameter), '\(\s*(max|min)\s*\)$', 'i') THEN trim(regexp_replace(trim(parameter), '\s*\([^)]*\)\s*$', '')) ELSE trim(parameter) END AS screening_family FROM f"""
)
def parameter_names(spark: SparkSession, d: str) -> DataFrame:
    """C4 to C7."""
    p = F.col("parameter")
    return table(spark, d, "measurements").select("parameter").distinct().select("parameter", X.normalize_parameter(p).alias("normalized"), X.family(p).alias("family"), X.variant(p).alias("variant"), X.screening_family(p).alias("screening_family"))


_MONTH_CASE = "CASE " + " ".join(f"WHEN lower(trim(month)) = '{k}' THEN {v}" for k, v in X.MONTHS.items()) + " WHEN TRY_CAST(trim(month) AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(trim(month) AS INT) ELSE 1 END"


@query(
    f"""WITH m AS (SELECT DISTINCT month, year FROM measurements), y AS (SELECT *, TRY_CAST(regexp_extract(trim(coalesce(year, '')), '^((19|20)\\d\\d)(\\.0)?$', 1) AS INT) AS yy, CASE WHEN trim(coalesce(month, '')) <> '' THEN {_MONTH_CASE} END AS mm FROM m),
    r AS (SELECT month, year, mm, make_date(yy, coalesce(mm, 1), 1) AS date_start, CASE WHEN mm IS NULL THEN make_date(yy, 12, 31) ELSE last_day(make_date(yy, mm, 1)) END AS date_end FROM y)
    SELECT month, year, date_start::VARCHAR AS date_start, date_end::VARCHAR AS date_end, CASE WHEN date_start IS NULL THEN NULL WHEN mm IS NULL THEN 'year' ELSE 'month' END AS date_precision, (year(date_start) * 100 + CASE WHEN mm IS NULL THEN 0 ELSE month(date_start) END)::INT AS sort_key,
           CASE WHEN date_start IS NULL THEN NULL WHEN mm IS NULL THEN '' ELSE strftime(date_start, '%b') END AS month_label FROM r"""
)
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Months and years as ranges with precision, sort key and label."""
    m = table(spark, d, "measurements").select("month", "year").distinct().withColumn("r", X.date_range(F.lit(""), F.col("year"), F.col("month"), F.lit("")))
    m = m.select("month", "year", "r.*")
    return m.select("*", X.sort_key(F.col("date_start"), F.col("date_precision")).alias("sort_key"), X.month_label(F.col("date_start"), F.col("date_precision")).alias("month_label")).withColumns({c: F.col(c).cast("string") for c in ("date_start", "date_end")})


def _written(day: str, other: str) -> list[str]:
    return [f"strftime({day}, '%d-%m-%Y')", f"strftime({day}, '%Y-%m-%d')", f"strftime({day}, '%d/%m/%Y')", f"strftime({day}, '%m/%d/%Y')", f"'[' || strftime({day}, '%d-%m-%Y') || ', ' || strftime({other}, '%d-%m-%Y') || ']'", f"strftime({other}, '%d-%m-%Y') || ' / ' || strftime({day}, '%d-%m-%Y')", "'31-02-2020'", "'soon'"]


@query(
    "WITH w AS (SELECT o_orderkey AS id, o_orderdate::DATE AS a, (o_orderdate + INTERVAL 40 DAY)::DATE AS b FROM orders), t AS (SELECT id, CASE id % 8 "
    + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_written("a", "b")))
    + """ END AS t, a, b FROM w), p AS (SELECT *, coalesce(try_strptime(t, '%d-%m-%Y'), try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%m/%d/%Y'))::DATE AS day FROM t)
    SELECT id, t AS date_text, CASE WHEN id % 8 = 4 THEN a ELSE day END::VARCHAR AS date_start, CASE WHEN id % 8 = 4 THEN b ELSE day END::VARCHAR AS date_end, CASE WHEN id % 8 = 4 THEN 'month' WHEN day IS NOT NULL THEN 'day' END AS date_precision FROM p"""
)
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """Days and ranges as written, in the order that notations are tried; reversed and unreadable ones are rejected."""
    k, a = F.col("o_orderkey"), F.to_date("o_orderdate")
    b = F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 40 DAY"))
    f = lambda c, form: F.date_format(c, form)
    texts = [f(a, "dd-MM-yyyy"), f(a, "yyyy-MM-dd"), f(a, "dd/MM/yyyy"), f(a, "MM/dd/yyyy"), F.concat(F.lit("["), f(a, "dd-MM-yyyy"), F.lit(", "), f(b, "dd-MM-yyyy"), F.lit("]")), F.concat(f(b, "dd-MM-yyyy"), F.lit(" / "), f(a, "dd-MM-yyyy")), F.lit("31-02-2020"), F.lit("soon")]
    t = table(spark, d, "orders").select(k.alias("id"), F.element_at(F.array(*texts), (k % 8 + 1).cast("int")).alias("date_text"))
    r = t.withColumn("r", X.date_range(F.col("date_text"), F.lit(""), F.lit(""), F.lit("")))
    return r.select("id", "date_text", F.col("r.date_start").cast("string").alias("date_start"), F.col("r.date_end").cast("string").alias("date_end"), "r.date_precision")


@query("SELECT label_id, coalesce(nullif(regexp_replace(regexp_replace(lower(location), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'location') AS slug, CASE WHEN regexp_matches(location, '\\b(u\\s*/\\s*s|upstream)\\b', 'i') AND NOT regexp_matches(location, '\\b(d\\s*/\\s*s|downstream)\\b', 'i') THEN 'US' WHEN regexp_matches(location, '\\b(d\\s*/\\s*s|downstream)\\b', 'i') AND NOT regexp_matches(location, '\\b(u\\s*/\\s*s|upstream)\\b', 'i') THEN 'DS' ELSE '' END AS marker, list_aggregate(list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(upper(location), '(^|[^A-Z0-9])\\d{1,3}\\.\\d+($|[^A-Z0-9])', '\\1 \\2', 'g'), '(^|[^A-Z0-9])\\d{1,3}\\.\\d+($|[^A-Z0-9])', '\\1 \\2', 'g'), '[A-Z0-9]+'))), 'string_agg', ' ') AS tokens FROM (SELECT label_id, CASE WHEN label_id % 3 = 0 THEN location || ' 30.97, 76.5' ELSE location END AS location FROM site_labels)")
def label_words(spark: SparkSession, d: str) -> DataFrame:
    """C16 to C18."""
    # A third of the labels gets pasted coordinates.
    s = table(spark, d, "site_labels").withColumn("location", F.when(F.col("label_id") % 3 == 0, F.concat("location", F.lit(" 30.97, 76.5"))).otherwise(F.col("location")))
    return s.select("label_id", X.slug(F.col("location")).alias("slug"), X.flow_marker(F.col("location")).alias("marker"), F.array_join(X.label_tokens(F.col("location")), " ").alias("tokens"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS price, CASE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) WHEN 'boron b' THEN 'boron' ELSE regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '\\s+', '_', 'g') END AS key FROM part")
def keys_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    """C22, C23."""
    return table(spark, d, "part").select("p_partkey", X.short_number(F.col("p_retailprice")).alias("price"), X.scale_key(F.col("p_name"), {"boron b": "boron"}).alias("key"))


@query(f"WITH s AS ({_STATIONS}) SELECT a.id AS a, b.id AS b, round({_d('a', 'b')}, 3) AS metres, round(sqrt(pow((b.lon - a.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((b.lat - a.lat) * 111320.0, 2)), 3) AS flat_metres FROM s a JOIN s b ON a.surface = b.surface AND a.id < b.id")
def station_distances(spark: SparkSession, d: str) -> DataFrame:
    """C24, C25 between all stations of a surface."""
    s = _stations(spark, d)
    b = s.select("surface", F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    j = s.join(b, "surface").where("id < b")
    c = [F.col(x) for x in ("lat", "lon", "lat2", "lon2")]
    return j.select(F.col("id").alias("a"), "b", F.round(X.haversine_m(*c), 3).alias("metres"), F.round(X.flat_m(*c), 3).alias("flat_metres"))


@query("SELECT row_number() OVER (ORDER BY part, key)::BIGINT AS sr_no, name, 'Both' AS location, unit FROM (SELECT 0 AS part, n_nationkey AS key, n_name AS name, NULL AS unit FROM nation UNION ALL SELECT 1, r_regionkey, r_name, 'mg/l' FROM region)")
def concat_renumber(spark: SparkSession, d: str) -> DataFrame:
    """UNION ALL of standard tables with new numbers, one station for all, columns by name."""
    std = lambda t, k, n: table(spark, d, t).select((F.col(k) + 1).cast("long").alias("row_id"), (F.col(k) + 1).cast("long").alias("SrNo"), F.col(n).alias("Parameter"), F.lit("1").alias("Value"), F.lit("x").alias("Location"), F.lit("30").alias("Latitude"), F.lit("76").alias("Longitude"))
    both = standardize.concat(std("nation", "n_nationkey", "n_name"), std("region", "r_regionkey", "r_name").withColumn("Unit", F.lit("mg/l")), station="Both")
    return both.select(F.col("SrNo").alias("sr_no"), F.col("Parameter").alias("name"), F.col("Location").alias("location"), F.col("Unit").alias("unit"))


@query(
    """WITH w AS (SELECT p_name AS location, p_brand AS data_source, p_size::VARCHAR || '-' || (p_size + 3)::VARCHAR AS bod, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size::VARCHAR END AS ph, p_partkey FROM part)
    SELECT location AS "Location", data_source AS "Data Source", 'mg/l' AS "Unit", 'BOD (Min)' AS "Parameter", split_part(bod, '-', 1) AS "Value", p_partkey AS "Date" FROM w
    UNION ALL SELECT location, data_source, 'mg/l', 'BOD (Max)', split_part(bod, '-', 2), p_partkey FROM w UNION ALL SELECT location, data_source, '', 'pH', ph, p_partkey FROM w WHERE ph <> ''"""
)
def wide_to_long_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Station-per-row reports as measurement rows."""
    size = F.col("p_size")
    w = table(spark, d, "part").select(F.col("p_name").alias("Name of Sampling Point"), F.col("p_brand").alias("Source"), F.concat(size.cast("string"), F.lit("-"), (size + 3).cast("string")).alias("BOD (mg/l)"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(size.cast("string")).alias("pH"), F.col("p_partkey").alias("Date"))
    return tables.wide_to_long(w).select("Location", "Data Source", "Unit", "Parameter", "Value", "Date")


@query(
    f"""WITH m AS (SELECT row_id, location, latitude + CASE WHEN row_id % 1000 = 7 THEN 0.02 ELSE 0 END AS latitude, longitude FROM measurements), p AS (SELECT location AS station, round(latitude, 6) AS lat, round(longitude, 6) AS lon, count(*) AS n, min(row_id) AS f FROM m WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND location IS NOT NULL GROUP BY ALL),
    s AS (SELECT a.station, max({_d('a', 'b')}) AS spread FROM p a JOIN p b USING (station) GROUP BY 1), u AS (SELECT station, count(*) AS positions, sum(n)::BIGINT AS n_rows, arg_min(lat, f) AS used_latitude, arg_min(lon, f) AS used_longitude FROM p GROUP BY 1)
    SELECT station, positions, n_rows, round(spread, 1) AS spread_m, used_latitude, used_longitude FROM u JOIN s USING (station) WHERE spread >= 500"""
)
def coordinate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """F6 over measurements, every thousandth row of which is moved by two kilometres."""
    m = table(spark, d, "measurements").where("location is not null").withColumn("latitude", F.col("latitude") + F.when(F.col("row_id") % 1000 == 7, 0.02).otherwise(0.0))
    return stats.position_conflicts(m, "location", "latitude", "longitude", "row_id")


def _label_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_labels").select(F.col("label_id").alias("row_id"), F.upper("location").alias("location"), "latitude", "longitude")


_LABELS_SQL = r"""r AS (SELECT label_id, upper(location) AS location, latitude, longitude FROM site_labels),
    l AS (SELECT location, median(latitude) AS lat, median(longitude) AS lon, min(label_id) AS first FROM r WHERE trim(location) <> '' AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY 1),
    t AS (SELECT *, list_distinct(regexp_extract_all(regexp_replace(regexp_replace(location, '(^|[^A-Z0-9])\d{1,3}\.\d+($|[^A-Z0-9])', '\1 \2', 'g'), '(^|[^A-Z0-9])\d{1,3}\.\d+($|[^A-Z0-9])', '\1 \2', 'g'), '[A-Z0-9]+')) AS tokens,
          regexp_matches(location, '(^|[^A-Z0-9])\d{1,3}\.\d+($|[^A-Z0-9])') OR list_contains(['OF','INTO','AT','ON','FALLING','TO','AND','WITH','IN','NEAR','FROM'], regexp_extract(location, '[A-Z0-9]+')) AS fragment FROM l)""".replace("\\\\", "\\")


@query(
    f"""WITH {_LABELS_SQL}, p AS (SELECT a.location AS location_a, b.location AS location_b, sqrt(pow((b.lon - a.lon) * 111320.0 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((b.lat - a.lat) * 111320.0, 2)) AS m,
        CASE WHEN len(a.tokens) <= len(b.tokens) THEN a.tokens ELSE b.tokens END AS s, CASE WHEN len(a.tokens) <= len(b.tokens) THEN b.tokens ELSE a.tokens END AS g, CASE WHEN len(a.tokens) <= len(b.tokens) THEN a.fragment ELSE b.fragment END AS piece
        FROM t a JOIN t b ON a.first < b.first AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.05), x AS (SELECT *, list_filter(g, lambda w: NOT list_contains(s, w)) AS more FROM p)
    SELECT location_a, location_b, round(m, 3) AS metres FROM x WHERE len(s) >= 2 AND list_has_all(g, s) AND len(more) <= 3 AND (piece OR NOT list_has_any(more, {identity.SITE_WORDS!r})) AND (m <= 150 OR (m <= 1000 AND len(s) >= 3))"""
)
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sub-labels near each other."""
    return identity.candidate_pairs(identity.labels(_label_rows(spark, d)))


@query()
def merged_labels(spark: SparkSession, d: str) -> DataFrame:
    """Which label is merged into which."""
    label = identity.labels(_label_rows(spark, d))
    return identity.merge_groups(label, identity.candidate_pairs(label))


def _loo_sql(limit_km: float) -> str:
    return f"""s AS ({_STATIONS}), p AS (SELECT a.surface, a.id, b.id AS bid, b.value, {_d('a', 'b')} AS d FROM s a JOIN s b ON a.surface = b.surface AND a.id <> b.id),
    e AS (SELECT surface, id, CASE WHEN min(d) < 1 THEN arg_min(value, (d, bid)) ELSE sum(value / pow(greatest(d, 1.0) / 1000, 2)) / sum(1 / pow(greatest(d, 1.0) / 1000, 2)) END AS estimate, count(*) AS n_stations FROM p WHERE d <= {limit_km * 1000} GROUP BY ALL),
    o AS (SELECT surface, id, value, (sum(value) OVER w - value) / nullif(count(*) OVER w - 1, 0) AS others_mean FROM s WINDOW w AS (PARTITION BY surface)),
    l AS (SELECT o.surface, o.id, o.value, e.estimate, e.n_stations, o.others_mean FROM o LEFT JOIN e ON o.surface = e.surface AND o.id = e.id)"""


@query(f"WITH {_loo_sql(60)} SELECT surface, id, round(value, 4) AS value, round(estimate, 4) AS estimate, n_stations, round(others_mean, 4) AS others_mean FROM l")
def loo_idw(spark: SparkSession, d: str) -> DataFrame:
    """L2: leave-one-out weighting within 60 km."""
    e = interpolate.leave_one_out(_stations(spark, d), 60.0)
    return e.select("surface", "id", *(F.round(c, 4).alias(c) for c in ("value", "estimate")), "n_stations", F.round("others_mean", 4).alias("others_mean"))


@query(f"WITH {_loo_sql(60)}, g AS (SELECT surface, count(*) AS n_stations, count(estimate) AS n_checked, sqrt(avg(pow(estimate - value, 2))) AS rmse, avg(abs(estimate - value)) AS mae, sqrt(avg(pow(others_mean - value, 2)) FILTER (estimate IS NOT NULL)) AS baseline_rmse FROM l GROUP BY surface) SELECT surface, n_stations, n_checked, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(baseline_rmse, 4) AS baseline_rmse, round(1 - rmse / baseline_rmse, 3) AS skill FROM g")
def validation(spark: SparkSession, d: str) -> DataFrame:
    """F16."""
    return interpolate.validation(interpolate.leave_one_out(_stations(spark, d), 60.0))


_REACH = [5.0, 20.0, 60.0, None]


@query(
    f"""WITH s AS ({_STATIONS}), r AS (SELECT unnest([5.0, 20.0, 60.0, -1.0]) AS reach_km), t AS (SELECT surface, sum(value) AS s, count(*) AS n, stddev_pop(value) AS sd FROM s GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(value) > 0),
    p AS (SELECT a.surface, a.id, b.id AS bid, b.value, {_d('a', 'b')} AS d FROM s a JOIN s b ON a.surface = b.surface AND a.id <> b.id),
    e AS (SELECT surface, id, reach_km, CASE WHEN min(d) < 1 THEN arg_min(value, (d, bid)) ELSE sum(value / pow(greatest(d, 1.0) / 1000, 2)) / sum(1 / pow(greatest(d, 1.0) / 1000, 2)) END AS estimate FROM p, r WHERE reach_km < 0 OR d <= reach_km * 1000 GROUP BY ALL),
    l AS (SELECT s.surface, s.id, reach_km, s.value, (t.s - s.value) / (t.n - 1) AS others, t.sd, e.estimate FROM s JOIN t USING (surface) CROSS JOIN r LEFT JOIN e USING (surface, id, reach_km)),
    g AS (SELECT surface, reach_km, sqrt(avg(pow(coalesce(estimate, others) - value, 2))) / any_value(sd) AS e, sqrt(avg(pow(others - value, 2))) / any_value(sd) AS b FROM l GROUP BY ALL),
    z AS (SELECT reach_km, count(*) AS n_surfaces, round(avg(e), 4) AS score, round(avg(b), 4) AS baseline FROM g GROUP BY 1)
    SELECT reach_km::DOUBLE AS reach_km, n_surfaces, score, baseline, row_number() OVER (ORDER BY score, CASE WHEN reach_km < 0 THEN 1e9 ELSE reach_km END) = 1 AS chosen, score < baseline AS beats_baseline FROM z"""
)
def choose_reach(spark: SparkSession, d: str) -> DataFrame:
    """The reach with the least scaled leave-one-out error."""
    return interpolate.choose_reach(_stations(spark, d), reaches=_REACH)


@query(
    f"""WITH s AS ({_STATIONS}), x AS (SELECT surface, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM s GROUP BY 1),
    w AS (SELECT surface, CASE WHEN b - a < 0.01 THEN (a + b) / 2 - 0.005 ELSE a END AS a, CASE WHEN b - a < 0.01 THEN (a + b) / 2 + 0.005 ELSE b END AS b, CASE WHEN e - c < 0.01 THEN (c + e) / 2 - 0.005 ELSE c END AS c, CASE WHEN e - c < 0.01 THEN (c + e) / 2 + 0.005 ELSE e END AS e FROM x),
    b AS (SELECT surface, round(greatest(a - (b - a) * 0.08, -90), 6) AS min_lat, round(least(b + (b - a) * 0.08, 90), 6) AS max_lat, round(greatest(c - (e - c) * 0.08, -180), 6) AS min_lon, round(least(e + (e - c) * 0.08, 180), 6) AS max_lon FROM w),
    g AS (SELECT surface, i AS "row", j AS col, max_lat - i * (max_lat - min_lat) / 191 AS lat, min_lon + j * (max_lon - min_lon) / 191 AS lon FROM b, range(192) t(i), range(192) u(j)),
    p AS (SELECT g.surface, g."row", g.col, s.id, s.value, {_d('g', 's')} AS d FROM g JOIN s USING (surface))
    SELECT surface, "row"::INT AS "row", col::INT AS col, round(CASE WHEN min(d) < 1 THEN arg_min(value, (d, id)) ELSE sum(value / pow(greatest(d, 1.0) / 1000, 2)) / sum(1 / pow(greatest(d, 1.0) / 1000, 2)) END, 4) AS estimate, round(min(d), 1) AS nearest_m FROM p GROUP BY ALL"""
)
def grid_idw(spark: SparkSession, d: str) -> DataFrame:
    """The grid of every surface."""
    return interpolate.grid(_stations(spark, d))


@query()
def kriging_models(spark: SparkSession, d: str) -> DataFrame:
    """Fitted models, all suppliers one surface per region of 16."""
    return interpolate.kriging(_stations(spark, d).withColumn("surface", F.floor(F.col("id") / 200)), 20)


# The tree: supplier k flows to k / 2; an edge is as long as its key tells.
def _edges(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").where("s_suppkey >= 2").select(k.alias("edge"), k.alias("up"), F.floor(k / 2).alias("down"), (1000.0 + k * 37 % 100 * 50).alias("length"), F.lit(None).cast("double").alias("weight"))


_EDGES = "SELECT s_suppkey AS edge, s_suppkey AS up, s_suppkey // 2 AS down, 1000.0 + s_suppkey * 37 % 100 * 50 AS length FROM supplier WHERE s_suppkey >= 2"
_FLOW = f"""e AS ({_EDGES}), t(edge, node) AS (SELECT edge, up FROM e UNION ALL SELECT t.edge, e.up FROM t JOIN e ON e.down = t.node),
    leaf AS (SELECT up FROM e WHERE up NOT IN (SELECT down FROM e)), f AS (SELECT edge, count(*)::DOUBLE AS flow FROM t JOIN leaf ON leaf.up = t.node GROUP BY 1),
    sh AS (SELECT e.*, f.flow, f.flow / sum(f.flow) OVER (PARTITION BY e.down) AS share FROM e JOIN f USING (edge))"""


@query(f"WITH RECURSIVE {_FLOW} SELECT edge, round(flow, 6) AS flow, round(share, 6) AS share FROM sh")
def flow_shares(spark: SparkSession, d: str) -> DataFrame:
    """Accumulated flow and shares at junctions."""
    return graph.flow_shares(_edges(spark, d)).select("edge", F.round("flow", 6).alias("flow"), F.round("share", 6).alias("share"))


@query(f"WITH RECURSIVE {_FLOW}, w(start, node, distance, share) AS (SELECT up, up, 0.0::DOUBLE, 1.0::DOUBLE FROM sh UNION ALL SELECT w.start, sh.down, w.distance + sh.length, w.share * sh.share FROM w JOIN sh ON sh.up = w.node WHERE w.distance + sh.length <= 8000) SELECT node AS target, start AS station, 'DOWN' AS relation, round(distance, 3) AS distance, round(share, 6) AS share FROM w WHERE start <> node UNION ALL SELECT start, node, 'UP', round(distance, 3), round(share, 6) FROM w WHERE start <> node")
def tree_flow_relations(spark: SparkSession, d: str) -> DataFrame:
    """Flow relations within 8 km."""
    e = graph.flow_shares(_edges(spark, d))
    r = graph.relations(e, e.select(F.col("up").alias("node")), 8000.0)
    return r.select("target", "station", "relation", F.round("distance", 3).alias("distance"), F.round("share", 6).alias("share"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), w(node, distance) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION ALL SELECT e.up, w.distance + e.length FROM w JOIN e ON e.down = w.node) SELECT node, round(distance, 3) AS distance FROM w")
def outlet_distances(spark: SparkSession, d: str) -> DataFrame:
    """K7: the way to the outlet."""
    return graph.outlet_distance(_edges(spark, d), spark.range(1, 2).select(F.col("id").alias("node"))).select("node", F.round("distance", 3).alias("distance"))


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey + 7 IN (SELECT s_suppkey FROM supplier)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of a link table."""
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    e = n.where("node % 3 = 0").select(F.col("node").alias("a"), (F.col("node") + 7).alias("b")).join(n.select(F.col("node").alias("b")), "b", "left_semi")
    return graph.components(n, e.select("a", "b"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    p = lambda i: F.struct((76 + k % 5 / 5 + i * 0.05).alias("x"), (30 + F.floor(k / 5) / 5 + i * 0.01).alias("y"))
    return table(spark, d, "nation").select(k.cast("long").alias("line_id"), F.concat(F.initcap("n_name"), F.lit(" Drain")).alias("name"), F.array(*(p(F.lit(i)) for i in range(4))).alias("pts"))


@query(
    f"""WITH s AS (SELECT x.id AS station, x.lat, x.lon, CASE WHEN x.id % 2 = 0 THEN {_base('n_name')} ELSE '' END AS own FROM ({_STATIONS}) x JOIN nation ON n_nationkey = x.surface),
    g AS (SELECT n_nationkey AS line_id, {_base('n_name')} AS name, i, 76 + n_nationkey % 5 / 5 + i * 0.05 AS x1, 30 + floor(n_nationkey / 5) / 5 + i * 0.01 AS y1, 76 + n_nationkey % 5 / 5 + (i + 1) * 0.05 AS x2, 30 + floor(n_nationkey / 5) / 5 + (i + 1) * 0.01 AS y2 FROM nation, range(3) t(i)),
    h AS (SELECT *, sqrt(pow((x2 - x1) * 111320.0 * cos(radians((y1 + y2) / 2)), 2) + pow((y2 - y1) * 111320.0, 2)) AS length FROM g), b AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
    p AS (SELECT station, line_id, own, name, lat, lon, x1, y1, x2, y2, length, before, i, greatest(0.0, least(1.0, ((lon - x1) * cos(radians(lat)) * (x2 - x1) * cos(radians(lat)) + (lat - y1) * (y2 - y1)) / (pow((x2 - x1) * cos(radians(lat)), 2) + pow(y2 - y1, 2)))) AS t FROM s JOIN b ON abs(lat - y1) < 0.3 AND abs(lon - x1) < 0.4),
    m AS (SELECT *, sqrt(pow((x1 + t * (x2 - x1) - lon) * 111320.0 * cos(radians((lat + y1 + t * (y2 - y1)) / 2)), 2) + pow((y1 + t * (y2 - y1) - lat) * 111320.0, 2)) AS metres FROM p),
    l AS (SELECT station, line_id, own, name, min(metres) AS metres, arg_min(before + t * length, metres) AS along FROM m WHERE metres <= 15000 GROUP BY ALL),
    r AS (SELECT *, CASE WHEN own <> '' AND own = name AND metres <= 2000 THEN 0 WHEN own <> '' AND own = name THEN 1 WHEN metres <= 2000 THEN 2 END AS grade FROM l),
    w AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY grade, metres, line_id) AS n FROM r WHERE grade IS NOT NULL)
    SELECT s.station, line_id::BIGINT AS line_id, round(metres, 1) AS metres, round(along, 1) AS along, CASE grade WHEN 0 THEN 'name' WHEN 1 THEN 'name, far' WHEN 2 THEN 'nearest' ELSE 'none' END AS method FROM s LEFT JOIN (SELECT * FROM w WHERE n = 1) w USING (station)"""
)
def station_channel_match(spark: SparkSession, d: str) -> DataFrame:
    """Stations on lines by name, then by distance."""
    s = _stations(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("surface"), "n_name"), "surface").select(F.col("id").alias("station"), F.when(F.col("id") % 2 == 0, F.concat(F.initcap("n_name"), F.lit(" Nala"))).otherwise("").alias("name"), "lat", "lon")
    return channels.match_stations(s, _lines(spark, d), 2.0)


def _river(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    extra = _lines(spark, d).withColumns({"kind": F.lit("river"), "upstream_area": F.lit(None).cast("double"), "discharge": F.lit(None).cast("double")})
    return river.build(extra, _stations(spark, d).select(F.col("id").alias("station"), F.lit("").alias("name"), "lat", "lon"), 5.0)


@query()
def river_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of stations along oriented lines within 32 km."""
    edges, at = _river(spark, d)
    return river.relate(at.withColumnRenamed("station", "target"), river.flow_segments(edges, at, 32.0, river.is_tree(edges)), 32.0)


@query()
def river_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimates every kilometre along the water."""
    edges, at = _river(spark, d)
    points = channels.samples_along(edges, 1000.0).select(F.concat_ws(":", "edge", "k").alias("target"), "edge", "t")
    values = _stations(spark, d).select(F.col("id").alias("station"), "value")
    e = river.along_river(points, river.relate(points, river.flow_segments(edges, at, 32.0), 32.0), values, decay_km=8.0)
    return e.select("target", "n_stations", *(F.round(c, 4).alias(c) for c in ("estimate", "nearest_m", "confidence")))


@query()
def channel_table(spark: SparkSession, d: str) -> DataFrame:
    """Stations on channels, ordered towards their outlets."""
    s = _stations(spark, d).select(F.col("id").alias("station"), F.concat(F.lit("Site "), F.col("id").cast("string")).alias("label"), F.lit("").alias("name"), "lat", "lon")
    return network.channel_network(s, _lines(spark, d), 5.0)


@query("SELECT l_suppkey AS location, list_aggregate(list_sort(list(DISTINCT l_returnflag)), 'string_agg', ',') AS families, min(year(l_shipdate)) AS first_year, count(DISTINCT year(l_shipdate)) AS n_years FROM lineitem GROUP BY 1")
def availability(spark: SparkSession, d: str) -> DataFrame:
    """parameters and years of every station."""
    a = series.availability(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("location"), F.col("l_returnflag").alias("family"), F.year("l_shipdate").alias("year")))
    return a.select("location", F.array_join("families", ",").alias("families"), F.array_min("years").alias("first_year"), F.size("years").cast("long").alias("n_years"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'unknown' WHEN event_type = 'click' THEN CASE WHEN value BETWEEN 6.5 AND 8.5 THEN 'safe' ELSE 'unsafe' END WHEN value <= 50 THEN 'safe' ELSE 'unsafe' END AS status FROM events) GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """how many values are safe, unsafe or unknown."""
    return scale_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH s AS ({_STATIONS}), v AS (SELECT surface, id, lat, lon, 'upper' AS bound, value + 10 AS value FROM s UNION ALL SELECT surface, id, lat, lon, 'lower', value FROM s WHERE id % 3 <> 0),
    p AS (SELECT a.surface, a.bound, a.id, b.id AS bid, b.value, {_d('a', 'b')} AS d FROM v a JOIN v b ON a.surface = b.surface AND a.bound = b.bound AND a.id <> b.id),
    e AS (SELECT surface, bound, id, CASE WHEN min(d) < 1 THEN arg_min(value, (d, bid)) ELSE sum(value / pow(greatest(d, 1.0) / 1000, 2)) / sum(1 / pow(greatest(d, 1.0) / 1000, 2)) END AS estimate, max(exp(-3 * d / 60000)) AS confidence FROM p WHERE d <= 60000 GROUP BY ALL)
    SELECT 'all_years' AS period, v.surface::VARCHAR AS family, v.bound, v.id, v.value, round(e.estimate, 4) AS estimate, round(e.confidence, 4) AS confidence FROM v LEFT JOIN e USING (surface, bound, id)"""
)
def bounds_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-out runs of both bounds."""
    s = _stations(spark, d)
    v = s.select(F.lit("all_years").alias("period"), F.col("surface").cast("string").alias("family"), "id", "lat", "lon", F.when(F.col("id") % 3 != 0, F.col("value")).alias("lower"), (F.col("value") + 10).alias("upper"))
    return interpolate.surfaces(v, 60.0).select("period", "family", "bound", "id", "value", F.round("estimate", 4).alias("estimate"), F.round("confidence", 4).alias("confidence"))


@query("SELECT n_nationkey::BIGINT AS line_id, n_nationkey::BIGINT AS channel FROM nation")
def line_channels(spark: SparkSession, d: str) -> DataFrame:
    """K5: touching lines of one name."""
    return channels.channels(_lines(spark, d))


@query(f"WITH RECURSIVE e AS ({_EDGES}), w(node, distance) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION ALL SELECT e.up, w.distance + e.length FROM w JOIN e ON e.down = w.node) SELECT s.s_nationkey AS channel, s.s_suppkey AS station, row_number() OVER (PARTITION BY s.s_nationkey ORDER BY w.distance DESC, s.s_name)::INT AS position FROM supplier s JOIN w ON w.node = s.s_suppkey")
def channel_order(spark: SparkSession, d: str) -> DataFrame:
    """Stations of a channel from far to near its outlet."""
    out = graph.outlet_distance(_edges(spark, d), spark.range(1, 2).select(F.col("id").alias("node")))
    placed = table(spark, d, "supplier").join(out, F.col("s_suppkey") == F.col("node")).select(F.col("s_nationkey").alias("channel"), F.col("s_suppkey").alias("station"), F.col("s_name").alias("label"), F.col("distance").alias("to_outlet_m"))
    return channels.order_stations(placed)


@query(f"SELECT edge, k::INT AS k, round(length * k / ceil(length / 500), 4) AS t FROM (SELECT *, unnest(range(0, ceil(length / 500)::BIGINT + 1)) AS k FROM ({_EDGES}))")
def samples_along(spark: SparkSession, d: str) -> DataFrame:
    """Points along edges."""
    return channels.samples_along(_edges(spark, d), 500.0).select("edge", "k", F.round("t", 4).alias("t"))


@query("WITH e AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), p AS (SELECT o_orderkey AS id, date '2024-01-01' + (o_orderkey % 25)::INT AS a, date '2024-01-01' + (o_orderkey % 25)::INT + (o_orderkey % 11)::INT AS b FROM orders) SELECT id, round(sum(v), 4) AS total FROM p LEFT JOIN e ON e.day BETWEEN p.a AND p.b GROUP BY id")
def precipitation_period_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums of daily values over periods."""
    daily = table(spark, d, "events").select(F.lit("x").alias("place"), F.to_date("ts").alias("day"), "value")
    k = F.col("o_orderkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 25).cast("int"))
    p = table(spark, d, "orders").select(k.alias("id"), F.lit("x").alias("place"), start.alias("start"), F.date_add(start, (k % 11).cast("int")).alias("end"))
    return series.period_sums(p, daily).select("id", "total")


@query("SELECT user_id AS station, arg_max(event_id, (year(ts) * 100 + month(ts), event_type, -event_id)) AS event_id FROM events GROUP BY 1")
def latest_samples(spark: SparkSession, d: str) -> DataFrame:
    """G1: the latest sample of each station."""
    e = table(spark, d, "events").select(F.col("user_id").alias("station"), (F.year("ts") * 100 + F.month("ts")).alias("sort_key"), F.col("event_type").alias("file_name"), F.col("event_id").alias("row_id"), "event_id")
    return screening.latest(e).select("station", "event_id")


_KINDS = ["pH", "Turbidity", "DO", "BOD", "Chloride", "NO3-N", "Faecal Coliform", "T-Coliform (max)", "pH (min)"]
_KNOWN = "coalesce(ph, ph_min) AS p, tu, dox, bod, cl, fc, tc"


def _reason(text: str, value: str) -> str:
    a, b = text.split("{}")
    return f"'{a}' || CASE WHEN {value} = floor({value}) THEN {value}::BIGINT::VARCHAR ELSE {value}::VARCHAR END || '{b}'"


def _use_sql(use: str, core: list[tuple[str, str]], extended: list[tuple[str, str]], known: str) -> str:
    texts = lambda rules: "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in rules) + ")" if rules else "''"
    return f"SELECT station, sample, '{use}' AS use_case, {texts(core)} AS core_reasons, {texts(extended)} AS extended_reasons, {known} AS known FROM k"


@query(
    "WITH e AS (SELECT user_id AS station, strftime(ts, '%Y%m%d') AS sample, event_id, event_id % 9 AS kind, floor(value % 12 * 4) / 4 AS v FROM events), s AS (SELECT station, sample, "
    + ", ".join(f"arg_min(v, event_id) FILTER (kind = {k} AND v IS NOT NULL) AS {n}" for k, n in enumerate(["ph", "tu", "dox", "bod", "cl", "no3", "fc", "tc", "ph_min"]))
    + f" FROM e GROUP BY ALL), k AS (SELECT station, sample, {_KNOWN} FROM s), j AS ("
    + " UNION ALL ".join([
        _use_sql("human_consumption", [("p < 6.5 OR p > 8.5", _reason("pH {} outside 6.5-8.5", "p")), ("tu > 1", _reason("Turbidity {} NTU exceeds 1 NTU", "tu")), ("tc > 0", _reason("Total coliform {} MPN/100mL should be 0", "tc"))], [("cl > 250", _reason("Chloride {} mg/L exceeds 250 mg/L desirable limit", "cl"))], "coalesce(p, tu, tc) IS NOT NULL"),
        _use_sql("agriculture", [("p < 6 OR p > 8.5", _reason("pH {} outside 6.0-8.5", "p"))], [("cl > 140", _reason("Chloride {} mg/L may be restrictive for chloride-sensitive crops", "cl"))], "p IS NOT NULL"),
        _use_sql("aquatic_life", [("p < 6.5 OR p > 8.5", _reason("pH {} outside 6.5-8.5", "p")), ("dox < 4", _reason("DO {} mg/L below 4.0 mg/L", "dox"))], [("bod > 3", _reason("BOD {} mg/L exceeds 3.0 mg/L", "bod")), ("tu > 25", _reason("Turbidity {} NTU is high for healthy stream habitat", "tu"))], "coalesce(p, dox) IS NOT NULL"),
        _use_sql("bathing", [("p < 6.5 OR p > 8.5", _reason("pH {} outside 6.5-8.5", "p")), ("dox < 5", _reason("DO {} mg/L below 5.0 mg/L", "dox")), ("bod > 3", _reason("BOD {} mg/L exceeds 3.0 mg/L", "bod")), ("fc > 0", _reason("Fecal coliform {} MPN/100mL should be 0", "fc")), ("fc IS NULL AND tc > 0", _reason("Total coliform {} MPN/100mL should be 0", "tc"))], [("tu > 10", _reason("Turbidity {} NTU is high for safe/pleasant bathing", "tu"))], "coalesce(p, dox, bod, fc, tc) IS NOT NULL"),
    ])
    + ") SELECT station, sample, use_case, CASE WHEN NOT known THEN 'unknown' WHEN core_reasons <> '' THEN 'unsafe' WHEN extended_reasons <> '' THEN 'caution' ELSE 'safe' END AS status, core_reasons, extended_reasons FROM j"
)
def screened_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every sample under every use, plain readings before max before min."""
    e = table(spark, d, "events")
    p = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 9 + 1).cast("int"))
    r = e.select(F.col("user_id").alias("station"), F.date_format("ts", "yyyyMMdd").alias("sample"), F.lit("f").alias("file_name"), F.col("event_id").alias("row_id"), p.alias("parameter"), (F.floor(F.col("value") % 12 * 4) / 4).alias("numeric_value"))
    return screening.screen(r).select("station", "sample", "use_case", "status", *(F.array_join(c, "; ").alias(c) for c in ("core_reasons", "extended_reasons")))


@query()
def screened_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each station's latest sample with its coverage."""
    e = table(spark, d, "events")
    p = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 9 + 1).cast("int"))
    r = e.select(F.col("user_id").alias("station"), F.lit("f").alias("file_name"), F.date_format("ts", "yyyyMMdd").cast("int").alias("sort_key"), F.year("ts").alias("year"), F.month("ts").alias("month_index"), F.col("event_id").alias("row_id"), p.alias("parameter"), (F.col("value") % 12).alias("numeric_value"))
    return screening.screen_stations(r, "bathing", 2024, 1).select("station", "sort_key", "status", "label", *(F.array_join(c, "; ").alias(c) for c in ("reasons", "confirmed", "proxy", "missing")))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN event_type = 'click' THEN CASE WHEN value BETWEEN 6.5 AND 8.5 THEN 'safe' ELSE 'unsafe' END WHEN value <= 50 THEN 'safe' ELSE 'unsafe' END AS status FROM events")
def scale_status(spark: SparkSession, d: str) -> DataFrame:
    """One value on one scale."""
    low = F.when(F.col("event_type") == "click", 6.5).otherwise(F.lit(float("-inf")))
    high = F.when(F.col("event_type") == "click", 8.5).otherwise(50.0)
    return table(spark, d, "events").select("event_id", screening.status(F.col("value"), low, high).alias("status"))


@query("SELECT s_suppkey AS station, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey * 3.5 END AS elevation, CASE WHEN s_suppkey % 11 = 0 THEN 'invalid_coordinates' WHEN s_suppkey % 7 = 0 THEN 'no_data' ELSE 'ok' END AS status FROM supplier WHERE s_suppkey % 11 <> 0 UNION ALL SELECT s_suppkey, NULL, 'invalid_coordinates' FROM supplier WHERE s_suppkey % 11 = 0")
def elevation_status(spark: SparkSession, d: str) -> DataFrame:
    """Elevations of distinct stations."""
    k = F.col("s_suppkey")
    lon = (k % 1000) / 10
    s = table(spark, d, "supplier").select(k.alias("Location"), F.when(k % 11 == 0, 100.0).otherwise(10 + F.floor(k / 1000)).alias("Latitude"), lon.alias("Longitude"))
    t = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(lon.alias("lon"), (10 + F.floor(k / 1000)).alias("lat"), (k * 3.5).alias("m"))
    return tables.elevations(s, t).select(F.col("Location").alias("station"), F.col("Elevation").cast("double").alias("elevation"), "status")


@query(f"WITH s AS ({_STATIONS}) SELECT id FROM s WHERE lon + 0.01 >= 76.2 AND lon <= 76.6 AND lat + 0.01 >= 30.1 AND lat <= 30.5")
def box_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose box meets the given one."""
    s = _stations(spark, d).select("id", F.col("lon").alias("xmin"), (F.col("lon") + 0.01).alias("xmax"), F.col("lat").alias("ymin"), (F.col("lat") + 0.01).alias("ymax"))
    return tables.in_box(s, 76.2, 30.1, 76.6, 30.5).select("id")


@query("SELECT n_nationkey AS surface, s.s_suppkey AS id FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) s WHERE n <= 6")
def top_six(spark: SparkSession, d: str) -> DataFrame:
    """H3: a top-k report per group."""
    s = _stations(spark, d).withColumn("n", F.row_number().over(stats.W.partitionBy("surface").orderBy(F.col("value").desc(), "id")))
    return s.where("n <= 6").select("surface", "id")


@query("SELECT location AS station, arg_min({'a': latitude, 'b': longitude}, row_id).a AS latitude, arg_min({'a': latitude, 'b': longitude}, row_id).b AS longitude FROM measurements WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND location IS NOT NULL GROUP BY 1")
def station_dimension(spark: SparkSession, d: str) -> DataFrame:
    """the first valid position of every station."""
    m = table(spark, d, "measurements").where(X.valid_position(F.col("latitude"), F.col("longitude")) & F.col("location").isNotNull())
    g = m.groupBy(F.col("location").alias("station")).agg(F.min_by(F.struct("latitude", "longitude"), "row_id").alias("p"))
    return g.select("station", "p.latitude", "p.longitude")


@query("SELECT l_suppkey AS location, l_returnflag AS family, year(l_shipdate) AS year, round(coalesce(avg(l_quantity) FILTER (l_linenumber = 1), avg(l_quantity) FILTER (l_linenumber <> 1)), 4) AS value, count(*) FILTER (l_linenumber = 1) > 0 AS from_year_rows, count(*) AS n FROM lineitem GROUP BY ALL")
def yearly_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Whole-year rows before the mean of the others."""
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("location"), F.col("l_returnflag").alias("family"), F.year("l_shipdate").alias("year"), F.when(F.col("l_linenumber") == 1, "year").otherwise("month").alias("date_precision"), F.col("l_quantity").alias("numeric_value"))
    return series.yearly(r)


@query("SELECT user_id AS location, event_type AS parameter, CAST(ts AS DATE) + INTERVAL 12 HOUR AS midpoint, value AS numeric_value, event_id AS row_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE), event_id)::INT AS n FROM events WHERE value IS NOT NULL")
def trend_points(spark: SparkSession, d: str) -> DataFrame:
    """Series in the order of their midpoints."""
    e = table(spark, d, "events").select(F.col("user_id").alias("location"), F.col("event_type").alias("parameter"), F.to_date("ts").alias("date_start"), F.date_add(F.to_date("ts"), 1).alias("date_end"), F.col("value").alias("numeric_value"), F.col("event_id").alias("row_id"))
    return series.trend(e).withColumn("midpoint", F.col("midpoint").cast("timestamp_ntz"))


_NOT_NAMES = names.STOP_WORDS + names.TYPE_WORDS


def _usable_sql(k: int) -> str:
    return f"(i + {k} >= 1 AND coalesce(regexp_full_match(t[i + {k}], '[A-Z]{{2,}}') AND NOT list_contains({_NOT_NAMES!r}, t[i + {k}]), false))"


def _title_sql(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1:1]) || lower(p[2:])), '-')), ' ')"


@query(
    f"""WITH o AS (SELECT entry_id, regexp_replace(upper(regexp_replace(coalesce(location, ''), '[^A-Za-z0-9/ -]+', ' ', 'g')), '{names.RECEIVING}.*$', '') AS own FROM field_entries),
    t AS (SELECT entry_id, list_filter(string_split_regex(own, '\\s+'), lambda w: w <> '') AS t FROM o), p AS (SELECT entry_id, t, unnest(range(1, len(t) + 1)) AS i FROM t),
    c AS (SELECT entry_id, i, CASE WHEN regexp_full_match(t[i], '[A-Z-]*[A-Z][A-Z-]*-({'|'.join(names.TYPE_WORDS)})') THEN {_title_sql('[t[i]]')}
          WHEN NOT list_contains({names.TYPE_WORDS!r}, t[i]) THEN NULL
          WHEN t[i] = 'RIVER' AND {_usable_sql(1)} THEN CASE WHEN {_usable_sql(2)} THEN {_title_sql('t[i + 1 : i + 2]')} ELSE {_title_sql('[t[i + 1]]')} END
          WHEN {_usable_sql(-1)} THEN CASE WHEN {_usable_sql(-2)} THEN {_title_sql('t[i - 2 : i - 1]')} ELSE {_title_sql('[t[i - 1]]')} END || CASE WHEN t[i] = 'RIVER' THEN '' ELSE ' ' || {_title_sql('[t[i]]')} END END AS name FROM p),
    f AS (SELECT entry_id, arg_min(name, i) AS name FROM c WHERE name IS NOT NULL GROUP BY 1)
    SELECT entry_id, coalesce(f.name, '') AS water_body, {_base("coalesce(f.name, '')")} AS base FROM field_entries LEFT JOIN f USING (entry_id)"""
)
def water_body_names(spark: SparkSession, d: str) -> DataFrame:
    """The water body named in each label."""
    e = table(spark, d, "field_entries").select("entry_id", names.parse_water_body("location").alias("water_body"))
    return e.withColumn("base", names.name_base("water_body"))


@query()
def alias_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of aliases and names."""
    a = table(spark, d, "water_body_aliases").select("alias", "name").distinct()
    return a.select("alias", "name", F.round(names.name_similarity("alias", "name"), 4).alias("likeness"))


@query("SELECT event_type, date_trunc('day', ts) AS start, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY ALL")
def streamed_daily_stats(spark: SparkSession, d: str) -> DataFrame:
    """Windowed statistics of a stream that reads the events once."""
    schema = table(spark, d, "events").schema
    # The result goes to the shared folder, not to the driver.
    out = f"{ensure_checkpoint_dir(spark)}/daily_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.windowed_stats(stream, "ts", "event_type", "value")
    run = found.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    daily = spark.read.schema(found.schema).parquet(out)
    return daily.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", *(F.round(c, 6).alias(c) for c in ("mean", "min", "max")))


@query("SELECT least(400, count(*)) AS loaded_rows, count(*) AS total_rows, greatest(count(*) - 400, 0) AS remaining_rows, count(*) > 400 AS has_more FROM measurements")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    """A3: loaded, total and remaining rows of a limited scan."""
    return tables.row_counts(table(spark, d, "measurements").select("row_id"), tables.DEFAULT_ROWS)


@query("SELECT location, latitude, longitude, round(avg(CASE WHEN regexp_matches(trim(value), " + _NUM + ") THEN TRY_CAST(trim(value) AS DOUBLE) END) + 1e-9, 4) AS mean FROM measurements WHERE regexp_matches(trim(value), " + _NUM + ") GROUP BY ALL")
def popup_means(spark: SparkSession, d: str) -> DataFrame:
    """the mean of every station at its positions."""
    m = table(spark, d, "measurements").withColumn("v", X.frame_number(F.col("value")))
    return stats.popup_means(m, "location", "latitude", "longitude", "v", 14).withColumn("mean", F.round(F.col("mean") + 1e-9, 4))


@query(
    """WITH m AS (SELECT location AS station, row_id, latitude, longitude, trim(coalesce(data_source, '')) AS body FROM measurements WHERE trim(coalesce(location, '')) <> ''),
    p AS (SELECT station, arg_min({'a': latitude, 'b': longitude}, row_id) AS p FROM m WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY 1),
    n AS (SELECT station, body, count(*) AS n FROM m WHERE body <> '' GROUP BY ALL), t AS (SELECT station, arg_min(body, (-n, body)) AS body FROM n GROUP BY 1)
    SELECT s.station, p.p.a AS latitude, p.p.b AS longitude, coalesce(t.body, '') AS water_body FROM (SELECT DISTINCT station FROM m) s LEFT JOIN p USING (station) LEFT JOIN t USING (station)"""
)
def station_table(spark: SparkSession, d: str) -> DataFrame:
    """One row a station: first valid position and most frequent water body (here the data source)."""
    return stats.station_table(table(spark, d, "measurements"), "location", "latitude", "longitude", "row_id", "data_source").drop("parsed")


@query("WITH s AS (SELECT s_name AS station, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE floor(s_acctbal / 500) END AS elevation FROM supplier) SELECT station, elevation, row_number() OVER (ORDER BY elevation DESC, station) AS rank FROM s WHERE elevation IS NOT NULL UNION ALL SELECT station, NULL, NULL FROM s WHERE elevation IS NULL")
def elevation_rank(spark: SparkSession, d: str) -> DataFrame:
    """Stations from the highest down."""
    s = table(spark, d, "supplier").select(F.col("s_name").alias("station"), F.when(F.col("s_suppkey") % 9 != 0, F.floor(F.col("s_acctbal") / 500).cast("double")).alias("elevation"))
    return stats.elevation_ranks(s)


@query(
    f"""WITH s AS ({_STATIONS}), c AS (SELECT surface, avg(lon) AS cx, avg(lat) AS cy FROM s GROUP BY 1),
    w AS (SELECT s.surface AS channel, s.id AS node, row_number() OVER (PARTITION BY s.surface ORDER BY round(sqrt(pow((cx - lon) * 111320.0 * cos(radians((lat + cy) / 2)), 2) + pow((cy - lat) * 111320.0, 2)), 3) DESC, s.id) AS n FROM s JOIN c USING (surface))
    SELECT channel, node FROM w WHERE n <= 6"""
)
def far_ends(spark: SparkSession, d: str) -> DataFrame:
    """H3: the six ends of each channel farthest from their centre."""
    return network.far_ends(_stations(spark, d).select(F.col("surface").alias("channel"), F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y")))


@query(
    f"""WITH r AS (SELECT trim(alias) AS alias, trim(name) AS name, row_number() OVER () AS at FROM water_body_aliases WHERE trim(alias) <> '' AND trim(name) <> ''),
    k AS (SELECT base, min(name) AS name FROM (SELECT {_base('alias')} AS base, name FROM r UNION SELECT {_base('name')}, name FROM r) GROUP BY 1 HAVING count(DISTINCT name) = 1),
    e AS (SELECT entry_id, location, {_base('location')} AS base FROM field_entries) SELECT entry_id, coalesce(k.name, location) AS name FROM e LEFT JOIN k USING (base)"""
)
def canonical_entries(spark: SparkSession, d: str) -> DataFrame:
    """E5, C20: typed names replaced by the preferred name of their base, where a base has just one."""
    a = table(spark, d, "water_body_aliases")
    pairs = a.where("trim(alias) <> '' and trim(name) <> ''").select(F.inline(F.array(F.struct(names.name_base("alias").alias("base"), F.trim("name").alias("name")), F.struct(names.name_base("name").alias("base"), F.trim("name").alias("name")))))
    one = pairs.groupBy("base").agg(F.min("name").alias("name"), F.max("name").alias("last")).where("name = last").select("base", "name")
    return names.canonical_names(table(spark, d, "field_entries").select("entry_id", F.col("location").alias("name")), "name", one)


@query("SELECT event_id, user_id AS location_group, event_type AS parameter FROM events ORDER BY user_id, event_type, ts::DATE, event_id LIMIT 50")
def records_head(spark: SparkSession, d: str) -> DataFrame:
    """H1, H2: the first fifty records in their order (a top-k report)."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("location_group"), F.col("event_type").alias("parameter"), F.to_date("ts").alias("sort_key"), F.lit("f").alias("file_name"), F.col("event_id").alias("row_id"))
    return stats.records_in_order(e).limit(50).select("event_id", "location_group", "parameter")


@query(
    """WITH r AS (SELECT event_id AS row_id, user_id AS location, event_type AS parameter, ts::DATE AS day, value FROM events WHERE value IS NOT NULL), w AS (SELECT l_shipdate::DATE - 1 AS d, l_quantity AS v, l_suppkey AS place FROM lineitem),
    b AS (SELECT location, day, arg_min(value, row_id) AS rain FROM r WHERE parameter = 'click' GROUP BY ALL)
    SELECT r.row_id, r.location, r.day AS date_start, round(b.rain, 6) AS rain FROM r LEFT JOIN b USING (location, day) WHERE parameter <> 'click'"""
)
def trend_with_rain(spark: SparkSession, d: str) -> DataFrame:
    """Points of a trend with the rain of their period, from the table's own rain rows (here: clicks)."""
    e = table(spark, d, "events").where("value is not null").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("location"), F.when(F.col("event_type") == "click", "Daily rainfall").otherwise(F.col("event_type")).alias("parameter"), F.to_date("ts").alias("date_start"), F.to_date("ts").alias("date_end"), F.col("value").alias("numeric_value"))
    p = series.with_rain(e.where("parameter <> 'Daily rainfall'"), series.rain_bars(e))
    return p.select("row_id", "location", "date_start", F.round("rain", 6).alias("rain"))


@query(
    """WITH s AS (SELECT event_id, value, event_id % 4 AS k FROM events), d AS (SELECT *, CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'max' WHEN 2 THEN 'min' ELSE 'max' END AS kind, CASE k WHEN 0 THEN 6.5 WHEN 2 THEN 4.0 END AS lo, CASE k WHEN 0 THEN 8.5 WHEN 1 THEN 25.0 WHEN 3 THEN 2.0 END AS hi, CASE k WHEN 3 THEN 4.0 END AS f FROM s)
    SELECT event_id, round(CASE WHEN f IS NOT NULL THEN 0.0 WHEN kind = 'range' THEN greatest(0.0, least(lo - greatest((hi - lo) * 0.75, 1.0), value - greatest((hi - lo) * 0.75, 1.0) * 0.25)) ELSE 0.0 END, 6) AS axis_low,
           round(CASE WHEN f IS NOT NULL THEN greatest(f, value) WHEN kind = 'range' THEN greatest(hi + greatest((hi - lo) * 0.75, 1.0), value + greatest((hi - lo) * 0.75, 1.0) * 0.25) ELSE greatest(coalesce(hi, lo) * 1.6, coalesce(value * 1.15, 0.0), coalesce(hi, lo) + 1) END, 6) AS axis_high FROM d"""
)
def scale_axes(spark: SparkSession, d: str) -> DataFrame:
    """The axis of each value's scale."""
    k = (F.col("event_id") % 4 + 1).cast("int")
    of = lambda *v: F.element_at(F.array(*(F.lit(x).cast("string" if isinstance(v[0], str) else "double") for x in v)), k)
    a = X.axis_end(of("range", "max", "min", "max"), of(None, None, None, 0.0).cast("double"), of(None, None, None, 4.0).cast("double"), of(6.5, None, 4.0, None), of(8.5, 25.0, None, 2.0), F.col("value"))
    return table(spark, d, "events").select("event_id", a.alias("a")).select("event_id", F.round("a.low", 6).alias("axis_low"), F.round("a.high", 6).alias("axis_high"))


@query()
def map_colors(spark: SparkSession, d: str) -> DataFrame:
    """Values with their position and colour on the ramp, and as displayed."""
    s = _stations(spark, d).withColumn("v", F.col("value") + 1000)
    ends = s.groupBy("surface").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    p = s.join(ends, "surface").withColumn("position", X.ramp_position(F.col("v"), F.col("low"), F.col("high")))
    return p.select("id", F.round("position", 6).alias("position"), F.array_join(X.ramp_color(F.col("position")), ",").alias("color"), X.compact_number(F.col("v")).alias("shown"))


@query()
def utm_positions(spark: SparkSession, d: str) -> DataFrame:
    """K1: stations in metres of their zone, and back."""
    s = _stations(spark, d).withColumn("zone", utm.zone(F.col("lon")))
    s = s.withColumn("m", utm.to_utm(F.col("lat"), F.col("lon"), F.col("zone")))
    back = utm.from_utm(F.col("m.x"), F.col("m.y"), F.col("zone"), F.lit(False))
    return s.select("id", "zone", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round(back["lat"], 9).alias("lat"), F.round(back["lon"], 9).alias("lon"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    s = _stations(spark, d)
    k = F.col("id")
    years = s.withColumn("year", F.explode(F.array(F.lit(2023), F.lit(2024))))
    return years.select((k * 10 + F.col("year") % 10).alias("row_id"), k.alias("station"), F.concat(F.lit("P"), F.col("surface").cast("string")).alias("family"), F.when(k % 5 == 0, "max").otherwise("").alias("variant"), F.lit("mg/l").alias("unit"), "year", (F.col("value") + F.col("year") - 2023).alias("value"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


@query()
def surfaces_auto(spark: SparkSession, d: str) -> DataFrame:
    """All surfaces of all years and of every year, limit chosen, without a network."""
    s = surfaces.interpolate_all(_records(spark, d), None, reason="no line table", size=48)
    return s.cells.select("period", "family", "row", "col", "lower", "upper", "confidence")


@query()
def surfaces_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the surfaces are."""
    s = surfaces.summary(surfaces.interpolate_all(_records(spark, d), None, max_distance_km=40.0, size=16))
    return s.withColumns({c: F.array_join(c, ", ") for c in ("parameters", "methods", "warnings")})
