"""From raw rows to the canonical measurement table and to analysis records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import text as X
from hydroframe.plans.io import cut

OUTPUT_COLUMNS = ["SrNo", "Parameter", "Unit", "Date", "Value", "Data Source", "Location", "Latitude", "Longitude"]
REQUIRED = ["Parameter", "Value", "Location", "Latitude", "Longitude"]


def _column(df: DataFrame, name: str):
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def standardize(raw: DataFrame, file_name: str = "", known_locations: dict[str, str] | None = None) -> DataFrame:
    """Canonical rows of raw text rows with row_id; all-blank rows are left out but keep their number.

    Rows whose date can't be read have a null Date and are in rejected(); others have a day, or the written or
    implied range in brackets.
    """
    c = lambda n: _column(raw, n)
    cells = [n for n in raw.columns if n not in ("row_id", "file_name")]
    filled = reduce(lambda a, b: a | b, [X.clean(F.col(f"`{n}`")) != "" for n in cells])
    source = F.coalesce(c("file_name"), F.lit(file_name))
    place = F.nullif(X.clean(c("Location")), F.lit(""))
    if known_locations:
        place = F.coalesce(place, F.try_element_at(F.create_map(*[F.lit(x) for kv in known_locations.items() for x in kv]), source))
    span = X.date_range(c("Date"), c("Year"), c("Month"), source)
    day = lambda f: F.date_format(f, "dd-MM-yyyy")
    written = F.when(F.col("span.date_precision") == "day", day(F.col("span.date_start"))).when(F.col("span").isNotNull(), F.concat(F.lit("["), day(F.col("span.date_start")), F.lit(", "), day(F.col("span.date_end")), F.lit("]")))
    out = raw.where(filled).withColumn("span", span)
    water = [n for n in X.WATER_BODY_COLUMNS if n in raw.columns]
    return out.select(
        "row_id", F.col("row_id").alias("SrNo"), X.normalize_parameter(c("Parameter")).alias("Parameter"), X.clean(c("Unit")).alias("Unit"), written.alias("Date"), X.clean(c("Value")).alias("Value"),
        X.clean(c("Data Source")).alias("Data Source"), F.coalesce(place, F.lit("")).alias("Location"), X.clean(c("Latitude")).alias("Latitude"), X.clean(c("Longitude")).alias("Longitude"),
        X.first_filled(*(c(n) for n in water)).alias("Water Body") if water else F.lit("").alias("Water Body"), source.alias("file_name"),
        F.col("span.date_start").alias("date_start"), F.col("span.date_end").alias("date_end"), F.col("span.date_precision").alias("date_precision"),
    )


def rejected(standard: DataFrame) -> DataFrame:
    """Rows whose date can't be read."""
    return standard.where(F.col("date_start").isNull())


def validate(standard: DataFrame) -> DataFrame:
    """The table itself; raises if it is empty or a required column has no value at all (one aggregate)."""
    row = standard.agg(F.count(F.lit(1)).alias("n"), *(F.max(X.clean(F.col(n)) != "").alias(n) for n in REQUIRED)).first()
    lacking = [n for n in REQUIRED if not row[n]]
    if not row["n"] or lacking:
        raise ValueError("required data are missing: " + ", ".join(lacking or REQUIRED))
    return standard


def records(standard: DataFrame) -> DataFrame:
    """Analysis facts: typed dates, numbers, keys and positions of canonical rows."""
    lat, lon = X.frame_number(F.col("Latitude")), X.frame_number(F.col("Longitude"))
    place = F.trim(F.regexp_replace("Location", r"\bparK\b", "Park"))
    return standard.select(
        "row_id", "file_name", place.alias("location"), place.alias("location_group"), F.col("Parameter").alias("parameter"), X.family(F.col("Parameter")).alias("family"), X.variant(F.col("Parameter")).alias("variant"),
        F.col("Unit").alias("unit"), X.month_label(F.col("date_start"), F.col("date_precision")).alias("month"), F.when(F.col("date_precision") == "year", 0).otherwise(F.month("date_start")).alias("month_index"),
        F.year("date_start").alias("year"), F.col("Date").alias("date"), "date_start", "date_end", "date_precision", X.sort_key(F.col("date_start"), F.col("date_precision")).alias("sort_key"),
        F.col("Value").alias("raw_value"), X.number(F.col("Value")).alias("numeric_value"), X.frame_number(F.col("Value")).alias("frame_value"), F.col("Data Source").alias("source"),
        lat.alias("latitude"), lon.alias("longitude"), X.valid_position(lat, lon).alias("has_coordinates"), F.col("Water Body").alias("water_body"),
    )


def missing_cells(raw: DataFrame) -> DataFrame:
    """(column_name, missing) over all columns, in one pass; a blank unit of pH isn't missing."""
    cells = [c for c in raw.columns if c not in ("row_id", "file_name")]
    parameter = F.lower(X.clean(_column(raw, "Parameter")))

    def gone(c: str):
        m = F.lower(X.clean(F.col(f"`{c}`"))).isin(X.MISSING_MARKERS)
        return m & (parameter != "ph") if c.lower() == "unit" else m

    one = raw.agg(*(F.count_if(gone(c)).alias(f"m{i}") for i, c in enumerate(cells)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cells)))))


def concat(*tables: DataFrame, station: str | None = None) -> DataFrame:
    """UNION ALL of standard tables in the given order, rows numbered anew; optionally one station for all."""
    if not tables:
        raise ValueError("nothing to combine")
    from hydroframe.sources.tables import with_row_id

    parts = [t.withColumn("_part", F.lit(i)) for i, t in enumerate(tables)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("_part", "row_id").drop("_part", "row_id", "SrNo")
    if station is not None:
        out = out.withColumn("Location", F.lit(X_clean(station)))
    out = with_row_id(out)
    return validate(out.withColumn("SrNo", F.col("row_id")))


def X_clean(text: str) -> str:
    """clean() of a driver-side text."""
    return " ".join(text.replace("﻿", "").replace("Â", "").replace("–", "-").split())


def load_csv(spark, path: str, rows: int | str = 400, merge_stations: bool = True) -> DataFrame:
    """A validated standard table from a CSV file; variants of one station's label become one."""
    from pathlib import Path

    from hydroframe.sources.tables import read_measurements

    table = standardize(read_measurements(spark, path, rows), Path(path).name)
    return validate(merged_stations(table)[0] if merge_stations else table)


def merged_stations(standard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The standard table with merged labels, and the report (name, merged)."""
    from hydroframe.operators import identity

    places = standard.select("row_id", F.col("Location").alias("location"), X.frame_number(F.col("Latitude")).alias("latitude"), X.frame_number(F.col("Longitude")).alias("longitude"))
    label = identity.labels(places)
    into = cut(identity.merge_groups(label, identity.candidate_pairs(label)))
    merged = standard.join(into.select(F.col("location").alias("Location"), "merged_into"), "Location", "left").withColumn("Location", F.coalesce("merged_into", "Location"))
    report = into.groupBy(F.col("merged_into").alias("name")).agg(F.array_sort(F.collect_list("location")).alias("merged"))
    return merged.select(*standard.columns), report
