"""Scans and sinks: measurement tables in CSV, JSON, Excel or wide form, folders, parquet with a bounding box."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions import text as X
from hydroframe.plans.io import cut

#: Rows that a limited scan takes unless told otherwise.
DEFAULT_ROWS = 400
SNIFFED_BYTES = 64 * 1024
SEPARATORS = ",;\t|"
# Parameters recognised as columns of station-per-row reports.
WIDE_PARAMETERS = (
    "temperature|dissolved oxygen|ph|conductivity|bod|faecal coliform|fecal coliform|total coliform|t.coliform|nitrate+nitrite-n|total kjeldahl nitrogen|"
    "ammonical-n|total organic nitrogen|nitraten|nitriten|phosphate|turbidity|total dissolved solids"
).split("|")
# Other headers of such reports.
HEADER_ALIASES = {"name of sampling point": "Location", "date and timestamp": "Date", "source": "Data Source"}
META_COLUMNS = ["Location", "Latitude", "Longitude", "Date", "Year", "Month", "Data Source", *X.WATER_BODY_COLUMNS]


def check_rows(rows: int | str) -> int | None:
    """A row limit: a positive whole number, or 'all'."""
    if rows == "all":
        return None
    if isinstance(rows, bool) or not isinstance(rows, int) or rows < 1:
        raise ValueError("rows must be a positive whole number or 'all'")
    return rows


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Numbers rows 1..n in file order, in the JVM and without moving them into one task: rows are written once to the
    shared folder, counted per partition (one number each goes to the driver), and numbered from their partition's
    offset. Order and partitions of the written rows are fixed, so numbers don't change when a task runs again."""
    rows = cut(df.select(F.monotonically_increasing_id().alias("_at"), *(F.col(f"`{c}`") for c in df.columns if c != name)))
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total - (p << 33) + 1))
        total += counts[p]
    # One row per partition.
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _shift long"))
    return rows.join(shift, part == F.col("_part")).select((F.col("_at") + F.col("_shift")).alias(name), *(F.col(f"`{c}`") for c in df.columns if c != name))


def sniff_separator(head: str) -> str:
    """The separator of delimited text; the comma where none stands out."""
    try:
        return csv.Sniffer().sniff(head, delimiters=SEPARATORS).delimiter
    except csv.Error:
        first = head.splitlines()[0] if head.strip() else ""
        return max(SEPARATORS, key=first.count) if any(s in first for s in SEPARATORS) else ","


def has_broken_cells(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted cell holds a line break: a line with an odd number of quotes (one pass over splits)."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited file or folder with header, all columns text, names and cells cleaned.

    Files are split between tasks, but for those with line breaks inside cells, which only a whole reading can cut.
    """
    raw = spark.read.csv(path, header=True, sep=separator, inferSchema=False, multiLine=has_broken_cells(spark, path), escape='"', encoding="UTF-8")
    names = spark.range(1).select(*(X.clean(F.lit(c)).alias(f"c{i}") for i, c in enumerate(raw.columns))).first()
    return raw.toDF(*(f"_c{i}" for i in range(len(raw.columns)))).select(*(X.clean(F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)))


def read_measurements(spark: SparkSession, path: str, rows: int | str = DEFAULT_ROWS) -> DataFrame:
    """Measurement rows of a CSV file in file order, with row_id; the first `rows` of them."""
    limit = check_rows(rows)
    if not path.lower().endswith(".csv") or not (Path(path).exists() or "://" in path):
        raise ValueError("an existing .csv file is needed")
    df = with_row_id(read_delimited(spark, path))
    return df if limit is None else df.where(F.col("row_id") <= limit)


def row_counts(rows_read: DataFrame, limit: int | None) -> DataFrame:
    """(loaded_rows, total_rows, remaining_rows, has_more) of a scan that takes the first `limit` rows."""
    total = F.count(F.lit(1))
    loaded = total if limit is None else F.least(total, F.lit(limit).cast("long"))
    return rows_read.agg(loaded.alias("loaded_rows"), total.alias("total_rows")).select("*", (F.col("total_rows") - F.col("loaded_rows")).alias("remaining_rows"), (F.col("total_rows") > F.col("loaded_rows")).alias("has_more"))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A table in CSV, TSV, text, JSON or Excel form, as text columns; at least two columns, no binary content."""
    kind = os.path.splitext(path)[1].lower()
    if kind in (".csv", ".tsv", ".txt"):
        with open(path, "rb") as f:
            head = f.read(SNIFFED_BYTES)
        if b"\0" in head:
            raise ValueError("the file isn't text")
        df = read_delimited(spark, path, sniff_separator(head.decode("utf-8-sig", "replace")))
    elif kind == ".json":
        df = spark.read.json(path, multiLine=True)
        df = df.select(*(X.clean(F.col(f"`{c}`")).alias(c) for c in df.columns))
    elif kind in (".xlsx", ".xls"):
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path, dtype=str).fillna(""))
    else:
        raise ValueError(f"unknown kind of file: {kind}")
    if len(df.columns) < 2:
        raise ValueError("a table has at least two columns")
    return df


def from_dataframe(df: DataFrame) -> DataFrame:
    """A Spark table as text columns, the derived NumericValue left out; nulls, and zeros of numeric columns, are blank."""
    if len({c.lower() for c in df.columns}) != len(df.columns):
        raise ValueError("columns must have different names")
    return df.select(*(X.clean_typed(F.col(f"`{c}`"), t).alias(c) for c, t in df.dtypes if c != "NumericValue"))


def read_folder(spark: SparkSession, folder: str, leave_out: Sequence[str] = ()) -> DataFrame:
    """All CSV files of a folder, in the order of their names and lines, by column name; columns absent from a file are
    null. Files with the same header are one scan, whatever their number."""
    names = sorted(p.name for p in Path(folder).glob("*.csv") if p.name not in leave_out)
    if not names:
        raise ValueError("the folder has no CSV file")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for name in names:
        with open(Path(folder) / name, encoding="utf-8-sig", newline="") as f:
            by_header.setdefault(tuple(next(csv.reader(f), [])), []).append(str(Path(folder) / name))
    parts = []
    for paths in by_header.values():
        raw = spark.read.csv(paths, header=True, inferSchema=False, multiLine=has_broken_cells(spark, paths), escape='"', encoding="UTF-8")
        columns = spark.range(1).select(*(X.clean(F.lit(c)).alias(f"c{i}") for i, c in enumerate(raw.columns))).first()
        at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        plain = raw.select(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file_name"), at.alias("_at"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(raw.columns)))
        parts.append(plain.select("file_name", "_at", *(X.clean(F.col(f"_c{i}")).alias(n) for i, n in enumerate(columns))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("file_name", "_at").drop("_at")


def wide_to_long(df: DataFrame) -> DataFrame:
    """Station-per-row reports as measurement rows: one per filled cell of a recognised column.

    The unit is the header's first bracket; 'a-b' becomes a (Min) and a (Max) row, the lesser first. Rows without
    location and blank cells are left out. Where no date is given the year comes from the data source's text.
    """
    df = df.toDF(*(HEADER_ALIASES.get(c.strip().casefold(), c.strip()) for c in df.columns))
    if "Parameter" not in df.columns and "Location" in df.columns:
        import re

        found = []
        for c in df.columns:
            name = re.sub(r"\s*\([^)]*\)|\s*\[[^\]]*\]", "", c).strip()
            if name.casefold() in WIDE_PARAMETERS:
                unit = re.search(r"\(([^)]*)\)", c)
                found.append((c, name, unit[1] if unit else ""))
        if not found:
            raise ValueError("no known parameter among the columns")
        meta = [c for c in META_COLUMNS if c in df.columns]
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("Parameter"), F.lit(u).alias("Unit"), F.col(f"`{c}`").cast("string").alias("Value")) for i, (c, n, u) in enumerate(found)))).alias("cell")
        long = df.where(F.trim(F.coalesce("Location", F.lit(""))) != "").select(*meta, cells).select(*meta, "cell.*").where(F.trim(F.coalesce("Value", F.lit(""))) != "")
        shape = r"^\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*$"
        ends = F.array_sort(F.array(*(F.regexp_extract("Value", shape, k).try_cast("double") for k in (1, 2))))
        split = F.when(F.col("Value").rlike(shape), F.array(*(F.struct(F.concat("Parameter", F.lit(tag)).alias("p"), X.short_number(ends[k]).alias("v")) for k, tag in enumerate((" (Min)", " (Max)"))))).otherwise(F.array(F.struct(F.col("Parameter").alias("p"), F.trim("Value").alias("v"))))
        df = long.select(*meta, "Unit", "ord", F.inline(split)).withColumnsRenamed({"p": "Parameter", "v": "Value"}).drop("ord")
    if "Data Source" in df.columns:
        year = F.nullif(F.regexp_extract(F.coalesce("Data Source", F.lit("")), r"((?:19|20)\d{2})", 1), F.lit(""))
        undated = (F.trim(F.coalesce(F.col("Date").cast("string"), F.lit(""))) == "") if "Date" in df.columns else F.lit(True)
        if "Year" in df.columns:
            df = df.withColumn("Year", F.coalesce(F.col("Year").cast("string"), F.when(undated, year)))
        elif not df.where(undated & year.isNotNull()).isEmpty():
            df = df.withColumn("Year", F.when(undated, year))
    return df


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose box meets the given one; on parquet the four comparisons reach the row groups' statistics."""
    return df.where((F.col("xmax") >= west) & (F.col("xmin") <= east) & (F.col("ymax") >= south) & (F.col("ymin") <= north))


def resolve_source(*candidates: str | None, variable: str = "HYDROFRAME_NETWORK") -> str | None:
    """The first existing path: those given, then the environment's, then none."""
    for c in (*candidates, os.environ.get(variable)):
        if c and Path(c).expanduser().exists():
            return str(Path(c).expanduser())
    return None


def alias_table(*tables: DataFrame) -> DataFrame:
    """(base, name) of alias tables; later tables override earlier ones, and every name stands for itself."""
    from hydroframe.functions.names import name_base

    parts = [t.select(F.trim("alias").alias("alias"), F.trim("name").alias("name"), F.lit(i).alias("ord"), F.monotonically_increasing_id().alias("at")).where("alias <> '' AND name <> ''") for i, t in enumerate(tables)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    own = rows.select(F.col("name").alias("alias"), "name", F.lit(-1).alias("ord"), (-F.col("at")).alias("at"))
    w = W.partitionBy("base").orderBy(F.col("ord").desc(), F.col("at").desc())
    return rows.unionByName(own).withColumn("base", name_base("alias")).withColumn("rank", F.row_number().over(w)).where("rank = 1").select("base", "name")


def write_measurements(df: DataFrame, path: str, order_by: str = "row_id") -> None:
    """CSV with the canonical columns first, numbered anew, extra columns last; parts in order."""
    from hydroframe.operators.standardize import OUTPUT_COLUMNS

    numbered = renumbered(df, order_by)
    extra = [c for c in df.columns if c not in OUTPUT_COLUMNS and c not in ("NumericValue", order_by)]
    numbered.select(*[c for c in OUTPUT_COLUMNS if c in numbered.columns], *extra).write.mode("overwrite").csv(path, header=True)


def renumbered(df: DataFrame, order_by: str = "row_id") -> DataFrame:
    """SrNo 1..n in the order of a column; the sort is a range sort, so no single task holds all rows."""
    return with_row_id(df.orderBy(order_by).drop("SrNo"), "SrNo")


def to_csv_text(df: DataFrame, limit: int = 100_000) -> str:
    """A table of at most limit rows as CSV text on the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write a folder instead")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows(["" if v is None else v for v in r] for r in rows)
    return out.getvalue()


def consolidate(spark: SparkSession, folder: str, known_locations: dict[str, str] | None = None, leave_out: Sequence[str] = ()) -> DataFrame:
    """All CSV files of a folder as one validated standard table, numbered anew in the order of files and lines."""
    from hydroframe.operators.standardize import standardize, validate

    rows = with_row_id(read_folder(spark, folder, leave_out))
    return validate(renumbered(standardize(rows, known_locations=known_locations)))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def elevations(stations: DataFrame, terrain: DataFrame) -> DataFrame:
    """Distinct stations (Location, Latitude, Longitude) with elevation and status ok, no_data or invalid_coordinates."""
    s = stations.select("Location", "Latitude", "Longitude").distinct()
    valid = X.valid_position(F.col("Latitude"), F.col("Longitude"))
    t = terrain.select(F.round("lon", 5).alias("_lon"), F.round("lat", 5).alias("_lat"), F.col("m").alias("Elevation")).dropDuplicates(["_lon", "_lat"])
    joined = s.join(t, (F.round("Longitude", 5) == F.col("_lon")) & (F.round("Latitude", 5) == F.col("_lat")) & valid, "left").drop("_lon", "_lat")
    return joined.withColumn("status", F.when(~valid, "invalid_coordinates").when(F.col("Elevation").isNull(), "no_data").otherwise("ok"))
