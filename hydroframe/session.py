"""A session's registry of measurement tables, and the library's functions under SQL names."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.operators import series, standardize, stats
from hydroframe.sources import tables


#: Functions under SQL names; water-body names and likeness are column functions of functions.names.
FUNCTIONS = (
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN 2 * 6371000.0D * asin(sqrt(least(1.0D, greatest(0.0D, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)))))",
    "clean_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(translate(coalesce(t, ''), '\u2013\ufeff\u00c2', '-'), '[\\\\s\u00a0]+', ' '))",
)
#: Plans of figures that are kept.
FIGURES = 128
#: Bytes of an uploaded file, at most.
MAX_UPLOAD = 10 * 1024 * 1024


class Registry:
    """Named standard tables; one is active. Tables are lazy plans and stay unchanged when combined."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, tuple[str, DataFrame]] = {}
        self.active: str | None = None
        self._figures: dict[tuple, DataFrame] = {}
        for sql in FUNCTIONS:
            spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION " + sql)

    def register(self, name: str, df: DataFrame) -> str:
        """Adds a standard table, makes it active, and returns its id."""
        key = uuid.uuid4().hex
        self.tables[key] = (name, standardize.validate(df))
        self.active = key
        df.createOrReplaceTempView(f"dataset_{key}")
        return key

    def upload(self, path: str, name: str | None = None, rows: int | str = "all") -> str:
        """Reads a file of any supported form and at most MAX_UPLOAD bytes, reshapes and standardises it."""
        limit = tables.check_rows(rows)
        if os.path.getsize(path) > MAX_UPLOAD:
            raise ValueError(f"an uploaded file has at most {MAX_UPLOAD} bytes; read larger ones from a folder")
        raw = tables.with_row_id(tables.wide_to_long(tables.read_upload(self.spark, path)))
        raw = raw if limit is None else raw.where(f"row_id <= {limit}")
        return self.register(name or path.rsplit("/", 1)[-1], standardize.standardize(raw, path.rsplit("/", 1)[-1]))

    def select(self, key: str) -> DataFrame:
        """Makes a table active."""
        if key not in self.tables:
            raise KeyError(key)
        self.active = key
        return self.tables[key][1]

    def combine(self, keys: list[str], name: str | None = None, station: str | None = None) -> str:
        """UNION ALL of at least two different tables, as a new active one."""
        if len(set(keys)) < 2 or len(set(keys)) != len(keys):
            raise ValueError("at least two different tables are needed")
        label = name or " + ".join(self.tables[k][0] for k in keys)
        return self.register(label, standardize.concat(*(self.tables[k][1] for k in keys), station=station))

    def figure(self, kind: str, parameter: str | None = None, location: str | None = None, year: int | None = None, month: int | None = None) -> DataFrame:
        """The table behind a figure of the active measurements: trend, distribution (by year, or by month of a year) or
        stream (stations by years). The last FIGURES plans are kept."""
        if kind not in ("trend", "distribution", "stream"):
            raise ValueError(f"unknown figure: {kind}")
        key = (self.active, kind, parameter, location, year, month)
        if key not in self._figures:
            r = standardize.records(self.tables[self.active][1]).withColumn("numeric_value", F.col("frame_value")).where("numeric_value is not null")
            if parameter is None:
                # As shown first: the first parameter by name that has numbers.
                parameter = (r.agg(F.min("parameter")).first() or [None])[0] or ""
            r = series.filter_records(r, parameter, None if kind == "stream" else location, year, month)
            if kind == "trend":
                table = series.trend(r)
            elif kind == "distribution":
                table = stats.distribution(r.withColumn("bucket", F.col("year") if year is None else F.greatest("month_index", F.lit(1))), ["bucket"], "numeric_value")
            else:
                table = stats.station_year_means(r, "location", "year", "numeric_value")
            self._figures[key] = table
            while len(self._figures) > FIGURES:
                self._figures.pop(next(iter(self._figures)))
        return self._figures[key]

    def list(self) -> list[tuple[str, str, bool]]:
        """(id, name, active) of all tables."""
        return [(k, n, k == self.active) for k, (n, _) in self.tables.items()]

    def reset(self) -> None:
        """Forgets all tables."""
        for k in self.tables:
            self.spark.catalog.dropTempView(f"dataset_{k}")
        self.tables, self.active, self._figures = {}, None, {}
