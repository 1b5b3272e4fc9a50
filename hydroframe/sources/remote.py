"""Daily weather and terrain heights from services, through a function that the caller gives; both also come as tables.

A fetch function gets one request and returns its answer; it runs in tasks, so it must be picklable. Requests are made
distinct first and spread over tasks; what fails or is late is missing, never an error.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import text as X

FIRST_DAY = dt.date(1940, 1, 1)
#: Points of one request, and seconds that a task spends on requests.
BATCH, BUDGET_S = 100, 20.0

Weather = Callable[[float, float, dt.date, dt.date], Sequence[tuple[dt.date, float]]]
Heights = Callable[[Sequence[tuple[float, float]]], Sequence[float | None]]


def weather_spans(records: DataFrame, today: dt.date) -> DataFrame:
    """(place, lat, lon, start, end): what is to be asked for every place: its first position and the days from its
    first to its last period, within 1940-01-01 and yesterday; places without position or days are left out."""
    ok = X.valid_position(F.col("latitude"), F.col("longitude"))
    g = records.groupBy(F.col("location").alias("place")).agg(
        F.min_by(F.struct("latitude", "longitude"), F.when(ok, F.col("row_id"))).alias("p"), F.min("date_start").alias("a"), F.max("date_end").alias("b")
    )
    start, end = F.greatest("a", F.lit(FIRST_DAY)), F.least("b", F.lit(today - dt.timedelta(days=1)))
    return g.select("place", F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon"), start.alias("start"), end.alias("end")).where("lat is not null and start <= end")


def daily_weather(spans: DataFrame, fetch: Weather) -> DataFrame:
    """(place, day, value) of the days of every span."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, Sequence] = {}
        for f in frames:
            rows = []
            for place, lat, lon, start, end in zip(f["place"], f["lat"], f["lon"], f["start"], f["end"]):
                key = (round(lat, 4), round(lon, 4), start, end)
                if key not in seen:
                    try:
                        seen[key] = fetch(*key)
                    except Exception:  # noqa: BLE001
                        seen[key] = ()
                rows += [(place, day, value) for day, value in seen[key] if value is not None and start <= day <= end]
            yield pd.DataFrame(rows, columns=["place", "day", "value"])

    parts = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return spans.repartition(parts, "place").mapInPandas(run, "place string, day date, value double")


def point_heights(points: DataFrame, fetch: Heights, budget_s: float = BUDGET_S) -> DataFrame:
    """(lon, lat, m) of distinct points, five decimals, asked for in batches; what a task's budget doesn't reach is missing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = time.monotonic() + budget_s
        for f in frames:
            for at in range(0, len(f), BATCH):
                part = f.iloc[at : at + BATCH]
                if time.monotonic() > end:
                    return
                try:
                    m = fetch(list(zip(part["lon"], part["lat"])))
                except Exception:  # noqa: BLE001
                    continue
                yield part.assign(m=pd.Series(list(m), index=part.index, dtype="float64")).dropna(subset=["m"])

    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    asked = points.where(X.valid_position(F.col("lat"), F.col("lon"))).select(F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat")).distinct()
    return asked.repartition(parts, "lon", "lat").mapInPandas(run, "lon double, lat double, m double")
