"""Series tables: trends, rainfall of periods, yearly preference, station by year maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions import text as X


def period_sums(periods: DataFrame, daily: DataFrame, digits: int = 4) -> DataFrame:
    """The sum of daily values over each period (id, place, start, end), null where there is none.

    The range join becomes an equality join on place and year-month: a period is filed under the months it touches
    and daily values are summed per day first.
    """
    days = daily.groupBy("place", "day").agg(F.sum("value").alias("v")).withColumn("m", F.trunc("day", "month"))
    filed = periods.withColumn("m", F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))))
    met = filed.join(days, ["place", "m"]).where(F.col("day").between(F.col("start"), F.col("end"))).groupBy("id").agg(F.round(F.sum("v"), digits).alias("total"))
    return periods.join(met, "id", "left")


def trend(records: DataFrame) -> DataFrame:
    """Points of every (location, variant) series in the order of their dates' midpoints."""
    m = X.midpoint(F.col("date_start"), F.col("date_end"))
    w = W.partitionBy("location", "parameter").orderBy("midpoint", "row_id")
    return records.where("numeric_value is not null").select("location", "parameter", m.alias("midpoint"), "numeric_value", "row_id").withColumn("n", F.row_number().over(w))


def rain_rows(records: DataFrame) -> DataFrame:
    """The precipitation rows of records."""
    return records.where(F.lower("parameter").rlike("precipitation|rainfall") & F.col("numeric_value").isNotNull())


def rain_bars(records: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """(location, date_start, date_end, midpoint, width_s, rain, source): one bar per location and period, from the
    table's own precipitation rows, or where it has none from daily values (place, day, value) over the periods of the
    shown records; without values a period has no bar.

    Of several rows of one location and period the first holds. A bar is 0.8 of its period wide, at least of a day.
    """
    keys = ["location", "date_start", "date_end"]
    own = rain_rows(records).groupBy(*keys).agg(F.min_by("numeric_value", "row_id").alias("rain"))
    if daily is None or not own.isEmpty():
        bars = own.withColumn("source", F.lit("table"))
    else:
        shown = records.where("numeric_value is not null").groupBy(*keys).agg(F.min("row_id").alias("id")).select("id", *keys)
        sums = period_sums(shown.select("id", F.col("location").alias("place"), F.col("date_start").alias("start"), F.col("date_end").alias("end")), daily).select("id", F.col("total").alias("rain"))
        bars = shown.join(sums, "id").select(*keys, "rain", F.lit("weather").alias("source")).where("rain is not null")
    seconds = F.greatest(F.datediff("date_end", "date_start") * 86_400, F.lit(86_400))
    return bars.select(*keys, X.midpoint(F.col("date_start"), F.col("date_end")).alias("midpoint"), (seconds * 0.8).alias("width_s"), "rain", "source")


def with_rain(points: DataFrame, bars: DataFrame) -> DataFrame:
    """points (location, date_start, date_end, ...) with the rain of their period, null where there is none."""
    return points.join(bars.select("location", "date_start", "date_end", "rain"), ["location", "date_start", "date_end"], "left")


def yearly(records: DataFrame, digits: int = 4) -> DataFrame:
    """One value per station, family and year: the mean of whole-year rows if there are any, else of the others."""
    whole = F.col("date_precision") == "year"
    g = records.where("numeric_value is not null").groupBy("location", "family", "year").agg(F.avg(F.when(whole, F.col("numeric_value"))).alias("a"), F.avg(F.when(~whole, F.col("numeric_value"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("location", "family", "year", F.round(F.coalesce("a", "b"), digits).alias("value"), F.col("a").isNotNull().alias("from_year_rows"), "n")


def filter_records(records: DataFrame, parameter: str | None = None, location: str | None = None, year: int | None = None, month: int | None = None) -> DataFrame:
    """Records of a parameter (any case), location group, year of start and month; whole-year rows have no month."""
    out = records
    if parameter is not None:
        out = out.where(F.lower("parameter") == parameter.lower())
    if location is not None:
        out = out.where(F.lower("location_group") == location.lower())
    if year is not None:
        out = out.where(F.col("year") == year)
    if month is not None:
        out = out.where((F.col("date_precision") != "year") & (F.month("date_start") == month))
    return out


def availability(records: DataFrame) -> DataFrame:
    """Parameters and years that each station has, sorted."""
    return records.groupBy("location").agg(F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("year")).alias("years"))


def latest_values(records: DataFrame) -> DataFrame:
    """The last value of every station and family with the Min and Max endpoints of the same day."""
    g = records.where("numeric_value is not null").groupBy("location", "family", "date_start").agg(
        F.max_by("numeric_value", F.when(F.col("variant") == "", F.col("row_id"))).alias("value"), F.max_by("numeric_value", F.when(F.col("variant") == "min", F.col("row_id"))).alias("low"), F.max_by("numeric_value", F.when(F.col("variant") == "max", F.col("row_id"))).alias("high")
    )
    return g.groupBy("location", "family").agg(F.max_by(F.struct("date_start", "value", "low", "high"), "date_start").alias("b")).select("location", "family", "b.*")


def pages(groups: DataFrame, size: int = 8) -> DataFrame:
    """(grp, page): consecutive groups on pages of at most size rows, a group never split; a larger one stands alone.

    groups: ord, grp, n. The fold is sequential, so it takes the group sizes (a presentation list) to the driver.
    """
    out, page, filled = [], 1, 0
    for g in groups.orderBy("ord").toLocalIterator():
        if filled and filled + g["n"] > size:
            page, filled = page + 1, 0
        out.append((g["grp"], page))
        filled += g["n"]
    return groups.sparkSession.createDataFrame(out, f"grp {dict(groups.dtypes)['grp']}, page int")
