"""Scans, services, station tables, quantiles and presentation columns on small tables with known results."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.functions import text as X
from hydroframe.functions import utm
from hydroframe.operators import interpolate, network, series, standardize, stats
from hydroframe.plans import reference_queries
from hydroframe.sources import remote, tables


def test_row_ids(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 3 % 1000).alias("v")).orderBy("v")
    got = tables.with_row_id(df, "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 1001)) and all(r.v == r.n - 1 for r in got)
    assert tables.with_row_id(df.where("false")).collect() == []


def test_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Parameter,Value,Location,Latitude,Longitude,Date\npH,7,B,30,76,01-01-2024\n")
    (tmp_path / "a.csv").write_text('Value,Parameter,Location,Latitude,Longitude,Year,Month,Remark\n8,pH,"A\n1",30,76,2023,,x\n9,pH,A,30,76,2023,Feb,y\n')
    (tmp_path / "c d.csv").write_text("Parameter,Value,Location,Latitude,Longitude,Date\npH,6,C,30,76,02-01-2024\n")
    (tmp_path / "out.csv").write_text("x\n1\n")
    rows = tables.consolidate(spark, str(tmp_path), leave_out=["out.csv"]).orderBy("SrNo").collect()
    assert [(r.SrNo, r.Location, r.Value, r.file_name) for r in rows] == [(1, "A 1", "8", "a.csv"), (2, "A", "9", "a.csv"), (3, "B", "7", "b.csv"), (4, "C", "6", "c d.csv")]
    assert rows[0].Date == "[01-01-2023, 31-12-2023]" and rows[1].Date == "[01-02-2023, 28-02-2023]"


def test_load_merges_stations(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('Parameter,Value,Location,Latitude,Longitude,Year\npH,7,"POINT SOURSE BUDHA NALLAH, PUNJAB",30.9,76,2024\npH,8,"SOURSE BUDHA NALLAH, PUNJAB 30.973",30.9,76,2024\npH,9,Other Weir,31,77,2024\n')
    assert {r.Location for r in standardize.load_csv(spark, str(p)).collect()} == {"POINT SOURSE BUDHA NALLAH, PUNJAB", "Other Weir"}
    assert {r.Location for r in standardize.load_csv(spark, str(p), merge_stations=False).collect()} == {"POINT SOURSE BUDHA NALLAH, PUNJAB", "SOURSE BUDHA NALLAH, PUNJAB 30.973", "Other Weir"}
    _, report = standardize.merged_stations(standardize.standardize(tables.read_measurements(spark, str(p), "all")))
    assert [(r.name, r.merged) for r in report.collect()] == [("POINT SOURSE BUDHA NALLAH, PUNJAB", ["SOURSE BUDHA NALLAH, PUNJAB 30.973"])]
    assert tables.row_counts(tables.read_measurements(spark, str(p), "all"), 2).first() == (2, 3, 1, True)


def test_weather(spark):
    r = spark.createDataFrame([(1, "A", 30.0, 76.0, dt.date(2024, 1, 1), dt.date(2024, 1, 3)), (2, "A", 31.0, 77.0, dt.date(2024, 1, 5), dt.date(2024, 2, 1)), (3, "B", None, 76.0, dt.date(2024, 1, 1), dt.date(2024, 1, 1)), (4, "C", 1.0, 2.0, dt.date(2030, 1, 1), dt.date(2030, 1, 2)), (5, "D", 5.0, 6.0, dt.date(2024, 1, 1), dt.date(2024, 1, 1))], "row_id int, location string, latitude double, longitude double, date_start date, date_end date")
    spans = remote.weather_spans(r, dt.date(2024, 1, 11))
    assert {tuple(x) for x in spans.collect()} == {("A", 30.0, 76.0, dt.date(2024, 1, 1), dt.date(2024, 1, 10)), ("D", 5.0, 6.0, dt.date(2024, 1, 1), dt.date(2024, 1, 1))}

    def fetch(lat, lon, start, end):
        if lat == 5.0:
            raise OSError("late")
        return [(start + dt.timedelta(days=k), float(k)) for k in range((end - start).days + 5)]

    got = remote.daily_weather(spans, fetch).collect()
    assert len(got) == 10 and {x.place for x in got} == {"A"}


def test_heights(spark):
    p = spark.createDataFrame([(76.0, 30.0), (76.0, 30.0), (77.0, 30.0), (78.0, 95.0), (79.0, 31.0)], "lon double, lat double")
    got = {(r.lon, r.lat): r.m for r in remote.point_heights(p, lambda ps: [None if lon == 77.0 else lat + lon for lon, lat in ps]).collect()}
    assert got == {(76.0, 30.0): 106.0, (79.0, 31.0): 110.0}
    assert remote.point_heights(p, lambda ps: [0.0] * len(ps), budget_s=-1).collect() == []


def test_utm(spark):
    df = spark.createDataFrame([(43.642567, -79.387139, 17, 630084.0, 4833438.6), (-33.856784, 151.215297, 56, 334897.0, 6252296.0), (0.0, 3.0, 31, 500000.0, 0.0)], "lat double, lon double, zone int, x double, y double")
    for r in df.select("*", utm.zone(F.col("lon")).alias("z"), utm.to_utm(F.col("lat"), F.col("lon"), F.col("zone")).alias("m")).collect():
        assert r.z == r.zone and r.m.x == pytest.approx(r.x, abs=20) and r.m.y == pytest.approx(r.y, abs=20)
    back = df.withColumn("m", utm.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))).select("lat", "lon", utm.from_utm(F.col("m.x"), F.col("m.y"), F.col("zone"), F.col("lat") < 0).alias("b"))
    for r in back.collect():
        assert r.b.lat == pytest.approx(r.lat, abs=1e-9) and r.b.lon == pytest.approx(r.lon, abs=1e-9)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 999), ("d", 50)) for v in (rng.normal(size=n) if g != "d" else rng.integers(0, 3, n))] + [("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in stats.quantiles(df, ["g"], "v").collect()}
    for g in "abcd":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], stats.QUARTILES))
    d = {r.parameter: r for r in stats.describe(df, "g", "v").collect()}
    assert set(got) == set("abcd") and d["e"]["count"] == 0 and d["e"].median is None and d["a"].std is None


@pytest.fixture
def uneven_sketches(monkeypatch):
    """The parts of a sketch come in any order on a cluster, so its cuts differ when it is evaluated again."""
    sketch = F.percentile_approx
    shift = F.udf(lambda cuts: [c + random.uniform(-40, 40) for c in cuts], "array<double>").asNondeterministic()
    monkeypatch.setattr(stats.F, "percentile_approx", lambda *a: shift(sketch(*a)))


def test_quantiles_hold_where_a_sketch_differs_each_time(spark, uneven_sketches):
    df = spark.range(4000).select((F.col("id") % 4).alias("g"), F.floor(F.col("id") / 4).cast("double").alias("v"))
    rows = stats.describe(df, "g", "v").collect()
    assert sorted((r.parameter, r["count"], r.min, r.q1, r.median, r.q3, r.max) for r in rows) == [(g, 1000, 0.0, 249.75, 499.5, 749.25, 999.0) for g in range(4)]


def test_measurements_are_described_where_a_sketch_differs_each_time(spark, uneven_sketches, tmp_path):
    n = F.col("id")
    named = F.when(n % 2 == 0, F.lit("pH")).otherwise(F.lit(" Dissolved  Oxygen "))
    spark.range(2000).select(named.alias("parameter"), F.concat(F.lit(" "), F.floor(n / 2).cast("string")).alias("value")).unionByName(spark.createDataFrame([("Weather", "fog"), (None, "1,234")], "parameter string, value string")).write.parquet(f"{tmp_path}/measurements.parquet")
    got = {r.parameter: r[1:] for r in reference_queries.describe_measurements(spark, str(tmp_path)).collect()}
    assert set(got) == {"pH", "Dissolved Oxygen", "Weather", ""} and got["Weather"] == got[""] == (0, *[None] * 7)
    assert got["pH"] == got["Dissolved Oxygen"] and got["pH"][0] == 1000 and got["pH"][3:] == (0.0, 249.75, 499.5, 749.25, 999.0)


def test_station_table(spark):
    rows = [(1, "A", None, 76.0, "x"), (2, "A", 30.0, 76.0, "y"), (3, "A", 31.0, 76.0, "x"), (4, "B", None, None, ""), (5, "", 1.0, 1.0, "z"), (6, "Attawa Choa at bridge", 30.0, 76.0, "Attawa Choe")]
    df = spark.createDataFrame(rows, "row_id int, place string, lat double, lon double, body string")
    aliases = spark.createDataFrame([("attawa", "N-Choe")], "base string, name string")
    got = {r.station: r for r in stats.station_table(df, "place", "lat", "lon", "row_id", "body", aliases).collect()}
    assert (got["A"].latitude, got["A"].water_body) == (30.0, "x") and got["B"].latitude is None and got["B"].water_body == "" and len(got) == 3
    assert (got["Attawa Choa at bridge"].water_body, got["Attawa Choa at bridge"].parsed) == ("N-Choe", "N-Choe")


def test_rain(spark):
    day = dt.date(2024, 1, 1)
    r = spark.createDataFrame([(1, "A", "pH", 7.0, day, dt.date(2024, 12, 31)), (2, "A", "pH", 8.0, day, dt.date(2024, 12, 31)), (3, "B", "pH", 7.0, day, day)], "row_id int, location string, parameter string, numeric_value double, date_start date, date_end date")
    w = spark.createDataFrame([("A", day, 10.0), ("A", dt.date(2024, 2, 1), 20.0)], "place string, day date, value double")
    bars = series.rain_bars(r, w).collect()
    assert [(b.location, b.rain, b.source, b.width_s) for b in bars] == [("A", 30.0, "weather", 365 * 86_400 * 0.8)]
    own = r.unionByName(spark.createDataFrame([(9, "A", "Total Rainfall", 5.0, day, day), (10, "A", "Total Rainfall", 6.0, day, day)], r.schema))
    bars = series.rain_bars(own, w)
    assert [(b.rain, b.source) for b in bars.collect()] == [(5.0, "table")]
    assert {p.row_id: p.rain for p in series.with_rain(r, bars).collect()} == {1: None, 2: None, 3: None}


def test_display_names(spark):
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("f", 3)], "station string, channel long")
    s = spark.createDataFrame([("a", "", "Local Choe"), ("b", "", ""), ("c", "", ""), ("d", "File Drain", "Other Nala"), ("e", "File Drain", ""), ("f", "", "Big River")], "station string, water_body string, parsed string")
    n = spark.createDataFrame([(1, "Test Drain"), (2, "Line Two"), (3, "Big River")], "channel long, name string")
    got = [(r.channel, r.name, r.network_name, r.aliases, r.slug) for r in network.display_names(c, s, n).collect()]
    assert got == [(1, "Local Choe", "Test Drain", [], "local-choe"), (2, "File Drain", "Line Two", ["Other Nala"], "file-drain"), (3, "Big River", "Big River", [], "big-river")]


def test_end_of_a_channel(spark):
    p = spark.createDataFrame([("x", "N-choe before confluence with Ghaggar", "confluence", None), ("y", "N-choe at mill", "confluence", None), ("z", "at confluence", "drawn end", None)], "station string, label string, reason string, to_outlet_m double")
    assert {r.station: r.to_outlet_m for r in network.at_confluence(p).collect()} == {"x": 0.0, "y": None, "z": None}


def test_shown_numbers(spark):
    v = [(1.0, "1"), (1.234, "1.23"), (12.34, "12.3"), (1234.5, "1,235"), (12345.0, "1.23E+4"), (99999.0, "1E+5"), (10000.0, "1E+4"), (0.0, "0"), (-2.5, "-2.5"), (None, "NA")]
    df = spark.createDataFrame(v, "v double, want string")
    assert [r.got for r in df.select(X.compact_number(F.col("v")).alias("got")).collect()] == [w for _, w in v]
    p = lambda x, a, b: spark.range(1).select(X.ramp_position(F.lit(x), F.lit(a), F.lit(b))).first()[0]
    assert p(10.0, 1.0, 1000.0) == pytest.approx(1 / 3) and p(5.0, 0.0, 10.0) == 0.5 and p(-1.0, 0.0, 1.0) == 0 and p(3.0, 3.0, 3.0) == 0
    c = lambda x: spark.range(1).select(X.ramp_color(F.lit(x))).first()[0]
    assert c(0.0) == [29, 78, 216, 88] and c(1.0) == [220, 38, 38, 188] and c(0.09) == [19, 112, 197, 100]


def test_kriging_at_targets(spark):
    st = [(1, i, 30.2 - 0.01 * i, 76.0, 10 + 3.0 * i) for i in range(12)]
    s = spark.createDataFrame(st, "surface int, id int, lat double, lon double, value double")
    rel = [(a[1], b[1], "DOWN" if a[1] > b[1] else "UP", abs(a[1] - b[1]) * 1100.0, 1.0) for a in st for b in st if a != b]
    rel += [(100 + k, b[1], "DOWN", abs(k + 0.5 - b[1]) * 1100.0, 1.0) for k in (0, 5) for b in st] + [(200, 0, "DOWN", 9e6, 1.0)]
    targets = spark.createDataFrame([(100, 30.195, 76.0), (105, 30.145, 76.0), (200, 31.0, 76.0)], "target int, lat double, lon double")
    r = spark.createDataFrame(rel, "target int, station int, relation string, distance double, share double")
    got = {x.target: x for x in interpolate.krige_targets(s, r, targets, "tail_down", 20.0).collect()}
    assert set(got) == {100, 105} and got[105].estimate == pytest.approx(26.5, abs=1.5) and all(0 <= x.confidence <= 1 for x in got.values())


def test_box_reaches_the_scan(spark, tmp_path):
    p = str(tmp_path / "lines.parquet")
    spark.range(10).selectExpr("id", "id * 1.0D AS xmin", "id + 0.5D AS xmax", "id * 1.0D AS ymin", "id + 0.5D AS ymax").write.parquet(p)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = tables.in_box(spark.read.parquet(p), 2.2, 0.0, 4.2, 9.0)
    plan = found.select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert all(f in pushed for f in ("GreaterThanOrEqual(xmax,2.2)", "LessThanOrEqual(xmin,4.2)"))
    assert sorted(r.id for r in found.collect()) == [2, 3, 4]


def test_lines_are_kept(spark, tmp_path):
    from hydroframe.sources.lines import LineCache

    p = tmp_path / "n.csv"
    p.write_text('name,geometry\nNear,"LINESTRING (76 30, 76.1 30)"\nFar,"LINESTRING (80 30, 80.1 30)"\n')
    cache = LineCache(spark)
    one = cache.lines(str(p), 76.01, 29.9, 76.05, 30.1)
    assert [r.name for r in one.collect()] == ["Near"] and cache.lines(str(p), 76.02, 29.91, 76.06, 30.09) is one
    for k in range(4):
        cache.lines(str(p), 77.0 + k, 29.9, 77.1 + k, 30.1)
    assert len(cache._held) == 4 and cache.lines(str(p), 76.01, 29.9, 76.05, 30.1) is not one


def test_figures(spark, tmp_path):
    from hydroframe.session import Registry

    p = tmp_path / "f.csv"
    p.write_text("Parameter,Value,Location,Latitude,Longitude,Date\n" + "".join(f"pH,{v},A,30.7,76.7,0{m}-0{m}-2024\n" for m, v in enumerate((1, 2, 3, 4, 100), 1)) + "DO,9,B,30.7,76.7,01-01-2025\n")
    reg = Registry(spark)
    reg.upload(str(p))
    d = reg.figure("distribution", "PH").first()
    assert (d.bucket, d["count"], d["min"], d.q1, d.median, d.q3, d["max"], d.mean, d.iqr, d.lower_whisker, d.upper_whisker) == (2024, 5, 1, 2, 3, 4, 100, 22, 2, 1, 4)
    assert reg.figure("distribution", "pH") is not reg.figure("distribution", "PH") and reg.figure("distribution", "PH") is reg.figure("distribution", "PH")
    assert [r.parameter for r in reg.figure("trend").collect()] == ["DO"] and reg.figure("trend", "pH", "a", 2024, 2).count() == 1
    assert {(r.location, r.year, r.mean) for r in reg.figure("stream", "pH").collect()} == {("A", 2024, 22.0)}
    with pytest.raises(ValueError):
        reg.figure("pie")
    reg.reset()
