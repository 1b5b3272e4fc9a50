"""Known inputs and results of the analytical operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroframe.functions import names
from hydroframe.functions import text as X
from hydroframe.operators import channels, graph, identity, interpolate, screening, series, standardize, stats
from hydroframe.session import Registry
from hydroframe.sources import tables

CSV = "Parameter,Value,Location,Latitude,Longitude,Date\npH,7,A,30.70,76.70,01-01-2024\npH,8,A,30.70,76.70,01-02-2024\npH,9,B,30.71,76.71,01-01-2025\n"


@pytest.fixture
def csv_file(tmp_path):
    p = tmp_path / "station.csv"
    p.write_text("﻿" + CSV, encoding="utf-8")
    return str(p)


def test_load_and_filter(spark, csv_file):
    t = standardize.load_csv(spark, csv_file, rows=2)
    assert t.count() == 2 and standardize.load_csv(spark, csv_file, rows="all").count() == 3
    r = standardize.records(standardize.load_csv(spark, csv_file, rows="all"))
    found = series.filter_records(r, "PH", "a", 2024, 2).collect()
    assert [x.date for x in found] == ["01-02-2024"] and found[0].sort_key == 202402 and found[0].has_coordinates


@pytest.mark.parametrize("rows", [0, -1, True, 1.5, "some"])
def test_bad_row_limits(rows):
    with pytest.raises(ValueError):
        tables.check_rows(rows)


def test_concat(spark):
    cols = ["row_id", "Parameter", "Value", "Location", "Latitude", "Longitude", "Year", "Unit"]
    a = standardize.standardize(spark.createDataFrame([(1, "t.coliform", "10", "Station", "30.7", "76.7", "2024", None), (2, "Total Coliform", "20", "Station", "30.7", "76.7", "2024", "MPN/100mL")], cols))
    both = standardize.concat(a, a).orderBy("SrNo").collect()
    assert [(r.SrNo, r.Value, r.Parameter) for r in both] == [(1, "10", "Total Coliform"), (2, "20", "Total Coliform"), (3, "10", "Total Coliform"), (4, "20", "Total Coliform")]
    assert a.count() == 2 and both[0].Date == "[01-01-2024, 31-12-2024]"
    assert {r.Location for r in standardize.concat(a, station=" Other  place ").collect()} == {"Other place"}
    for bad in ([], [a.where("false")]):
        with pytest.raises(ValueError):
            standardize.concat(*bad)


def test_distribution(spark):
    d = stats.distribution(spark.createDataFrame([("A", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double"), ["k"], "v").first()
    assert (d["count"], d["min"], d.q1, d["median"], d.q3, d["max"], d.iqr, d["mean"], d.lower_whisker, d.upper_whisker) == (5, 1, 2, 3, 4, 100, 2, 22, 1, 4)
    assert stats.distribution(spark.createDataFrame([], "k string, v double"), ["k"], "v").collect() == []


def test_wide_reports(spark):
    cols = ["Name of Sampling Point", "Latitude", "Longitude", "Date and Timestamp", "Source", "BOD (mg/l)", "Total Coliform (MPN/100ml)"]
    w = spark.createDataFrame([(None, None, None, None, "river-2024.pdf", "100", None), ("Station A", "30.7", "76.7", None, "river-2024.pdf", "3.0-0.32", "200"), ("Station B", "30.8", "76.8", None, "river-2024.pdf", "0", "300")], ", ".join(f"`{c}` string" for c in cols))
    long = tables.wide_to_long(w)
    got = [(r.Parameter, r.Value, r.Unit) for r in long.collect()]
    assert got == [("BOD (Min)", "0.32", "mg/l"), ("BOD (Max)", "3", "mg/l"), ("Total Coliform", "200", "MPN/100ml"), ("BOD", "0", "mg/l"), ("Total Coliform", "300", "MPN/100ml")]
    s = standardize.standardize(tables.with_row_id(long))
    assert all("2024" in r.Date for r in s.collect())


def test_rain_of_periods(spark):
    p = spark.createDataFrame([(1, "A", dt.date(2024, 1, 1), dt.date(2024, 12, 31)), (2, "A", dt.date(2023, 1, 1), dt.date(2023, 1, 1))], "id int, place string, start date, end date")
    w = spark.createDataFrame([("A", dt.date(2024, 1, 1), 10.0), ("A", dt.date(2024, 2, 1), 20.0)], "place string, day date, value double")
    assert {r.id: r.total for r in series.period_sums(p, w).collect()} == {1: 30.0, 2: None}


def test_elevations(spark):
    s = spark.createDataFrame(list(zip("AABCDE", [30.0, 30.0, 30.0, 31.0, 32.0, 100.0], [76.0, 76.0, 77.0, 77.5, 78.0, 79.0])), "Location string, Latitude double, Longitude double")
    t = spark.createDataFrame([(76.0, 30.0, 0.0), (77.0, 30.0, -12.0), (78.0, 32.0, 5.0)], "lon double, lat double, m double")
    got = {r.Location: (r.Elevation, r.status) for r in tables.elevations(s, t).collect()}
    assert got == {"A": (0.0, "ok"), "B": (-12.0, "ok"), "C": (None, "no_data"), "D": (5.0, "ok"), "E": (None, "invalid_coordinates")}


def test_station_intervals(spark):
    r = [("A", "max", 2023, 9.0), ("A", "min", 2023, 1.0), ("A", "", 2023, 6.0), *[("A", "", 2024, 8.0)] * 3, ("B", "max", 2024, 20.0), ("B", "min", 2024, 10.0), ("C", "max", 2024, 40.0)]
    df = spark.createDataFrame([(i, "BOD", v, "mg/l", s, y, x) for i, (s, v, y, x) in enumerate(r)], "row_id int, family string, variant string, unit string, station string, year int, value double")
    got = {x.station: (x.lower, x.upper, x.kind, x.year_count) for x in stats.station_values(df).where("period = 'all_years'").collect()}
    assert got == {"A": (7.0, 7.0, "reading", 2), "B": (10.0, 20.0, "range", 1), "C": (None, 40.0, "max only", 1)}


@pytest.mark.parametrize(("label", "want"), [("HUDIARA DRAIN AT VILL. DHAHUKE (WHERE IT ENTERS PAKISTAN), PUNJAB", "Hudiara Drain"), ("BRIDGE ON TUNG DHAB DRAIN, FATENGARH CHURIAN ROAD", "Tung Dhab Drain"), ("RIVER BEAS U/S BEFORE CONF. OF MANALSU NALLAH", "Beas"), ("NCP06 - N-choe before confluence with Ghaggar", "N-Choe"), ("3BRD", ""), (None, "")])
def test_water_bodies(spark, label, want):
    assert spark.range(1).select(names.parse_water_body(F.lit(label))).first()[0] == want


def test_likeness(spark):
    like = lambda a, b: spark.range(1).select(names.name_similarity(F.lit(a), F.lit(b))).first()[0]
    assert min(like(*p) for p in (("Budha Nallah", "Budda Nala"), ("Sutlej", "Satluj"), ("Lassara Drain", "Lissara Nala"))) >= 0.8
    assert like("Attawa Choa", "Tangori Choe") < 0.8 and like("", "x") == 0 and like("Hudiara Drain", "Hudiara Nala") == 1 and like("Ghaggar River", "Upper Ghaggar Nadi") == 0.9 and like(None, "x") == 0


def test_near_names_meet(spark):
    """Blocking by letter pairs loses no pair of names that are 0.85 alike or more."""
    rng = np.random.default_rng(8)
    bases = sorted({"".join(rng.choice(list("abdeghi"), rng.integers(1, 9))) for _ in range(120)} | {"budha", "budda", "upper budha", "sirhind", "sirhand"})
    df = spark.createDataFrame([(b,) for b in bases], "base string")
    got = {(r.a, r.b): round(r.likeness, 6) for r in names.near_bases(df, df, 0.85).collect()}
    both = df.select(F.col("base").alias("a")).crossJoin(df.select(F.col("base").alias("b")))
    want = {(r.a, r.b): round(r.x, 6) for r in both.select("a", "b", names.base_similarity(F.col("a"), F.col("b")).alias("x")).where("x >= 0.85").collect()}
    assert got == want and len(want) > len(bases)


def test_canonical_names(spark):
    aliases = tables.alias_table(spark.createDataFrame([("Attawa Choe", "N-Choe"), ("Nchoe", "N-Choe")], "alias string, name string"))
    df = spark.createDataFrame([(1, "Attawa Choa"), (2, "Hudiara Drain"), (3, None), (4, "N-choe")], "i int, name string")
    assert {r.i: r.name for r in names.canonical_names(df, "name", aliases).collect()} == {1: "N-Choe", 2: "Hudiara Drain", 3: None, 4: "N-Choe"}


def test_label_merge(spark):
    def merged(*labels):
        rows = [(i, name, lat, 76.0) for i, (name, lat) in enumerate(labels)]
        label = identity.labels(spark.createDataFrame(rows, "row_id int, location string, latitude double, longitude double"))
        return {(r.location, r.merged_into) for r in identity.merge_groups(label, identity.candidate_pairs(label)).collect()}

    assert merged(("POINT SOURSE BUDHA NALLAH, PUNJAB", 30.9), ("SOURSE BUDHA NALLAH, PUNJAB 30.973", 30.9)) == {("SOURSE BUDHA NALLAH, PUNJAB 30.973", "POINT SOURSE BUDHA NALLAH, PUNJAB")}
    assert merged(("OUTLET OF NADIALA DRAIN INTO DHAKANSU NALLAH, PUNJAB", 30.9), ("OF NADIALA INTO DHAKANSU PUNJAB", 30.9)) == {("OF NADIALA INTO DHAKANSU PUNJAB", "OUTLET OF NADIALA DRAIN INTO DHAKANSU NALLAH, PUNJAB")}
    assert merged(("RIVER BEAS U/S MANALI", 30.9), ("RIVER BEAS D/S MANALI", 30.9)) == set()
    assert merged(("MUHANA NORTH", 30.9), ("MUHANA SOUTH", 30.9), ("DRAIN", 30.9)) == set()
    assert merged(("BUDHA NALLAH AT BRIDGE", 30.9), ("BUDHA NALLAH BRIDGE", 30.95)) == set()


def test_screening(spark):
    r = [("s", "1", "f", 1, "pH(max)", 9.5), ("s", "1", "f", 2, "pH", 7.0), ("s", "1", "f", 3, "NO3-N", 60.0), ("s", "2", "f", 4, "pH", 9.1), ("s", "2", "f", 5, "DO(min)", 6.0), ("s", "3", "f", 6, "Colour", 1.0), ("s", "4", "f", 7, "T-Coliform", 50.0), ("s", "5", "f", 8, "Total Coliform", 50.0), ("s", "5", "f", 9, "Faecal Coliform", 0.0)]
    got = {(x["sample"], x.use_case): x for x in screening.screen(spark.createDataFrame(r, "station string, sample string, file_name string, row_id int, parameter string, numeric_value double")).collect()}
    a = got["1", "human_consumption"]
    assert a.status == "safe" and a.label == "Pass" and a.confirmed == ["pH via pH"] and a.proxy == ["Nitrate via NO3-N"] and not a.core_reasons and "TDS" in a.missing and "Nitrate" not in a.missing
    assert got["2", "bathing"].status == "unsafe" and got["2", "bathing"].core_reasons == ["pH 9.1 outside 6.5-8.5"]
    assert got["3", "bathing"].status == "unknown" and len(got) == 20
    assert got["4", "bathing"].core_reasons == ["Total coliform 50 MPN/100mL should be 0"] and got["5", "bathing"].status == "safe"


def test_rules(spark):
    def judged(use, strict=True, **values):
        row = spark.range(1).select(screening.judge(use, {k: F.lit(float(v)) for k, v in values.items()}, strict).alias("j")).first().j
        return row.status, row.core_reasons + row.extended_reasons

    assert judged("agriculture", pH=9, boron=1, chloride=200) == ("unsafe", ["pH 9 outside 6.0-8.5", "Chloride 200 mg/L may be restrictive for chloride-sensitive crops"])
    assert judged("agriculture", pH=7, chloride=200)[0] == "caution" and judged("agriculture", pH=7.2) == ("safe", []) and judged("agriculture", chloride=10)[0] == "unknown"
    assert judged("agriculture", pH=7, rsc=3, bicarbonate=700)[1] == ["RSC 3 meq/L exceeds 2.5 meq/L"] and len(judged("agriculture", pH=7, rsc=2, bicarbonate=700, carbonate=130)[1]) == 2
    assert judged("human_consumption", turbidity=3)[1] == ["Turbidity 3 NTU exceeds 1 NTU"] and judged("human_consumption", False, turbidity=3)[0] == "safe"
    assert judged("human_consumption", e_coli=1) == ("unsafe", ["E. coli detected"]) and judged("bathing", e_coli=1) == ("caution", ["E. coli detected"])


def test_stations_of_a_period(spark):
    r = [("s", "f", 202301, 2023, 1, 1, "pH", 9.5), ("s", "f", 202405, 2024, 5, 2, "pH", 7.0), ("t", "f", 202405, 2024, 5, 3, "pH", 7.0)]
    df = spark.createDataFrame(r, "station string, file_name string, sort_key int, year int, month_index int, row_id int, parameter string, numeric_value double")
    state = lambda **k: {x.station: (x.status, x.reasons) for x in screening.screen_stations(df, "bathing", **k).collect()}
    assert state() == {"s": ("safe", []), "t": ("safe", [])}
    assert state(year=2023) == {"s": ("unsafe", ["pH 9.5 outside 6.5-8.5"]), "t": ("unknown", [screening.NO_SAMPLE])}
    assert state(month=2)["s"] == ("unknown", [screening.NO_SAMPLE])


def test_scales(spark):
    v = spark.createDataFrame([("DO", 3.0), ("DO (min)", 6.0), ("DO", None), ("Boron(B)", 1.0), ("T-Coliform", 5.0), ("Colour", 1.0)], "parameter string, value double")
    got = [(r.scale, r.status) for r in screening.on_scales(v, "aquatic_life").collect()]
    assert sorted(got, key=str) == sorted([("do", "unsafe"), ("do", "safe"), ("do", "unknown"), ("boron", None), ("total_coliform", "unsafe"), ("colour", None)], key=str)
    r = screening.on_scales(v.where("parameter = 'Boron(B)'"), "agriculture").first()
    assert (r.status, r.low, r.high, r.axis.low, r.axis.high) == ("safe", None, 2.0, 0.0, 4.0)


def test_straight_lines(spark):
    s = spark.createDataFrame([(1, 1, -3.0, -60.0, 6.0), (1, 2, -3.1, -60.1, 9.0), (2, 3, -10.0, -70.0, 2.0)], "surface int, id int, lat double, lon double, value double")
    loo = {r.id: r.estimate for r in interpolate.leave_one_out(s, 30.0).collect()}
    assert loo == {1: 9.0, 2: 6.0, 3: None}
    assert {r.surface: r.min_lat > -4 for r in interpolate.extent(s).collect()}[1]
    cells = interpolate.grid(s, 5).where("surface = 2").collect()
    assert len(cells) == 25 and {c.estimate for c in cells} == {2.0}
    for bad in (0, -1, float("nan"), True):
        with pytest.raises(ValueError):
            interpolate.check_positive(bad, "limit")


def test_grid_of_any_number_of_stations(spark, monkeypatch):
    """Stations are worked through in blocks, none are refused; equal positions, cells at stations, missing values."""
    rng = np.random.default_rng(3)
    pts = [(("a", "b")[i % 2], i, float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(rng.uniform(59, 61, 90), rng.uniform(9, 12, 90), rng.normal(size=90)))]
    pts += [("a", 100 + i, *pts[2 * i][2:4], float(i)) for i in range(9)] + [("c", 200, 10.0, 20.0, 7.0), ("c", 199, 10.0, 20.0, 8.0), ("c", 198, 10.0, 20.0, None), ("d", 1, 0.0, 0.0, None), (None, 1, 0.0, 0.0, 1.0)]
    s = spark.createDataFrame(pts, "surface string, id int, lat double, lon double, value double")
    monkeypatch.setattr(interpolate, "MAX_STATIONS", 20)
    monkeypatch.setattr(interpolate, "PLACES", 16, raising=False)
    got = {(r.surface, r.row, r.col): (r.estimate, r.nearest_m) for r in interpolate.grid(s, 11, power=1.5).collect()}
    box = {r.surface: r for r in interpolate.extent(s.where("surface is not null")).collect()}
    assert len(got) == 4 * 121
    for (surface, row, col), (estimate, nearest) in got.items():
        b = box[surface]
        la, lo = math.radians(b.max_lat - row * (b.max_lat - b.min_lat) / 10), math.radians(b.min_lon + col * (b.max_lon - b.min_lon) / 10)
        near = []
        for _, i, lat, lon, v in (p for p in pts if p[0] == surface):
            h = math.sin((math.radians(lat) - la) / 2) ** 2 + math.cos(la) * math.cos(math.radians(lat)) * math.sin((math.radians(lon) - lo) / 2) ** 2
            near.append((2 * X.EARTH_M * math.asin(math.sqrt(h)), i, v))
        assert nearest == pytest.approx(min(near)[0], abs=0.06)
        valued = [x for x in near if x[2] is not None]
        if not valued:
            assert estimate is None
        elif min(near)[0] < 1:
            assert estimate == min(valued)[2]
        else:
            weight = lambda d: (max(d, 1) / 1000) ** -1.5
            assert estimate == pytest.approx(sum(weight(d) * v for d, _, v in valued) / sum(weight(d) for d, *_ in near), abs=6e-5)
    assert got["c", 5, 5] == (8.0, 0.0)


def test_near_pairs_are_all_pairs_within(spark):
    rng = np.random.default_rng(1)
    pts = [(1, i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(rng.uniform(59, 61, 150), rng.uniform(9, 12, 150)))]
    s = spark.createDataFrame(pts, "surface int, id int, lat double, lon double, value double")
    near = {(r.id, r.s_id) for r in interpolate.near_pairs(s, s, 20.0, ["surface"]).collect()}
    every = {(r.id, r.s_id) for r in interpolate.all_pairs(s, s, ["surface"]).where("d <= 20000").collect()}
    assert near == every and len(near) > 300


def test_reach_and_kriging(spark):
    pts = [(1, i, 30.195 - 0.015 * i, 76.0, 10.0 + 3 * i) for i in range(12)]
    s = spark.createDataFrame(pts, "surface int, id int, lat double, lon double, value double")
    c = interpolate.choose_reach(s).collect()
    best = next(r for r in c if r.chosen)
    assert len(c) == 6 and best.score == min(r.score for r in c) and best.beats_baseline
    assert interpolate.kriging(s).first().note == "at least 50 stations are needed"
    model = interpolate.kriging(s, 10).first()
    assert model.rmse < np.std([p[4] for p in pts]) and model.note is None


def test_kriging_leave_one_out_is_exact():
    rng = np.random.default_rng(2)
    lat, lon, v = rng.uniform(30, 31, 20), rng.uniform(76, 77, 20), rng.normal(size=20)
    m = interpolate.fit_kriging(lat, lon, v)
    d = np.array([[2 * X.EARTH_M * math.asin(math.sqrt(math.sin(math.radians(a - c) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(b - e) / 2) ** 2)) for c, e in zip(lat, lon)] for a, b in zip(lat, lon)])
    var, nugget = v.var(ddof=1), m["nugget"]
    cov = np.exp(-3 * d / (m["range_km"] * 1000)) * var * (1 - nugget) + np.eye(20) * var * nugget
    rest = np.arange(1, 20)
    estimate, _ = interpolate.krige(cov[np.ix_(rest, rest)], v[rest], cov[[0]][:, rest], var * (1 - nugget), var * nugget)
    assert math.isclose(estimate[0], m["loo"][0], rel_tol=1e-6)


def test_flow(spark):
    # Main 1 -> 2 -> 3 -> 4, drain 5 -> 3: shares by area 90 and 10, here as unit flows.
    e = spark.createDataFrame([(1, 1, 2, 100.0, None), (2, 2, 3, 100.0, None), (3, 5, 3, 50.0, None), (4, 3, 4, 100.0, None)], "edge int, up int, down int, length double, weight double")
    f = graph.flow_shares(e)
    assert {r.edge: r.share for r in f.collect()} == {1: 1.0, 2: 0.5, 3: 0.5, 4: 1.0}
    r = {(x.target, x.station): (x.relation, x.distance, x.share) for x in graph.relations(f, e.select(F.col("up").alias("node")), 250.0).collect()}
    assert r[3, 5] == ("DOWN", 50.0, 0.5) and r[3, 1] == ("DOWN", 200.0, 0.5) and r[1, 3] == ("UP", 200.0, 0.5) and (5, 2) not in r
    braid = spark.createDataFrame([(1, 1, 2, 10.0, 3.0), (2, 1, 3, 30.0, 1.0), (3, 2, 4, 10.0, None), (4, 3, 4, 10.0, None), (5, 4, 5, 1.0, None)], "edge int, up int, down int, length double, weight double")
    g = graph.flow_shares(braid)
    assert {x.edge: round(x.share, 4) for x in g.collect()} == {1: 1.0, 2: 1.0, 3: 0.75, 4: 0.25, 5: 1.0}
    d = {x.node: (x.distance, x.share) for x in graph.downstream(g, spark.createDataFrame([(1,)], "node int"), 100.0).collect()}
    assert d[4] == (20.0, 1.0) and d[5] == (21.0, 1.0)
    chain = spark.createDataFrame([(i, i, i + 1, 10.0, 1.0) for i in range(90)], "edge int, up int, down int, length double, share double")
    start = spark.createDataFrame([(0,)], "node int")
    assert graph.downstream(chain, start, 1e6).count() == 91 and graph.outlet_distance(chain, spark.createDataFrame([(90,)], "node int")).count() == 91
    with pytest.raises(Exception, match="cycle"):
        graph.flow_shares(spark.createDataFrame([(1, 1, 2, 1.0, None), (2, 2, 1, 1.0, None)], "edge int, up int, down int, length double, weight double")).collect()


def test_large_graphs_give_the_same(spark, monkeypatch):
    """Level by level, as for graphs that tasks can't hold."""
    rng = np.random.default_rng(4)
    rows = [(i, i, int(rng.integers(i + 1, min(i + 4, 41))), float(rng.integers(1, 9)), None) for i in range(40)] + [(100 + i, i, i + 1, 3.0, 2.0) for i in range(0, 39, 3)]
    e = spark.createDataFrame(rows, "edge int, up int, down int, length double, weight double")
    starts = spark.createDataFrame([(0, 0, 0.0, 1.0), (7, 7, 2.0, 0.5), (7, 9, 0.0, 0.25)], "station int, node int, distance double, share double")

    def all_results():
        f = graph.flow_shares(e)
        tables_ = (f.select("edge", "flow", "share"), graph.reach(f, starts, 25.0, "down"), graph.reach(f, starts, 25.0, "up"), graph.outlet_distance(e, e.where("edge = 39").select(F.col("down").alias("node"))))
        return [sorted(tuple(round(x, 9) for x in r) for r in t.collect()) for t in tables_]

    want = all_results()
    monkeypatch.setattr(graph, "MAX_HELD", 3)
    assert all_results() == want


def test_channels(spark):
    line = lambda i, name, *p: (i, name, [{"x": x, "y": y} for x, y in p])
    lines = spark.createDataFrame([line(1, "Test Drain", (76.0, 30.0), (76.1, 30.0)), line(2, "Test Drain", (76.1, 30.0), (76.2, 30.0)), line(3, "Big River", (76.2, 29.8), (76.2, 30.2))], "line_id long, name string, pts array<struct<x:double,y:double>>")
    s = spark.createDataFrame([("Down", "", 30.0005, 76.19), ("Up", "", 30.001, 76.02), ("Far away", "", 31.0, 77.0), ("Named", "Test Nala", 30.05, 76.05), ("Other", "Big River", 30.1, 76.21)], "station string, name string, lat double, lon double")
    m = {r.station: (r.line_id, r.method) for r in channels.match_stations(s, lines).collect()}
    assert m == {"Down": (2, "nearest"), "Up": (1, "nearest"), "Far away": (None, "none"), "Named": (1, "name, far"), "Other": (3, "name")}
    assert {r.line_id: r.channel for r in channels.channels(lines).collect()} == {1: 1, 2: 1, 3: 3}
    placed = spark.createDataFrame([("c", "a", "D/S X", 900.0), ("c", "b", "U/S X", 800.0), ("c", "d", "far", 9000.0), ("c", "e", "unknown", None)], "channel string, station string, label string, to_outlet_m double")
    assert [r.station for r in channels.order_stations(placed).orderBy("position").collect()] == ["d", "b", "a", "e"]
    cut = channels.clip_and_simplify(lines, 76.05, 29.9, 76.15, 30.1).orderBy("line_id").collect()
    assert [(r.line_id, [round(p.x, 3) for p in r.pts]) for r in cut] == [(1, [76.05, 76.1]), (2, [76.1, 76.15])]


def test_orientation(spark):
    e = spark.createDataFrame([(1, 1, 2, 10.0, False), (2, 3, 2, 10.0, False), (3, 3, 4, 5.0, True)], "edge int, up int, down int, length double, canal boolean")
    got = {r.edge: (r.up, r.down) for r in graph.orient(e, spark.createDataFrame([(1,)], "node int")).collect()}
    assert got == {1: (2, 1), 2: (3, 2), 3: (3, 4)}


def test_conflicts_against_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{i % 7}", round(float(a), 6), round(float(b), 6)) for i, (a, b) in enumerate(zip(rng.uniform(30, 30.01, 200), rng.uniform(76, 76.01, 200)))]
    df = spark.createDataFrame([*rows, (999, "s1", None, None), (1000, "only", 1.0, 1.0)], "row_id int, station string, lat double, lon double")
    got = {r.station: r.spread_m for r in stats.position_conflicts(df, "station", "lat", "lon", "row_id").collect()}
    a, b = df.alias("a"), df.alias("b")
    d = X.haversine_m(*(F.col(c) for c in ("a.lat", "a.lon", "b.lat", "b.lon")))
    want = {r.station: r.m for r in a.join(b, F.col("a.station") == F.col("b.station")).groupBy(F.col("a.station").alias("station")).agg(F.round(F.max(d), 1).alias("m")).where("m >= 500").collect()}
    assert got == want


def test_files_and_registry(spark, tmp_path, csv_file):
    (tmp_path / "t.tsv").write_text(CSV.replace(",", "\t"))
    (tmp_path / "j.json").write_text('[{"Parameter": "pH", "Value": 0, "Location": "A", "Latitude": "30.7", "Longitude": "76.7", "Year": "2024"}]')
    assert tables.read_upload(spark, str(tmp_path / "t.tsv")).count() == 3 and tables.sniff_separator("a;b;c\n1;2;3\n") == ";"
    reg = Registry(spark)
    one, two = reg.upload(csv_file), reg.upload(str(tmp_path / "t.tsv"))
    both = reg.combine([one, two], station="Z")
    assert reg.tables[both][1].count() == 6 and reg.active == both and reg.select(one).count() == 3 and len(reg.list()) == 3
    with pytest.raises(ValueError):
        reg.combine([one])
    with pytest.raises(ValueError):
        tables.from_dataframe(spark.createDataFrame([(1, 2)], "a int, A int"))
    (tmp_path / "bin.csv").write_bytes(b"a,b\n1,\0\n")
    with pytest.raises(ValueError):
        tables.read_upload(spark, str(tmp_path / "bin.csv"))
    tables.write_measurements(reg.select(one), str(tmp_path / "out"))
    assert tables.read_delimited(spark, str(tmp_path / "out")).columns[:5] == ["SrNo", "Parameter", "Unit", "Date", "Value"]
    assert tables.to_csv_text(spark.range(2)) == "id\n0\n1\n"
    r = spark.sql("SELECT clean_text(' a\u2013b\u00a0 c') AS t, haversine_m(30, 76, 30.1, 76) AS m").first()
    assert r.t == "a-b c" and abs(r.m - 11119.5) < 1
    reg.reset()
    assert reg.list() == []


def test_stream_latest(spark, tmp_path):
    from hydroframe.streaming.measurements import latest_per_station

    schema = "station string, at timestamp, value double"
    for i, rows in enumerate([[("a", dt.datetime(2024, 1, 2), 1.0), ("b", dt.datetime(2024, 1, 1), 2.0)], [("a", dt.datetime(2024, 1, 1), 3.0), ("b", dt.datetime(2024, 1, 5), 4.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = latest_per_station(stream, "station", "at", "value").writeStream.format("memory").queryName("latest_test").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("latest_test").collect():
        last[r.station] = max(last.get(r.station, (0, 0)), (r.at_ns, r.value))
    assert {k: v[1] for k, v in last.items()} == {"a": 1.0, "b": 4.0}
