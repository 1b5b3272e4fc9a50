"""Channel networks, river kriging, ribbons and presentation tables."""

import datetime as dt

import numpy as np
import pytest

from hydroframe.operators import interpolate, network, series


@pytest.fixture(scope="module")
def lines(spark):
    line = lambda i, name, *p: (i, name, [{"x": x, "y": y} for x, y in p])
    return spark.createDataFrame([line(1, "Test Drain", (76.0, 30.0), (76.1, 30.0)), line(2, "Test Drain", (76.1, 30.0), (76.2, 30.0)), line(3, "Big River", (76.2, 29.8), (76.2, 30.2))], "line_id long, name string, pts array<struct<x:double,y:double>>")


def test_channel_network(spark, lines):
    s = spark.createDataFrame([("Down", "", 30.0005, 76.19), ("Up", "", 30.001, 76.02), ("Middle", "Test Nala", 30.001, 76.11), ("Far away", "", 31.0, 77.0), ("Voted", "Test Drain", 30.9, 76.05), ("Late", "", 30.03, 76.05)], "station string, name string, lat double, lon double")
    got = {r.station: r for r in network.channel_network(s.selectExpr("station", "station AS label", "name", "lat", "lon"), lines).collect()}
    assert [x for x, _ in sorted(((k, r.position) for k, r in got.items() if r.to_outlet_m is not None), key=lambda x: x[1])] == ["Up", "Late", "Middle", "Down"]
    assert got["Down"].reason == "confluence" and got["Down"].joins == 3 and got["Down"].to_outlet_m == pytest.approx(964, abs=2)
    assert got["Far away"].method == "unassigned" and got["Voted"].method == "name only" and got["Voted"].channel == 1 and got["Late"].method == "near others"


def test_lowest_end(spark, lines):
    ends = network.line_ends(lines).where("line_id <> 3").orderBy("x").collect()
    h = spark.createDataFrame([(ends[0].node, 400.0), (ends[-1].node, 500.0)], "node long, m double")
    from hydroframe.operators import channels

    out = {r.channel: r for r in network.outlets(lines, channels.channels(lines), h).collect()}
    assert out[1].reason == "lowest end" and out[1].node == ends[0].node


def test_references_and_loose_names(spark):
    s = spark.createDataFrame([("a", 1, "BIG RIVER D/S OF TEST DRAIN"), ("b", 2, "TEST DRAIN D/S TEST DRAIN"), ("c", 1, "nothing")], "station string, own_channel long, label string")
    n = spark.createDataFrame([(2, "Test Drain"), (1, "Big River")], "channel long, name string")
    assert [tuple(r) for r in network.downstream_references(s, n).collect()] == [("a", 2)]
    names = spark.createDataFrame([(1, "Hudiara Drain"), (2, "Hudiara Nala"), (3, "Other Khad"), (4, "")], "row_id int, name string")
    assert {tuple(r) for r in network.loose_names(names).collect()} == {("Hudiara Drain", "Hudiara Drain"), ("Hudiara Nala", "Hudiara Drain"), ("Other Khad", "Other Khad")}


def test_river_methods(spark):
    rng = np.random.default_rng(3)
    st = [(1, i, 30.2 - 0.01 * i, 76.0, 10 + 3.0 * i + float(rng.normal())) for i in range(14)]
    s = spark.createDataFrame(st, "surface int, id int, lat double, lon double, value double")
    rel = spark.createDataFrame([(a[1], b[1], "DOWN" if a[1] > b[1] else "UP", abs(a[1] - b[1]) * 1100.0, 1.0) for a in st for b in st if a != b], "target int, station int, relation string, distance double, share double")
    got = interpolate.choose_method(rel, s, 20.0, least=10).collect()
    assert {r.method for r in got} == {"river_idw", "tail_up", "tail_down", "mixed"} and sum(r.chosen for r in got) == 1
    assert next(r for r in got if r.chosen).rmse == min(r.rmse for r in got)
    few = interpolate.choose_method(rel, s, 20.0).collect()
    assert [r.method for r in few] == ["river_idw"] and few[0].note == "at least 50 stations are needed"


def test_paint_and_surfaces(spark):
    p = spark.createDataFrame([(1, 30.1, 76.05, 5.0, True), (1, 30.12, 76.06, 7.0, False)], "surface int, lat double, lon double, estimate double, station boolean")
    box = spark.createDataFrame([(1, 30.0, 30.2, 76.0, 76.2)], "surface int, min_lat double, max_lat double, min_lon double, max_lon double")
    cells = {(r.row, r.col): r.estimate for r in interpolate.paint(p, box, 40).collect()}
    assert set(cells.values()) == {5.0, 7.0} and len(cells) >= 4
    v = spark.createDataFrame([("all_years", "BOD", i, 30.0 + i * 0.01, 76.0, None if i == 2 else float(i), float(i + 1)) for i in range(3)], "period string, family string, id int, lat double, lon double, lower double, upper double")
    got = interpolate.surfaces(v, 20.0).collect()
    assert sum(r.bound == "lower" for r in got) == 2 and sum(r.bound == "upper" for r in got) == 3 and all(0 < r.confidence <= 1 for r in got)


def test_presentation(spark):
    g = spark.createDataFrame([(1, "a", 3), (2, "b", 4), (3, "c", 2), (4, "d", 20), (5, "e", 1)], "ord int, grp string, n int")
    assert {r.grp: r.page for r in series.pages(g).collect()} == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 4}
    r = spark.createDataFrame([(1, "s", "BOD", "", 2023, dt.date(2023, 1, 1), 1.0), (2, "s", "BOD", "min", 2024, dt.date(2024, 1, 1), 2.0), (3, "s", "BOD", "max", 2024, dt.date(2024, 1, 1), 5.0)], "row_id int, location string, family string, variant string, year int, date_start date, numeric_value double")
    last = series.latest_values(r).first()
    assert (last.value, last.low, last.high) == (None, 2.0, 5.0)
    a = series.availability(r).first()
    assert a.families == ["BOD"] and a.years == [2023, 2024]
