"""A made-up river with a side stream, a feeder and a ring channel; shares and relations are worked out by hand."""

import pytest

from hydroframe.operators import river, surfaces

S = "line_id long, name string, kind string, upstream_area double, discharge double, pts array<struct<x:double,y:double>>"
DEGREE = 111_320.0


def line(i, name, kind, area, *points):
    return (i, name, kind, area, None, [{"x": x, "y": y} for x, y in points])


# The river runs north along 10 E; the stream joins it at 50.30 N with a third of its area.
RIVER = line(10, "Velm", "river", 60.0, (10.0, 50.0), (10.0, 50.6))
STREAM = line(11, "Orsk Stream", "stream", 20.0, (10.3, 50.3), (10.0003, 50.3))
FEEDER = line(12, "Tolm Feeder", "canal", None, (10.0002, 50.2), (9.8, 50.2))
RING = line(13, "Ring Minor", "canal", None, (10.0002, 50.5), (10.05, 50.4), (10.0002, 50.1))
POINTS = [("high", 50.05, 10.0, 4.0), ("mid", 50.25, 10.0, 8.0), ("low", 50.4, 10.0, 20.0), ("brook", 50.3, 10.1, 40.0), ("ditch", 50.2, 9.9, 6.0)]


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([(n, "", lat, lon, v) for n, lat, lon, v in POINTS], "station string, name string, lat double, lon double, value double")


def solve(spark, stations, lines, mode):
    edges, at = river.build(spark.createDataFrame(lines, S), stations.drop("value"), junctions=mode)
    targets = at.withColumnRenamed("station", "target")
    r = river.relate(targets, river.flow_segments(edges, at, 50.0, river.is_tree(edges)), 50.0).cache()
    loo = {x.target: x.estimate for x in river.along_river(targets, r.where("target <> station"), stations.select("station", "value")).collect()}
    return edges, {(x.target, x.station): x for x in r.collect()}, loo


def test_feeder(spark, stations):
    """Where the feeder leaves, the river gives it water; below the stream's mouth each branch brings half."""
    edges, r, loo = solve(spark, stations, [RIVER, STREAM, FEEDER], "equal")
    assert not river.is_tree(edges)
    ditch = r["ditch", "high"]
    assert ditch.relation == "DOWN" and ditch.share == 1.0 and ditch.distance == pytest.approx(0.15 * DEGREE + 0.1 * DEGREE * 0.6401, abs=300)
    assert ("ditch", "mid") not in r and ("mid", "ditch") not in r and ("brook", "mid") not in r
    assert r["low", "brook"].share == r["low", "high"].share == r["low", "mid"].share == 0.5
    assert r["mid", "low"].relation == "UP" and r["mid", "low"].share == 0.5
    assert loo["ditch"] == pytest.approx(4) and loo["brook"] == pytest.approx(20)


def test_areas(spark, stations):
    _, r, _ = solve(spark, stations, [RIVER, STREAM], "auto")
    assert r["low", "brook"].share == pytest.approx(20 / 80) and r["low", "mid"].share == pytest.approx(60 / 80)
    side = r["brook", "mid"]
    assert side.relation == "UNCONNECTED" and side.share == 0


def test_flow_order(spark, stations):
    _, r, _ = solve(spark, stations, [RIVER, STREAM], "order")
    assert r["low", "brook"].share == pytest.approx(0.5)


def test_ring_is_cut(spark, stations):
    edges, _, _ = solve(spark, stations, [RIVER, STREAM, RING], "equal")
    assert river.is_tree(edges) and edges.where("canal").isEmpty()
    with pytest.raises(ValueError):
        river.build(spark.createDataFrame([RIVER], S), stations, junctions="some")


def test_labels_below_junctions(spark, stations):
    """A station just above the stream's mouth whose label says that it lies below is moved below."""
    s = spark.createDataFrame([("x", "", 50.2985, 10.0), ("y", "", 50.2985, 10.0), ("far", "", 50.2, 10.0)], "station string, name string, lat double, lon double")
    lines = spark.createDataFrame([RIVER, STREAM], S)
    edges, at = river.build(lines, s, junctions="equal")
    labels = spark.createDataFrame([("x", "Velm d/s of Orsk Stream"), ("y", "Velm at mill"), ("far", "D/S Orsk")], "station string, label string")
    moved = {r.station: r for r in river.below_named_junctions(at, edges, lines, labels).collect()}
    assert moved["x"].moved == "Orsk Stream" and moved["y"].moved is None and moved["far"].moved is None
    below = {r.station: (r.lat, r.lon) for r in river.locate(spark.createDataFrame([moved["x"], moved["y"]], river_schema(at)), edges, lines).collect()}
    assert below["x"][0] > 50.3 > below["y"][0]


def river_schema(at):
    return ", ".join(f"{c} {t}" for c, t in at.dtypes) + ", moved string"


RECORD = "row_id int, station string, family string, variant string, unit string, year int, value double, latitude double, longitude double"


def test_surfaces_along_the_river(spark, stations):
    lines = spark.createDataFrame([RIVER, STREAM], S)
    edges, at = river.build(lines, stations.drop("value"), junctions="equal")
    rows = [(i, n, "BOD", "", "mg/l", 2023 + i % 2, v, lat, lon) for i, (n, lat, lon, v) in enumerate(POINTS)] + [(9, "high", "pH", "", "", 2023, 7.0, 50.05, 10.0), (10, "low", "pH", "max", "", 2023, 8.0, 50.4, 10.0)]
    s = surfaces.interpolate_all(spark.createDataFrame(rows, RECORD), (edges, at, lines), max_distance_km=60, size=48)
    about = {(r.period, r.family): r for r in s.about.collect()}
    assert about["all_years", "BOD"].method == "river_idw" and about["all_years", "BOD"].n_points == 5 and about["all_years", "BOD"].n_used == 4
    assert "ditch" in about["all_years", "BOD"].warning and about["2023", "pH"].interval and "Only a Max is reported at low" in about["2023", "pH"].warning
    cells = s.cells.where("period = 'all_years' and family = 'BOD'").collect()
    assert len(cells) > 40 and all(4 <= c.upper <= 40 and c.lower == c.upper and 0 <= c.confidence <= 100 for c in cells) and max(c.confidence for c in cells) == 100
    total = surfaces.summary(s).first()
    assert total.all_year_surfaces == 2 and total.limit_km == 60 and total.limit_chosen == "fixed" and total.mapped_stations == 5


def test_surfaces_without_a_river(spark):
    """Straight lines with a warning; two readings of a station are one point; a lone station is one cell."""
    rows = [(1, "a", "pH", "", "", 2024, 6.0, -3.0, -60.0), (2, "b", "pH", "", "", 2024, 8.0, -3.1, -60.1), (3, "b", "pH", "", "", 2024, 10.0, -3.1, -60.1), (4, "c", "BOD", "", "mg/l", 2024, 2.0, -10.0, -70.0), (5, "c", "BOD", "", "mg/l", 2024, None, -10.0, -70.0)]
    df = spark.createDataFrame(rows, RECORD)
    s = surfaces.interpolate_all(df, None, max_distance_km=30, size=16, reason="no file")
    about = {(r.period, r.family): r for r in s.about.collect()}
    ph = about["all_years", "pH"]
    assert ph.method == "straight_idw" and ph.n_points == 2 and ph.warning.startswith(surfaces.NO_NETWORK) and ph.warning.endswith("(no file)")
    assert {r.upper for r in s.values.where("period = 'all_years' and family = 'pH'").collect()} == {6.0, 9.0}
    lone = s.cells.where("family = 'BOD' and period = 'all_years'").collect()
    assert about["2024", "BOD"].method == "single" and {(c.lower, c.upper, c.confidence) for c in lone} == {(2.0, 2.0, 100)}
    auto = surfaces.interpolate_all(df, None, size=4)
    assert auto.limit_km == 8.0 and auto.limits.where("chosen").isEmpty()
    pick = surfaces.surface_for(s.about, "pH", year=2024).first()
    assert (pick.period, pick.family) == ("2024", "pH") and surfaces.surface_for(s.about, "pH", year=1999).isEmpty() and surfaces.surface_for(s.about, "ph", year=1999, fall_back=True).first().period == "all_years"
    for bad in (0, -1, float("nan"), True):
        with pytest.raises(ValueError):
            surfaces.interpolate_all(df, None, max_distance_km=bad)
