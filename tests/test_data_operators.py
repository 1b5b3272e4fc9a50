"""The data-preparation operators on small tables with known cases, nulls, empty tables and clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hydroframe.operators import drift, profile, spikes, units, wide

M = "row_id long, load_id long, feed string, sample_id long, sr_no int, parameter string, unit string, month string, value string, data_source string, year string, location string, latitude double, longitude double, remarks string, loaded_at timestamp"
P = "parameter string, long_name string, unit string, kind string"
PARAMETERS = [("pH", "Hydrogen ion index", "-", "number"), ("Chloride", "Chloride", "mg/l", "number"), ("Temperature", "Water temperature", "°C", "number"), ("Odour", "Odour", None, "text"), ("Analysed On", "Date of analysis", None, "date")]


@pytest.fixture(scope="module")
def parameters(spark):
    return spark.createDataFrame(PARAMETERS, P)


def rows(*cells):
    """Measurement rows from (load, sample, parameter, unit, value)."""
    return [(i, c[0], "f", c[1], i, c[2], c[3], None, c[4], None, None, None, None, None, c[5] if len(c) > 5 else None, None) for i, c in enumerate(cells, 1)]


def clash(df):
    """The table with extra columns whose names meet internal ones, some in other case."""
    return df.withColumn("reading", F.lit("x")).withColumn("kind", F.lit(1)).withColumn("n", F.lit(2)).select("*", F.lit("y").alias("VALUE"), F.lit("z").alias("Unit"), F.lit(0).alias("key"))


def test_conversion(spark, parameters):
    m = spark.createDataFrame(rows((1, 1, "Chloride", "g/l", "0.05"), (1, 1, "Chloride", "mg/L", "5"), (1, 1, "Chloride", "g/l", None), (1, 1, "Odour", "g/l", "x"), (1, 1, None, None, None), (1, 1, "Temp", "K", "BDL"), (1, 1, "Chloride (Max)", None, "<0.2 g/l"), (1, 1, "pH", "pH units", "7")), M)
    assert {r.row_id for r in units.rows_converted(clash(m), parameters).collect()} == {1, 6, 7}
    values = {r.row_id: r.common_value for r in units.to_common_units(m, parameters).collect()}
    assert values[1] == 50 and values[2] == 5 and values[3] is None and values[7] == 200


def test_wide(spark, parameters):
    m = spark.createDataFrame(
        rows((1, 1, "Chloride", "mg/l", "50"), (1, 1, "Chloride", "g/l", "0.0502"), (1, 1, "Chloride (Max)", "mg/l", "9"), (1, 2, "Cl", "mg/l", "5"), (1, 2, "Chloride", "mg/l", "6"), (1, 2, "Odour", None, "Fishy"), (1, 2, "Odor", None, "fishy "), (1, 3, "Odour", None, None), (1, 4, "Analysed On", None, "01-02-2024"), (1, 4, "Analysed On", None, "2024-02-02"), (1, None, "pH", "-", "7"), (1, 5, "nonsense", None, "1"), (1, 6, "Chloride", None, "BDL"), (1, 6, "Chloride", None, "3")),
        M,
    )
    found = {(r.sample_id, r.parameter) for r in wide.disagreeing_cells(clash(m), parameters).collect()}
    assert found == {(2, "Chloride"), (4, "Analysed On"), (6, "Chloride")}
    w = {r.sample_id: r for r in wide.wide(m, parameters).collect()}
    assert set(w) == {1, 2, 3, 4, 5, 6}
    assert w[1]["Chloride"] == 50 and w[1]["Chloride (Max)"] == 9 and w[2]["Odour"] == "fishy" and w[4]["Analysed On"] == dt.date(2024, 2, 1) and w[3]["Odour"] is None and w[2]["n_disagreeing"] == 1


def test_registers_merge_in_any_order():
    cells = [(k, x, x, x, None, None) for k, x in enumerate([1.0, 5.0, 3.0])] + [(9, "a", None, None, "a", "a")]
    want = None
    for _ in range(10):
        random.shuffle(cells)
        out = cells[0]
        for c in cells[1:]:
            out = wide.merge_register(out, c)
        want = want or out
        assert out == want and wide.disagrees(out)


def test_profile(spark, parameters):
    cells = []
    for load in range(1, 9):
        for k in range(40):
            value, unit = str(10 + k % 5), "mg/l"
            if load == 2 and k % 2:
                value = None
            if load == 3 and k % 2:
                value = f"~{value}"
            if load == 4 and k % 2:
                unit = "mg per l"
            if load == 5 and k % 2:
                unit = " "
            if load == 6:
                value = str(100 + k % 5)
            cells.append((load, k, "Chloride", unit, value))
    found = {tuple(r) for r in profile.departing_loads(clash(spark.createDataFrame(rows(*cells), M)), parameters).collect()}
    assert found == {(2, "value", "missing"), (3, "value", "pattern"), (4, "unit", "categories"), (5, "unit", "missing"), (6, "value", "level")}


def test_states_merge_like_one_scan(spark, parameters):
    m = spark.createDataFrame(rows(*((1, k, "Chloride", "mg/l", str(k)) for k in range(100))), M)
    whole = profile.states(m, parameters)
    parts = profile.states(m.where("row_id <= 30"), parameters).unionByName(profile.states(m.where("row_id > 30"), parameters))
    keys = profile.KEYS
    show = lambda s: profile.merge_states(s, *keys).select(*keys, "n_rows", "min_value", "max_value", F.hll_sketch_estimate("value_texts"), F.kll_sketch_get_quantile_double("level", F.lit(0.5))).collect()
    assert show(whole) == show(parts)


def test_a_new_load_needs_no_older_rows(spark, parameters, tmp_path):
    """Stored states and those of a new load give what a scan of everything gives, and the plan reads only the states."""
    cells = [(load, k, "Chloride", "mg/l" if load < 8 or k % 2 else "mg/L.", None if load == 8 and k % 2 else str(10 + k % 5)) for load in range(1, 9) for k in range(40)]
    m = spark.createDataFrame(rows(*cells), M)
    profile.states(m.where("load_id < 8"), parameters).write.parquet(str(tmp_path / "states"))
    stored, new = spark.read.parquet(str(tmp_path / "states")), profile.states(m.where("load_id = 8"), parameters)
    found = profile.departing(stored.unionByName(new))
    want = {tuple(r) for r in profile.departing_loads(m, parameters).collect()}
    assert {tuple(r) for r in found.collect()} == want == {(8, "value", "missing"), (8, "unit", "categories")}
    assert all("states" in f for f in stored.inputFiles())


def test_one_scan(spark, parameters):
    """The states are one aggregate over one reading of the table."""
    m = spark.createDataFrame(rows((1, 1, "Chloride", "mg/l", "5")), M)
    plan = profile.states(m, parameters)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


R = "reading_id long, probe_id long, location string, parameter string, unit string, value string, read_at timestamp, received_at timestamp"


def series(values, probe=1, parameter="DO", first=1):
    at = dt.datetime(2022, 1, 1)
    return [(first + i, probe, "x", parameter, "mg/l", v if v is None or isinstance(v, str) else f"{v:.3f}", at + dt.timedelta(minutes=30 * i), None) for i, v in enumerate(values)]


def brute(readings):
    """The problem's statement, row by row."""
    out, groups = set(), {}
    for r in sorted(readings, key=lambda r: (r[6], r[0])):
        try:
            x = float(r[5])
        except (TypeError, ValueError):
            continue
        low, high = spikes.RANGES.get(r[3], (0, float("inf")))
        if not low <= x <= high:
            out.add((r[0], "impossible"))
        else:
            groups.setdefault((r[1], r[3]), []).append((r[0], x))
    for g in groups.values():
        ids, v = zip(*g)
        steps = sorted(s for a, b in zip(v, v[1:]) if (s := round(abs(a - b), 9)) > 0)
        n = len(steps)
        usual = (steps[n // 2] + steps[(n - 1) // 2]) / 2 if n else None
        spike = set()
        for i in range(1, len(v)):
            for b in (i, i + 1):
                if usual and b + 1 < len(v):
                    gaps = [x - y for x in v[i : b + 1] for y in (v[i - 1], v[b + 1])]
                    if all(x > 10 * usual for x in gaps) or all(x < -10 * usual for x in gaps):
                        spike |= set(ids[i : b + 1])
        start = 0
        for i in range(1, len(v) + 1):
            if i == len(v) or v[i] != v[start]:
                if i - start >= 8:
                    out |= {(j, "stuck") for j in ids[start:i] if j not in spike}
                start = i
        out |= {(j, "spike") for j in spike}
    return out


def test_spikes_against_brute_force(spark):
    rng = random.Random(3)
    readings = []
    for probe in range(4):
        x, v = 8.0, []
        for i in range(900):  # several blocks
            x += rng.gauss(0, 0.05)
            v.append(max(x, 0.5))
        for at in (50, 383, 384, 385, 700):
            v[at] += rng.choice([6, 9])
        v[200:212] = [v[200]] * 12
        v[380:392] = [v[380]] * 12 if probe == 1 else v[380:392]
        v[500], v[501], v[502] = -1.0, "err", None
        readings += series(v, probe, first=probe * 10_000 + 1)
    df = clash(spark.createDataFrame(readings, R))
    assert {tuple(r) for r in spikes.implausible(df).collect()} == brute(readings)


def test_spikes_at_the_same_time_of_day():
    """Spikes that recur daily are low rank, and found all the same."""
    import numpy as np
    import pandas as pd

    n = 8 * 96
    x = 20 + 3 * np.sin(np.arange(n) * 2 * np.pi / 96)
    usual = float(np.median(np.abs(np.diff(x))))
    spiked = list(range(40, n, 96))
    x[spiked] += 15 * usual
    frame = pd.DataFrame({"reading_id": range(n), "at": np.arange(n) * 900.0, "x": x, "before": [[]] * n, "after": [[]] * n, "usual": usual})
    found = spikes._block(frame)
    assert found["reading_id"].tolist() == spiked and set(found["kind"]) == {"spike"}


def test_pursuit_decides_what_is_checked(monkeypatch):
    """The height of candidates alone is checked; without a usual course more are candidates, and the same are found."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    n = 8 * 96
    x = 20 + 3 * np.sin(np.arange(n) * 2 * np.pi / 96) + rng.normal(0, 0.02, n)
    usual = float(np.median(np.abs(np.diff(x))))
    spiked = sorted({*range(40, n, 96), 100, 101, 333, 500, 501})
    x[spiked] += 15 * usual
    frame = pd.DataFrame({"reading_id": range(n), "at": np.arange(n) * 900.0, "x": x, "before": [[]] * n, "after": [[]] * n, "usual": usual})
    checked, tall = [], spikes.tall
    monkeypatch.setattr(spikes, "tall", lambda *a: checked.append(len(out := tall(*a))) or out)
    found = spikes._block(frame)
    assert found["reading_id"].tolist() == spiked and checked[0] < n / 2
    for course in (lambda m: m - np.median(m), lambda m: m * np.nan, lambda m: m):
        monkeypatch.setattr(spikes, "robust_pca", course)
        assert spikes._block(frame)["reading_id"].tolist() == spiked and checked[-1] > checked[0]


def test_spikes_beside_enormous_numbers(spark):
    """A number whose square is infinite is a spike like any other, and the pursuit ends."""
    rng = random.Random(5)
    v = [8 + rng.gauss(0, 0.05) for _ in range(500)]
    v[60], v[200], v[300] = "1e200", v[200] + 4, "-7e160"
    readings = series(v, parameter="DO") + series([*v[:300], "9.9e299", *v[301:]], probe=2, parameter="DO", first=1001)
    got = {tuple(r) for r in spikes.implausible(spark.createDataFrame(readings, R)).collect()}
    assert got == brute(readings) and {(61, "spike"), (201, "spike"), (301, "impossible"), (1301, "spike")} <= got


def test_spikes_of_repeated_rows(spark):
    r = series([7.0, 7.1, 7.0, 7.2, 7.1], parameter="pH") + [(99, 1, "x", "pH", "-", "7.000", dt.datetime(2022, 1, 1), None), (100, None, "x", "pH", "-", "99", None, None), (None, 1, None, None, None, None, None, None)]
    assert {tuple(x) for x in spikes.implausible(spark.createDataFrame(r, R)).collect()} == {(100, "impossible")}


L = "file_id long, feed string, file_no int, file_name string, received_at timestamp, line_no int, line string"


def files(*texts, feed="f"):
    return [(n, feed, n, f"{n}.csv", None, i, line) for n, t in enumerate(texts, 1) for i, line in enumerate(t, 1)]


def body(header, cells, sep=","):
    return [sep.join(header), *(sep.join(c) for c in cells)]


def test_drift(spark):
    a = body(["Station", "Value", "Month", "Depth m", "Year"], [["Alpha Weir", "1.5", "Feb", "0.3", "2020"], ["Beta Weir", "2.5", "Feb", "0.9", "2020"], ["Alpha Weir", "NA", "Feb", "1.2", "2020"]])
    b = ["Water quality return", *body(["LOCATION", "Year", "Value", "Month"], [["Alpha Weir", "2020", "1.0", "5"], ['"Beta Weir"', "2020", "2.0", "5"], ["Alpha Weir", "2020", "", "5"]], ";")]
    c = body(["Location", "Month", "Year", "Value", "Sampler"], [["Alpha Weir", "5", "2020", "3 mg/l", "team 1"], ["Beta Weir", "6", "2020", "4 mg/l", "team 2"]], "|")
    df = spark.createDataFrame([*files(a, b, c), (9, None, None, None, None, 1, "a,b,c"), (10, "g", 1, None, None, 1, None), (11, "g", 2, None, None, 1, "x" * 50_000)], L)
    found = {tuple(r) for r in drift.changes(df.select("*", F.lit(1).alias("kind"), F.lit(0).alias("LINE_NO"), F.lit("x").alias("fields"))).collect()}
    assert found == {(2, "location", "renamed"), (2, "month", "retyped"), (2, "depthm", "removed"), (3, "sampler", "added"), (3, "value", "retyped")}
    u = drift.unified(df).orderBy("file_id", "line_no").collect()
    assert [r.location for r in u] == ["Alpha Weir", "Beta Weir", "Alpha Weir"] * 2 + ["Alpha Weir", "Beta Weir"]
    assert [r.month for r in u] == [2, 2, 2, 5, 5, 5, 5, 6] and u[0].depth == 0.3 and u[6].sampler == "team 1"


def test_casts():
    assert drift.cast("latitude", "25 deg 14 min 0.3 sec N") == pytest.approx(25.233417, abs=1e-6)
    assert drift.cast("month", "2021-05-18") == 5 and drift.cast("year", "FY 2017-18") == 2017 and drift.cast("depth", "1.4 m") == 1.4 and drift.cast("month", "-") is None


def field(name, cells):
    counts, numbers = [0] * drift._SLOTS, []
    for c in cells:
        slots, x = drift.cell_slots(c)
        for k in slots:
            counts[k] += 1
        numbers += [] if x is None else [x]
    return drift.Field(name, counts, min(numbers, default=None), max(numbers, default=None))


def test_content_alone_decides():
    places, mine = ["Alpha Weir", "Beta Weir"], ["12.5", "13.25"]
    old, new = {"wherefrom": field("wherefrom", places), "depth": field("depth", mine)}, {"spot": field("spot", places), "level": field("level", mine)}
    assert sorted(drift.steps(old, new)) == [("level", "renamed", "depth"), ("spot", "renamed", "wherefrom")]
    # Two known headers of one field with other content are no rename.
    assert drift.steps({"site": field("site", places)}, {"station": field("station", ["7", "8"])}) == [("site", "removed", "site"), ("station", "added", "station")]
    assert drift.fingerprint(old) == drift.fingerprint(dict(reversed(old.items()))) != drift.fingerprint(new)


def test_late_header_and_versions(spark):
    a = [*(f"Remark {i}" for i in range(9)), *body(["Station", "Value", "Extra thing"], [["Alpha Weir", "1.5", "x1"], ["Beta Weir", "2.5", "x2"]])]
    b = body(["Station", "Value", "Extra thing"], [["Alpha Weir", "1.0", "x1"], ["Beta Weir", "2.0", "x2"]], ";")
    c = body(["Site", "Value", "Year"], [["Alpha Weir", "1.0", "2020-01-01"], ["Beta Weir", "2.0", "2020-01-02"]])
    df = spark.createDataFrame(files(a, b, c), L)
    v = {r.file_no: r for r in drift.versions(df).collect()}
    assert [v[n].version for n in (1, 2, 3)] == [1, 1, 2] and v[1].fingerprint == v[2].fingerprint != v[3].fingerprint
    assert v[2].steps == "" and v[3].steps == "added year; removed extrathing; renamed station to site"
    u = drift.unified(df).orderBy("file_id", "line_no").collect()
    assert len(u) == 6 and u[0].location == "Alpha Weir" and u[0].other == {"extrathing": "x1"} and u[4].other == {}


def test_headers_of_many_files(spark, monkeypatch):
    """Beyond the bound lines and headers are joined, with the same result."""
    df = spark.createDataFrame(files(body(["A", "B", "C"], [["x", "1", "2"]]), body(["A", "B", "D"], [["x", "1", "2020-01-01"]])), L)
    want = {tuple(r) for r in drift.changes(df).collect()}
    monkeypatch.setattr(drift, "MAX_SENT", 1)
    assert {tuple(r) for r in drift.changes(df).collect()} == want == {(2, "c", "removed"), (2, "d", "added")}


def test_empty_tables(spark, parameters):
    m, r, lines = (spark.createDataFrame([], s) for s in (M, R, L))
    for df in (profile.departing_loads(m, parameters), profile.profile(m, parameters), units.rows_converted(m, parameters), wide.disagreeing_cells(m, parameters), wide.wide(m, parameters), spikes.implausible(r), drift.changes(lines), drift.unified(lines)):
        assert df.collect() == []
    none = spark.createDataFrame([], P)
    one = spark.createDataFrame(rows((1, 1, "Chloride", "g/l", "1")), M)
    assert wide.wide(one, none).columns == ["sample_id", "n_disagreeing"] and units.rows_converted(one, none).collect() == []
