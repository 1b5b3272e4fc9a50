"""The unit and number grammars, and the reading of cells."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from hydroframe.functions.measure import READING, Parameters, read_cell
from hydroframe.functions.units import conversion, differs, is_missing, parse_number, parse_unit

LIST = [
    {"parameter": "pH", "long_name": "Hydrogen ion index", "unit": "-", "kind": "number"},
    {"parameter": "Temperature", "long_name": "Water temperature", "unit": "°C", "kind": "number"},
    {"parameter": "Conductivity", "long_name": "Electrical conductivity", "unit": "µS/cm", "kind": "number"},
    {"parameter": "Chloride", "long_name": "Chloride", "unit": "mg/l", "kind": "number"},
    {"parameter": "Boron(B)", "long_name": "Boron", "unit": "mg/l", "kind": "number"},
    {"parameter": "Total Coliform", "long_name": "Total coliform bacteria", "unit": "MPN/100ml", "kind": "number"},
    {"parameter": "Odour", "long_name": "Odour", "unit": None, "kind": "text"},
    {"parameter": "Analysed On", "long_name": "Date of analysis", "unit": None, "kind": "date"},
]


@pytest.mark.parametrize("text", ["mg/L", "mg / l", "mg.l-1", "milligrams l⁻¹", "mgl", "mg\\l", "mg⁄l", "ppm", "g/m3", "milligram/litre", "mg per litre"])
def test_spellings_of_the_common_unit(text):
    assert not differs(conversion(text, "mg/l"))


@pytest.mark.parametrize(
    ("text", "common", "x", "want"),
    [("µg/l", "mg/l", 1000, 1), ("ppb", "mg/l", 1000, 1), ("kg/m3", "mg/l", 1, 1000), ("S/m", "µS/cm", 0.1, 1000), ("dS/m", "µS/cm", 1, 1000), ("mmho/cm", "µS/cm", 1, 1000), ("°F", "°C", 212, 100), ("K", "°C", 273.15, 0), ("MPN/ml", "MPN/100ml", 1, 100), ("x1000 MPN/100ml", "MPN/100ml", 2, 2000), ("thousand MPN/100 ml", "MPN/100ml", 2, 2000), ("MPN/l", "MPN/100ml", 10, 1)],
)
def test_conversions(text, common, x, want):
    factor, shift = conversion(text, common)
    assert math.isclose(factor * x + shift, want, abs_tol=1e-9)


def test_amounts_need_a_substance():
    assert conversion("mmol/l", "mg/l") is None
    assert math.isclose(conversion("mmol/l", "mg/l", "Chloride")[0], 35.453)


def test_no_units():
    assert parse_unit("bottle 3") is None and parse_unit("") is None and conversion("mg/l", "°C") is None


@pytest.mark.parametrize(("text", "x"), [("46x10^2", 4600), ("7,700", 7700), ("O.643", 0.643), ("4O4OO", 40400), ("18..0", 18), ("~12.3", 12.3), ("approx 20.5", 20.5), ("65*", 65), ("<0.358", 0.358), (" 27.3", 27.3)])
def test_numbers(text, x):
    assert math.isclose(parse_number(text)[0], x)


@pytest.mark.parametrize("text", [None, "", "BDL", "ND", "fog", "x" * 10_000])
def test_no_numbers(text):
    assert parse_number(text) is None


@given(st.text(max_size=40))
def test_grammars_never_fail(text):
    parse_number(text)
    parse_unit(text)
    is_missing(text)
    p = Parameters(LIST)
    read_cell(p, text, text, text, text)


def test_missing():
    assert all(map(is_missing, [None, "", " ", "NA", "n/a", "nil", "null", "-", "--"])) and not any(map(is_missing, ["BDL", "ND", "<5", "none", "0"]))


def read(**cell):
    p = Parameters(LIST)
    return dict(zip(READING.fieldNames(), read_cell(p, *(cell.get(k) for k in ("parameter", "unit", "value", "remarks")))))


@pytest.mark.parametrize(("text", "want"), [("Cl", ("Chloride", "")), ("p.H.", ("pH", "")), ("EC", ("Conductivity", "")), ("Temp.", ("Temperature", "")), ("T-Coliform", ("Total Coliform", "")), ("Boron (B)", ("Boron(B)", "")), ("pH ( Max )", ("pH", "Max")), ("Chloride (MIN)", ("Chloride", "Min")), ("Conductivity [S/m]", ("Conductivity", "")), ("Odor", ("Odour", "")), ("analysis date", ("Analysed On", ""))])
def test_parameters(text, want):
    r = read(parameter=text, value="1")
    assert (r["parameter"], r["variant"]) == want


def test_where_units_are_stated():
    for cell in ({"value": "0.05 g/l"}, {"value": "0.05", "parameter": "Chloride, g/L"}, {"value": "0.05", "unit": "kg/m3"}, {"value": "0.05", "remarks": "in g/l, bottle 2"}, {"value": "0.05 (g/l)", "unit": "-"}):
        r = read(**{"parameter": "Chloride", **cell})
        assert r["converted"] and math.isclose(r["common_value"], 50), cell
    assert not read(parameter="Chloride", unit="g/l of", value="5", remarks="grab sample")["converted"]
    assert read(parameter="Total Coliform", value="12x10^3", unit="MPN/100ml")["common_value"] == 12000
    assert not read(parameter="Total Coliform", value="12x10^3", unit="MPN/100ml")["converted"]


def test_dates_and_texts():
    assert str(read(parameter="Analysed On", value="04-09-2021")["day"]) == "2021-09-04" == str(read(parameter="Analysed On", value="2021-09-04")["day"])
    assert read(parameter="Odour", value="Fishy ")["text"] == "fishy"
