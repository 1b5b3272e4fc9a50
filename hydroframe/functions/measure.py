"""Reading of measurement cells: which canonical parameter, what was written, and its value in the common unit."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.functions.units import PLAIN_NUMBER, conversion, differs, is_missing, parse_number, parse_unit
from hydroframe.plans.io import only

#: Rows that a parameter list may have; it is held by every task.
MAX_PARAMETERS = 10_000

# Abbreviations and formulas in use, as key -> key of the list's name or long name.
ABBREVIATIONS = {
    "ec": "conductivity", "eccond": "conductivity", "spconductance": "conductivity", "cl": "chloride", "chlorides": "chloride", "no3": "nitrate", "nitrates": "nitrate", "f": "fluoride", "b": "boron",
    "watertemp": "temperature", "wt": "temperature", "analysisdate": "analysedon", "dateanalysed": "analysedon", "odor": "odour", "smell": "odour", "phvalue": "ph",
    "tcoli": "totalcoliform", "fcoli": "faecalcoliform", "tc": "totalcoliform", "fc": "faecalcoliform", "tcoliform": "totalcoliform", "fcoliform": "faecalcoliform", "thermotolerantcoliform": "faecalcoliform",
}

READING = T.StructType(
    [
        T.StructField("parameter", T.StringType()),
        T.StructField("variant", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("missing", T.BooleanType()),
        T.StructField("plain", T.BooleanType()),
        T.StructField("number", T.DoubleType()),
        T.StructField("bound", T.BooleanType()),
        T.StructField("stated_unit", T.StringType()),
        T.StructField("common_unit", T.StringType()),
        T.StructField("factor", T.DoubleType()),
        T.StructField("shift", T.DoubleType()),
        T.StructField("converted", T.BooleanType()),
        T.StructField("common_value", T.DoubleType()),
        T.StructField("day", T.DateType()),
        T.StructField("text", T.StringType()),
    ]
)

_VARIANT = re.compile(r"[\s(\[,-]*\(?\s*\b(max|min|maximum|minimum)\b\.?\s*[)\]]?\s*$", re.I)
_TAIL = re.compile(r"^(.*?)\s*(?:\(([^()]*)\)|\[([^\[\]]*)\]|,\s*(\S.*))\s*$", re.S)
_REMARK = re.compile(r"\b(?:units?\s*(?:is|are|was)?\s*[:=]?|(?:reported|recorded|given|expressed|stated|measured|results?)\s+(?:as|in)|gives|says|in|as)\s+(.+?)\s*(?:[,;]|\.\s|\.?$)", re.I)


def _key(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower().replace("fecal", "faecal").replace("odor", "odour").replace("sulf", "sulph"))


class Parameters:
    """The canonical parameter list and the reading of spellings against it.

    A spelling is looked up by letters and digits alone, then among the fixed abbreviations, then as an unambiguous
    beginning (three letters or more) of a listed name; what remains is returned as no parameter.
    """

    def __init__(self, rows: Iterable[Mapping[str, str | None]]) -> None:
        self.listed = {}
        self.keys: dict[str, str] = {}
        for r in rows:
            name = r["parameter"]
            if name is None:
                continue
            self.listed[name] = (r.get("unit") or "", r.get("kind") or "text")
            for text in (name, r.get("long_name") or ""):
                for key in {_key(text), _key(re.sub(r"\(.*?\)", "", text)), _key(re.sub(r"\b(bacteria|water|index|ion|sampling|at|of)\b", "", text, flags=re.I))}:
                    if key:
                        self.keys.setdefault(key, name)
        for short, full in ABBREVIATIONS.items():
            if full in self.keys:
                self.keys.setdefault(short, self.keys[full])
        self._seen: dict[str | None, tuple[str | None, str, str]] = {}
        self._contexts: dict[tuple, tuple] = {}

    def _lookup(self, text: str) -> str | None:
        key = _key(text)
        if key in self.keys:
            return self.keys[key]
        for short in (re.sub(r"(value|cond|condition|conditions|level|conc|concentration|s)$", "", key),):
            if short in self.keys:
                return self.keys[short]
        if len(key) >= 3:
            starts = {name for k, name in self.keys.items() if k.startswith(key)}
            if len(starts) == 1:
                return starts.pop()
        return None

    def find(self, text: str | None) -> tuple[str | None, str, str]:
        """(canonical name, '' or 'Max' or 'Min', unit stated in the parameter's text)."""
        if (got := self._seen.get(text)) is None:
            if len(self._seen) > 65536:
                self._seen.clear()
            got = self._seen[text] = self._find(text)
        return got

    def context(self, parameter: str | None, unit: str | None, remarks: str | None) -> tuple:
        """(name, variant, kind, common unit, stated unit, factor, shift, whether converted) of what surrounds a value:
        a unit in the parameter's text holds before the unit column, that before the remarks."""
        key = (parameter, unit, remarks)
        if (got := self._contexts.get(key)) is None:
            if len(self._contexts) > 65536:
                self._contexts.clear()
            name, variant, tail = self.find(parameter)
            common, kind = self.listed.get(name, ("", None))
            stated, change = None, None
            if kind == "number":
                m = _REMARK.search(remarks or "")
                stated, change = next(((c.strip(), x) for c in (tail, unit, m[1] if m else "") if not is_missing(c) and (x := conversion(c, common, name))), (None, None))
            got = self._contexts[key] = name, variant, kind, common, stated, *(change or (1.0, 0.0)), differs(change)
        return got

    def _find(self, text: str | None) -> tuple[str | None, str, str]:
        if text is None or not text.strip():
            return None, "", ""
        t, variant, unit = text.strip(), "", ""
        for _ in range(3):
            if not variant and (m := _VARIANT.search(t)) and m.start() > 0:
                variant, t = m[1][:3].title(), t[: m.start()].strip()
                continue
            if self._lookup(t) and (not (m := _TAIL.match(t)) or self._lookup(m[1]) is None or parse_unit(m[2] or m[3] or m[4] or "") is None or _key(t) in self.keys):
                break
            m = _TAIL.match(t)
            if not m or not m[1]:
                break
            if parse_unit(tail := m[2] or m[3] or m[4] or "") is not None:
                unit = unit or tail.strip()
            t = m[1]
        return self._lookup(t), variant, unit


def _day(text: str) -> datetime.date | None:
    t = re.sub(r"[./\s]+", "-", text.strip())
    for form in ("%d-%m-%Y", "%Y-%m-%d", "%d-%b-%Y", "%d-%B-%Y", "%Y%m%d", "%d-%m-%y"):
        try:
            return datetime.datetime.strptime(t[:10] if form == "%Y-%m-%d" else t, form).date()
        except ValueError:
            continue
    return None


def read_cell(parameters: Parameters, parameter: str | None, unit: str | None, value: str | None, remarks: str | None) -> tuple:
    """One cell as a tuple in the order of READING.

    A unit written after the value holds before one in the parameter's text, that before the unit column, that
    before the remarks; texts that aren't units of the parameter's dimension state nothing.
    """
    name, variant, kind, common, stated, factor, shift, converted = parameters.context(parameter, unit, remarks)
    number = bound = day = text = common_value = None
    if kind == "number" and value is not None and PLAIN_NUMBER.match(value) and math.isfinite(number := float(value)):
        return name, variant, kind, False, True, number, False, stated, common, factor, shift, converted, factor * number + shift, None, None
    number = None
    missing = is_missing(value)
    plain = not missing and PLAIN_NUMBER.match(value) is not None
    if kind == "number":
        rest = ""
        if not missing and (n := parse_number(value)):
            number, rest, bound = n
            own = rest.strip("()[] ")
            if not is_missing(own) and (change := conversion(own, common, name)):
                stated, (factor, shift), converted = own, change, differs(change)
        if number is not None and rest and parse_unit(rest.strip("()[] ")) is None and (re.match(r"[-/.:]\s*\d", rest) or re.match(r"[A-Za-z]{3,}\s*\d", rest)):
            number = bound = None  # a date or a range among the numbers
        if number is not None:
            common_value = factor * number + shift
        elif not missing:
            text = value.strip().lower()
    elif not missing:
        day = _day(value) if kind == "date" else None
        text = None if day else value.strip().lower()
    return name, variant, kind, missing, plain, number, bound, stated, common, factor, shift, converted, common_value, day, text


def load_parameters(parameters: DataFrame) -> Parameters:
    """The parameter list, collected; it is refused beyond MAX_PARAMETERS rows."""
    rows = only(parameters, "parameter", "long_name", "unit", "kind").limit(MAX_PARAMETERS + 1).collect()
    if len(rows) > MAX_PARAMETERS:
        raise ValueError(f"a parameter list has at most {MAX_PARAMETERS} rows")
    return Parameters(r.asDict() for r in rows)


def reading(parameters: Parameters, parameter: Column, unit: Column, value: Column, remarks: Column | None = None, fields: Iterable[str] = ()) -> Column:
    """READING of each row, or only the named fields of it, by an Arrow batch function; equal cells of a batch are read
    once."""
    at = [READING.fieldNames().index(f) for f in fields] or list(range(len(READING.fields)))
    shape = T.StructType([READING.fields[i] for i in at])
    nullable = {T.DoubleType(): "Float64", T.BooleanType(): "boolean"}

    @F.pandas_udf(shape)
    def read(p: pd.Series, u: pd.Series, v: pd.Series, r: pd.Series) -> pd.DataFrame:
        seen: dict[tuple, int] = {}
        which = [seen.setdefault(cell, len(seen)) for cell in zip(p, u, v, r)]
        columns = list(zip(*(read_cell(parameters, *cell) for cell in seen)))
        index = np.array(which, np.int64)
        out = {}
        for i, f in zip(at, shape.fields):
            c = pd.array(columns[i] if columns else [], dtype=nullable.get(f.dataType, object))
            out[f.name] = pd.Series(c.take(index) if len(index) else c)
        return pd.DataFrame(out)

    return read(parameter, unit, value, F.lit(None).cast("string") if remarks is None else remarks)


def readings(measurements: DataFrame, parameters: DataFrame | Parameters, keep: Iterable[str] = ("row_id",), fields: Iterable[str] = ()) -> DataFrame:
    """keep columns of measurements plus the fields of READING, or the named ones."""
    listed = parameters if isinstance(parameters, Parameters) else load_parameters(parameters)
    plain = only(measurements, *dict.fromkeys([*keep, "parameter", "unit", "value", "remarks"]))
    m = plain.select(*keep, reading(listed, F.col("parameter"), F.col("unit"), F.col("value"), F.col("remarks"), fields).alias("reading"))
    return m.select(*keep, "reading.*")
