"""Conversion of measurements that are recorded in different units (problem 3).

Units are read with the grammar of functions.units: dimensions are exponent vectors, and scale and offset lead to
the common unit of the parameter list. No shuffle: the list is small (checked) and goes to the tasks.

Defined cases: a null, blank or marker value is missing and has no common value; a result without a number (BDL,
ND) keeps null as common value; '<x' is converted at x; a unit of another dimension states nothing; repeated rows
come out as often as they come in; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.measure import Parameters, readings


def to_common_units(measurements: DataFrame, parameters: DataFrame | Parameters) -> DataFrame:
    """One row per measurement of a number parameter: what was stated and the value in the common unit."""
    r = readings(measurements, parameters, ("row_id", "load_id", "sample_id"))
    return r.where("kind = 'number'").select(
        "row_id", "load_id", "sample_id", "parameter", "variant", "number", "bound", "stated_unit", "common_unit", "factor", "shift", "converted", "missing", F.round("common_value", 9).alias("common_value")
    )


def rows_converted(measurements: DataFrame, parameters: DataFrame | Parameters) -> DataFrame:
    """row_id of every non-missing value whose stated unit differs from the common unit in scale or zero point."""
    return readings(measurements, parameters, ("row_id",), ("kind", "missing", "converted")).where("kind = 'number' and converted and not missing").select("row_id")
