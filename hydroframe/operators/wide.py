"""Entity-attribute-value rows into one typed row per entity (problem 6).

RDD combineByKey: the combiner of an entity is a dict of slot registers; merging two registers is associative and
of constant size (winner, smallest and largest number, smallest and largest text, day). Cells are read and merged
within their Arrow batch already, so that a row per entity and batch goes to the RDD; duplicates are then resolved on
the map side, and an entity that holds a third of all rows moves as one combiner per map task. The merged batches are
written once to the shared folder, so that a lost executor doesn't cause all cells to be read again.

Defined cases: the smallest row_id wins a cell; missing values fill no cell, but their entity still gets a row;
rows without entity or of unlisted parameters fill nothing (the latter are in unlisted()); a number against a text
disagrees, '<x' counts as x; an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hydroframe.functions.measure import Parameters, load_parameters, read_cell
from hydroframe.plans.io import cut, only

#: Two numbers of a cell agree if they differ by no more than this share of the larger.
TOLERANCE = 0.01

Register = tuple  # (row_id, value, lowest number, highest number, least other, greatest other)


def merge_register(a: Register, b: Register) -> Register:
    """The associative, commutative merger of one cell."""
    first = a if a[0] <= b[0] else b
    low = min((x for x in (a[2], b[2]) if x is not None), default=None)
    high = max((x for x in (a[3], b[3]) if x is not None), default=None)
    least = min((x for x in (a[4], b[4]) if x is not None), default=None)
    most = max((x for x in (a[5], b[5]) if x is not None), default=None)
    return first[0], first[1], low, high, least, most


def disagrees(r: Register) -> bool:
    """Whether the values merged into a register differ."""
    low, high, least, most = r[2:]
    if low is not None and least is not None:
        return True
    if low is not None:
        return high - low > TOLERANCE * max(abs(low), abs(high))
    return least != most


def merge_cells(a: dict[str, Register], b: dict[str, Register]) -> dict[str, Register]:
    """Merges the smaller dict of registers into the larger."""
    if len(a) < len(b):
        a, b = b, a
    for slot, r in b.items():
        a[slot] = merge_register(a[slot], r) if slot in a else r
    return a


def slots(parameters: Parameters) -> list[tuple[str, str]]:
    """(slot, kind) in list order: every parameter, then the extremes of the number parameters."""
    plain = [(name, kind) for name, (_, kind) in parameters.listed.items()]
    return plain + [(f"{name} ({v})", kind) for name, kind in plain if kind == "number" for v in ("Max", "Min")]


def combined(measurements: DataFrame, parameters: Parameters) -> RDD:
    """(sample_id, {slot: register})."""
    known = {s for s, _ in slots(parameters)}
    names = ["sample_id", "row_id", "parameter", "unit", "value", "remarks"]
    plain = only(measurements, *names).where("sample_id is not null")

    def merge_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entities: dict[int, dict[str, Register]] = {}
            read: dict[tuple, tuple] = {}
            for sample, row, *cell in zip(*(c.to_pylist() for c in batch.columns)):
                cells = entities.setdefault(sample, {})
                if (got := read.get(key := tuple(cell))) is None:
                    got = read[key] = slot_and_values(parameters, known, *cell)
                slot, number, other = got
                if slot is not None:
                    r = (row, number if number is not None else other, number, number, other, other)
                    cells[slot] = merge_register(cells[slot], r) if slot in cells else r
            yield pa.RecordBatch.from_arrays([pa.array(list(entities), pa.int64()), pa.array([pickle.dumps(c, pickle.HIGHEST_PROTOCOL) for c in entities.values()], pa.binary())], names=["sample_id", "cells"])

    merged = cut(plain.mapInArrow(merge_batch, "sample_id long, cells binary"))
    parts = max(int(measurements.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return merged.rdd.map(lambda row: (row[0], pickle.loads(row[1]))).combineByKey(lambda c: c, merge_cells, merge_cells, parts)


def slot_and_values(parameters: Parameters, known: set[str], parameter: str | None, unit: str | None, value: str | None, remarks: str | None) -> tuple[str | None, float | None, str | None]:
    """(slot, number in the common unit, day or text) of a cell; no slot where it fills none."""
    name, variant, _, missing, *_, number, day, text = read_cell(parameters, parameter, unit, value, remarks)
    slot = f"{name} ({variant})" if variant else name
    if missing or slot not in known:
        return None, None, None
    return slot, number, None if number is not None else day.isoformat() if day else text


def wide(measurements: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row per sample_id, one typed column per slot, and the number of cells that received disagreeing values."""
    listed = load_parameters(parameters)
    columns = slots(listed)
    kinds = {"number": T.DoubleType(), "date": T.DateType()}
    schema = T.StructType([T.StructField("sample_id", T.LongType()), *(T.StructField(s, kinds.get(k, T.StringType())) for s, k in columns), T.StructField("n_disagreeing", T.LongType())])

    def encode(value: Any, kind: str) -> Any:
        if value is None:
            return None
        if kind == "number":
            return value if isinstance(value, float) else None
        if kind == "date":
            try:
                return datetime.date.fromisoformat(value)
            except ValueError:
                return None
        return str(value)

    rows = combined(measurements, listed).map(lambda kv: (kv[0], *(encode(kv[1][s][1], k) if s in kv[1] else None for s, k in columns), sum(map(disagrees, kv[1].values()))))
    return measurements.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def disagreeing_cells(measurements: DataFrame, parameters: DataFrame) -> DataFrame:
    """(sample_id, parameter) of every cell with two or more non-missing values that disagree."""
    schema = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("parameter", T.StringType())])
    rows = combined(measurements, load_parameters(parameters)).flatMap(lambda kv: [(kv[0], s) for s, r in kv[1].items() if disagrees(r)])
    return measurements.sparkSession.createDataFrame(rows, schema, verifySchema=False)
