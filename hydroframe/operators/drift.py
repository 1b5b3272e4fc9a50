"""Delivered files whose schema drifts, read into one table, with every change reported (problem 4).

The schema of a file has a fingerprint: its fields with their majority type, beside bounded histograms of their content
(types, forms, words, decimals, magnitudes). Per feed, files are chained by explicit steps: keep, rename (content moved under
another header, by likeness of content alone), add, remove and retype; a file with steps begins a new version. Every
line is then routed through the chain of its file: rename to the canonical field, default where the field is absent,
cast to the canonical type; known headers (a fixed list) only say which canonical field a chain begins at. Lines are
parsed and counted in Arrow batches, and counts summed in the JVM before and after the shuffle; only profiles (a row
per field and file) are grouped by feed.

Defined cases: null and blank lines, and lines without file, feed or number, carry no cells; a header may stand at any
line, what precedes it is no data; lines shorter than the header leave the rest null, surplus cells are dropped; a line
repeated within its file counts; of several files with one feed and file_no the smallest file_id holds; a file without a
header line, or whose predecessor is absent, reports no change; a column without non-missing cells has no type and
retypes nothing.
"""

from __future__ import annotations

import csv
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.units import is_missing
from hydroframe.plans.io import cut, only

SEPARATORS = ",;|\t"
#: Lines in which headers are looked for first; files without one there are searched whole.
HEADER_WITHIN = 6
#: Files whose headers and routes (a short row a file) are sent to every task; beyond, lines and headers are joined by a shuffle.
MAX_SENT = 50_000
#: Length of the hashed profiles of masks and values.
BUCKETS = 64
#: Content likeness from which a vanished and a new column are one.
ALIKE = 0.55

# Canonical fields and the headers known for them, letters and digits only.
FIELDS = {
    "sr_no": ["srno", "sno", "no", "serial", "slno", "serialno"],
    "parameter": ["parameter", "determinand", "testname", "param", "analyte"],
    "unit": ["unit", "units", "uom", "measuredin"],
    "month": ["month", "mon", "samplingmonth"],
    "year": ["year", "yr", "samplingyear"],
    "value": ["value", "result", "reading", "concentration"],
    "data_source": ["datasource", "agency", "reportedby", "source"],
    "location": ["location", "station", "samplingpoint", "sitename", "site"],
    "latitude": ["latitude", "lat", "ycoord"],
    "longitude": ["longitude", "long", "lon", "lng", "xcoord"],
    "lab_code": ["labcode", "laboratory"],
    "flow": ["flowm3s", "discharge", "flow"],
    "received_on": ["receivedon", "datereceived"],
    "depth": ["depthm", "sampledepth", "depth"],
    "sampler": ["sampler", "collectedby"],
    "method": ["testmethod", "method"],
}
CANONICAL = {h: field for field, headers in FIELDS.items() for h in headers}

_NUMBER = re.compile(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$", re.A)
_ISO = re.compile(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d)?)?$", re.A)


def field_key(header: str) -> str:
    """A header in lower case with only letters and digits kept."""
    return "".join(ch for ch in header.lower() if ch.isalnum())


def split_line(line: str | None, separator: str) -> list[str]:
    """Cells of a delimited line; quotes may enclose cells, and also the whole line."""
    t = (line or "").replace("\ufeff", "").replace("ï»¿", "").strip("\r\n")
    for _ in range(2):
        try:
            cells = next(csv.reader([t], delimiter=separator), [])
        except csv.Error:
            return [c.strip().strip('"') for c in t.split(separator)]
        if len(cells) != 1 or separator not in cells[0]:
            break
        t = cells[0]
    return [c.strip() for c in cells]


def find_header(lines: list[tuple[int, str]]) -> tuple[int, str, list[str]] | None:
    """(line_no, separator, field keys) of the first line of at least three distinct cells that aren't values."""
    for no, line in sorted(lines, key=lambda x: x[0]):
        separator = max(SEPARATORS, key=lambda s: (line or "").count(s))
        cells = split_line(line, separator)
        keys = [field_key(c) for c in cells]
        filled = [k for k in keys if k]
        if len(filled) >= 3 and len(set(filled)) == len(filled) and not any(_NUMBER.match(c) or _ISO.match(c) for c in cells):
            return no, separator, keys
    return None


_HEADER = "file_id long, header_line int, separator string, fields array<string>"


def _first_header(lines: DataFrame) -> DataFrame:
    """The header of every file of the given lines that has one; lines that can be none don't leave their batch."""

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            best: dict[int, tuple] = {}
            for i, no, line in zip(f["file_id"], f["line_no"], f["line"]):
                if (i not in best or (no, line) < best[i][0]) and (h := find_header([(no, line)])):
                    best[i] = ((no, line), h)
            yield pd.DataFrame([(i, *key, *h[1:]) for i, (key, h) in best.items()], columns=["file_id", "header_line", "line", "separator", "fields"])

    found = lines.mapInPandas(pick, "file_id long, header_line int, line string, separator string, fields array<string>")
    return found.groupBy("file_id").agg(F.min_by(F.struct("header_line", "separator", "fields"), F.struct("header_line", "line")).alias("h")).select("file_id", "h.*")


def headers(raw_lines: DataFrame) -> DataFrame:
    """(file_id, header_line, separator, fields) of every file with a header, wherever it stands."""
    lines = only(raw_lines, "file_id", "line_no", "line").where("file_id is not null and line_no is not null and trim(line) <> ''").select("file_id", F.col("line_no").cast("int").alias("line_no"), "line")
    early = cut(_first_header(lines.where(F.col("line_no") <= HEADER_WITHIN)))
    without = cut(lines.select("file_id").distinct().join(early.select("file_id"), "file_id", "left_anti"))
    if without.isEmpty():
        return early
    return cut(early.unionByName(_first_header(lines.join(without, "file_id", "left_semi"))))


def beside(lines: DataFrame, per_file: DataFrame) -> DataFrame:
    """Lines with the row of their file, which is sent to the tasks if there are at most MAX_SENT files."""
    return lines.join(F.broadcast(per_file) if per_file.limit(MAX_SENT + 1).count() <= MAX_SENT else per_file, "file_id")


def cell_kind(cell: str) -> str:
    """number, date (ISO) or text."""
    return "number" if _NUMBER.match(cell) else "date" if _ISO.match(cell) else "text"


_RUN = re.compile(r"([^\W\d_]+)|(\d+)|(\s+)|(.)", re.S)
_MONTH = re.compile(r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?$", re.I)
#: Runs of a cell that its form tells.
_FORM_RUNS = 6


def form(cell: str) -> str:
    """The form of a cell: its first runs of letters (with the case of the first) and digits with lengths up to 4, its
    blanks and other signs."""
    out = []
    for m in itertools.islice(_RUN.finditer(cell), _FORM_RUNS):
        letters, digits, blank, sign = m.groups()
        out.append(f"{'A' if letters[0].isupper() else 'a'}{min(len(letters), 4)}" if letters else f"9{min(len(digits), 4)}" if digits else "_" if blank else sign)
    return "".join(out)


def sort_of(cell: str, kind: str) -> int:
    """What a cell looks like: 0 a date; 1 a decimal, 2 a number up to twelve, 3 a year, 4 another whole number; 5 a
    month's name, 6 a text with digits, 7 with signs of units, 8 one word, 9 several."""
    if kind == "date":
        return 0
    if kind == "number":
        whole = re.fullmatch(r"[-+]?\d{1,9}", cell)
        return 1 if not whole else 2 if 1 <= int(cell) <= 12 else 3 if 1900 <= int(cell) < 2100 else 4
    if _MONTH.match(cell):
        return 5
    return 6 if re.search(r"\d", cell) else 7 if re.search(r"[/%°µ]", cell) else 8 if len(cell.split()) == 1 else 9


def lines_with_header(raw_lines: DataFrame) -> DataFrame:
    """Every data line beside the header of its file."""
    h = headers(raw_lines)
    body = only(raw_lines, "file_id", "feed", "file_no", "line_no", "line").where((F.trim("line") != "") & F.col("feed").isNotNull() & F.col("file_no").isNotNull())
    return beside(body, h).where(F.col("line_no") > F.col("header_line"))


_KINDS = ("number", "date", "text")
#: Where the histograms of a field begin: types, forms, words, decimals, magnitudes, sorts; and their end.
_AT = (0, 3, 3 + BUCKETS, 3 + 2 * BUCKETS, 13 + 2 * BUCKETS, 25 + 2 * BUCKETS)
_SLOTS = 35 + 2 * BUCKETS
_PROFILE = "file_id long, feed string, file_no int, pos int, field string, counts array<long>, low double, high double"
#: Different cells that a task remembers.
_REMEMBERED = 200_000


def cell_slots(cell: str) -> tuple[tuple[int, ...], float | None]:
    """(slots of the histograms that a cell counts in, its number); no slots where it is missing."""
    if is_missing(cell):
        return (), None
    kind = cell_kind(cell)
    x = float(cell) if kind == "number" else None
    slots = (_AT[0] + _KINDS.index(kind), _AT[1] + _bucket(form(cell)), _AT[2] + _bucket(cell.lower()), _AT[5] + sort_of(cell, kind))
    if x is None or not math.isfinite(x):
        return slots, None
    magnitude = min(max(math.floor(math.log10(abs(x))) + 4, 1), 11) if x else 0
    return (*slots, _AT[3] + min(len(cell.partition(".")[2]), 9), _AT[4] + magnitude), x


def profiles(lines: DataFrame) -> DataFrame:
    """One row per file and field: counts of types, forms, words, decimals, magnitudes and sorts, and the range of the numbers."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for f in frames:
            seen: dict[int, tuple] = {}
            for file_id, feed, no, line, separator, fields in zip(f["file_id"], f["feed"], f["file_no"], f["line"], f["separator"], f["fields"]):
                if (file := seen.get((file_id, feed, no))) is None:
                    file = seen[file_id, feed, no] = (fields, [[0] * _SLOTS for _ in fields], [[math.inf, -math.inf] for _ in fields])
                for cell, counts, numbers in zip(split_line(line, separator), file[1], file[2]):
                    if (got := known.get(cell)) is None:
                        if len(known) > _REMEMBERED:
                            known.clear()
                        got = known[cell] = cell_slots(cell)
                    for slot in got[0]:
                        counts[slot] += 1
                    if (x := got[1]) is not None:
                        numbers[0], numbers[1] = min(x, numbers[0]), max(x, numbers[1])
            rows = [(*key, pos, field, c, *(n if n[0] <= n[1] else (None, None))) for key, (fields, counts, numbers) in seen.items() for pos, (field, c, n) in enumerate(zip(fields, counts, numbers))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PROFILE.split(", ")])

    parts = lines.select("file_id", "feed", F.col("file_no").cast("int").alias("file_no"), "line", "separator", "fields").mapInPandas(count, _PROFILE)
    sums = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(_SLOTS)]
    whole = parts.groupBy("file_id", "feed", "file_no", "pos", "field").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))
    return whole.select("file_id", "feed", "file_no", "pos", "field", F.array(*(f"c{i}" for i in range(_SLOTS))).alias("counts"), "low", "high")


def _bucket(text: str) -> int:
    h = 2166136261
    for b in text.encode("utf-8", "replace"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    both = float(a @ a) * float(b @ b)
    return float(a @ b) / math.sqrt(both) if both else 0.0


class Field:
    """One field of one file: its majority type and its content profile."""

    def __init__(self, name: str, counts: np.ndarray, low: float | None, high: float | None) -> None:
        self.name, self.low, self.high = name, low, high
        kinds, *rest = np.split(np.asarray(counts, np.float64), _AT[1:])
        self.form, self.words, self.decimals, self.magnitude, self.sort = rest
        self.kind = _KINDS[int(kinds.argmax())] if kinds.any() else None
        #: How many of the cells differ, as far as the buckets tell.
        self.variety = np.count_nonzero(self.words) / min(kinds.sum(), BUCKETS) if self.kind else 0.0

    def alike(self, other: Field) -> float:
        """Likeness of content from 0 to 1; 0 across types."""
        if self.kind is None or self.kind != other.kind:
            return 0.0
        words, sort = _cosine(self.words, other.words), _cosine(self.sort, other.sort)
        variety = min(self.variety, other.variety) / max(self.variety, other.variety)
        if self.kind != "number":
            same_form = _cosine(self.form, other.form)
            return 0.3 * same_form + 0.35 * sort + 0.2 * words + 0.15 * variety if self.kind == "text" else 0.5 * same_form + 0.5 * variety
        ends = [x for x in (self.low, self.high, other.low, other.high) if x is not None and not math.isnan(x)]
        overlap = 0.0
        if len(ends) == 4:
            span = max(ends) - min(ends)
            overlap = max(0.0, min(self.high, other.high) - max(self.low, other.low)) / span if span else 1.0
        return 0.25 * _cosine(self.decimals, other.decimals) + 0.25 * _cosine(self.magnitude, other.magnitude) + 0.2 * sort + 0.15 * variety + 0.15 * max(overlap, words)


def fingerprint(fields: dict[str, Field]) -> str:
    """A short hash of a schema: its fields, in any order, with their majority types."""
    return hashlib.sha256("\n".join(f"{name}\t{fields[name].kind or ''}" for name in sorted(fields)).encode("utf-8", "replace")).hexdigest()[:16]


def steps(old: dict[str, Field], new: dict[str, Field]) -> list[tuple[str, str, str]]:
    """(field, kind, former field) from one file's schema to the next; the likest contents are one column first."""
    gone, came = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    scored = sorted(((-old[a].alike(new[b]), a, b) for a in gone for b in came))
    out, moved = [], {}
    for score, a, b in scored:
        if a not in moved and b not in moved.values() and -score >= ALIKE:
            moved[a] = b
            out.append((b, "renamed", a))
    out += [(a, "removed", a) for a in gone if a not in moved]
    out += [(b, "added", b) for b in came if b not in moved.values()]
    out += [(f, "retyped", f) for f in sorted(set(old) & set(new)) if old[f].kind and new[f].kind and old[f].kind != new[f].kind]
    return out


_CHAIN = "feed string, file_no int, file_id long, version int, fingerprint string, field string, kind string, former string, canonical string"


def chain(profile: DataFrame) -> DataFrame:
    """Per file its version and fingerprint, with the steps that lead to it (kind and former field), and where each of
    its fields goes (kind null, canonical)."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        files: dict[int, dict[int, list[tuple]]] = {}
        for no, file_id, *rest in zip(frame["file_no"], frame["file_id"], frame["pos"], frame["field"], frame["counts"], frame["low"], frame["high"]):
            files.setdefault(int(no), {}).setdefault(int(file_id), []).append(tuple(rest))
        rows, before, route, version, feed = [], None, {}, 0, frame["feed"].iloc[0]
        for no in sorted(files):
            file_id = min(files[no])
            now = {}
            for _, field, *content in sorted(files[no][file_id], key=lambda r: r[0]):
                if field:
                    now[field] = Field(field, *content)
            direct = before is not None and no == before[0] + 1
            changes = steps(before[1], now) if before else []
            version += before is None or bool(changes)
            own = (feed, no, file_id, version, fingerprint(now))
            former = {b: a for b, kind, a in changes if kind == "renamed"}
            taken: set[str] = set()
            fresh = {}
            for field in now:
                target = CANONICAL.get(field) or route.get(former.get(field, field)) or field
                if target not in taken:
                    taken.add(target)
                    fresh[field] = target
                    rows.append((*own, field, None, former.get(field), target))
            rows += [(*own, *c, None) for c in changes if direct]
            before, route = (no, now), fresh
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHAIN.split(", ")])

    return profile.groupBy("feed").applyInPandas(fold, _CHAIN)


def changes(raw_lines: DataFrame) -> DataFrame:
    """(file_id, field, kind) of every change against the feed's preceding file."""
    return chain(profiles(lines_with_header(raw_lines))).where("kind is not null").select("file_id", "field", "kind").distinct()


def versions(raw_lines: DataFrame) -> DataFrame:
    """(feed, file_no, file_id, version, fingerprint, n_fields, steps) of every file; steps are its migration from the
    preceding file, as text."""
    step = F.when(F.col("kind").isNotNull(), F.concat("kind", F.lit(" "), F.when(F.col("kind") == "renamed", F.concat("former", F.lit(" to "))).otherwise(""), "field"))
    c = chain(profiles(lines_with_header(raw_lines)))
    return c.groupBy("feed", "file_no", "file_id", "version", "fingerprint").agg(F.count_if(F.col("kind").isNull()).alias("n_fields"), F.array_join(F.array_sort(F.collect_list(step)), "; ").alias("steps"))


_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_DMS = re.compile(r"(\d+(?:\.\d+)?)\s*(?:deg|°|d)\w*\s*(\d+(?:\.\d+)?)?\s*(?:min|'|m)?\w*\s*(\d+(?:\.\d+)?)?\s*(?:sec|\"|s)?\w*\s*([NSEW])?\s*$", re.I)


def cast(field: str, cell: str | None) -> object:
    """The cast rule of a canonical field."""
    if is_missing(cell):
        return None
    t = cell.strip()
    if field == "month":
        if _ISO.match(t):
            return int(t[5:7])
        if _NUMBER.match(t):
            return int(float(t)) if 1 <= float(t) <= 12 else None
        return _MONTHS.get(t[:3].lower())
    if field == "year":
        m = re.search(r"(?:19|20)\d\d", t)
        return int(m[0]) if m else None
    if field in ("latitude", "longitude", "depth", "flow"):
        if (m := _DMS.match(t)) and field in ("latitude", "longitude"):
            x = float(m[1]) + float(m[2] or 0) / 60 + float(m[3] or 0) / 3600
            return -x if (m[4] or "").upper() in ("S", "W") else x
        m = re.match(r"[-+]?\d+(?:\.\d+)?", t)
        return float(m[0]) if m else None
    return t


_CASTS = {"month": "int", "year": "int", "latitude": "double", "longitude": "double", "depth": "double", "flow": "double"}


def unified(raw_lines: DataFrame) -> DataFrame:
    """Every data line as one row of the canonical schema; fields without a canonical one are kept in `other`."""
    lines = lines_with_header(raw_lines)
    routes = chain(profiles(lines)).where("kind is null").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "canonical"))).alias("route"))
    schema = ", ".join(["file_id long", "feed string", "file_no int", "line_no int", *(f"{f} {_CASTS.get(f, 'string')}" for f in FIELDS), "other map<string,string>"])
    names = [c.split()[0] for c in schema.split(", ")]

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file_id, feed, no, line_no, line, separator, fields, to in zip(f["file_id"], f["feed"], f["file_no"], f["line_no"], f["line"], f["separator"], f["fields"], f["route"]):
                to = dict(to)
                row: dict[str, object] = {"file_id": file_id, "feed": feed, "file_no": no, "line_no": line_no}
                other = {}
                for field, cell in zip(fields, split_line(line, separator)):
                    target = to.get(field)
                    if target in FIELDS:
                        row[target] = cast(target, cell)
                    elif field and not is_missing(cell):
                        other[target or field] = cell
                rows.append([*(row.get(n) for n in names[:-1]), other])
            frame = pd.DataFrame(rows, columns=names)
            for n, kind in _CASTS.items():
                frame[n] = frame[n].astype("Int64" if kind == "int" else "Float64")
            yield frame

    joined = beside(lines, cut(routes)).select("file_id", "feed", F.col("file_no").cast("int").alias("file_no"), F.col("line_no").cast("int").alias("line_no"), "line", "separator", "fields", "route")
    return joined.mapInPandas(route, schema)
