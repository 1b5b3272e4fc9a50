"""Stations on a network of lines: segments, matching by name and distance, channels and their order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions import text as X
from hydroframe.functions.names import base_similarity, name_base
from hydroframe.operators import graph
from hydroframe.plans.io import cut

NAME_LIKENESS = 0.8
NAME_FAR_KM = 15.0
#: Stations of a channel that the swap rule works through in one call.
MAX_CHANNEL_STATIONS = 100_000


def segments(lines: DataFrame) -> DataFrame:
    """(line_id, seg, x1, y1, x2, y2, length, before): line pieces with the metres along the line before each."""
    p = lines.select("line_id", F.posexplode("pts").alias("seg", "p"))
    w = W.partitionBy("line_id").orderBy("seg")
    s = p.select("line_id", "seg", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.lead("p.x").over(w).alias("x2"), F.lead("p.y").over(w).alias("y2")).where("x2 is not null")
    s = s.withColumn("length", X.flat_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")))
    return s.withColumn("before", F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))


def _fraction(lat: Column, lon: Column) -> Column:
    k = F.cos(F.radians(lat))
    dx, dy = (F.col("x2") - F.col("x1")) * k, F.col("y2") - F.col("y1")
    t = ((lon - F.col("x1")) * k * dx + (lat - F.col("y1")) * dy) / (dx * dx + dy * dy)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def nearby_lines(stations: DataFrame, segs: DataFrame, limit_km: float) -> DataFrame:
    """(station, line_id, metres, along): each station with its nearest point of every line within the limit.

    Segments are filed under every cell of the limit's size that their box touches.
    """
    step = limit_km * 1000 / X.DEGREE_M
    wide = F.lit(2.0)
    cells = lambda a, b, s: F.explode(F.sequence(F.floor(F.least(a, b) / s), F.floor(F.greatest(a, b) / s)))
    filed = segs.withColumn("r", cells(F.col("y1"), F.col("y2"), F.lit(step))).withColumn("c", cells(F.col("x1"), F.col("x2"), wide * step))
    s = stations.withColumn("r", F.explode(F.sequence(F.floor(F.col("lat") / step) - 1, F.floor(F.col("lat") / step) + 1)))
    around = F.ceil(1 / (wide * F.greatest(F.cos(F.radians("lat")), F.lit(0.05))))
    s = s.withColumn("c", F.explode(F.sequence(F.floor(F.col("lon") / (wide * step)) - around, F.floor(F.col("lon") / (wide * step)) + around)))
    t = _fraction(F.col("lat"), F.col("lon"))
    met = s.join(filed, ["r", "c"]).withColumn("t", t)
    met = met.withColumn("metres", X.flat_m(F.col("lat"), F.col("lon"), F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1")), F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))))
    met = met.where(F.col("metres") <= limit_km * 1000)
    return met.groupBy("station", "line_id").agg(F.min("metres").alias("metres"), F.min_by(F.col("before") + F.col("t") * F.col("length"), "metres").alias("along"))


def match_stations(stations: DataFrame, lines: DataFrame, limit_km: float = 2.0) -> DataFrame:
    """(station, line_id, metres, along, method): by a like name within the limit, then within 15 km, else the nearest.

    stations: station, name ('' unknown), lat, lon; lines: line_id, name, pts. Ties go to the more alike, the nearer,
    the lesser line. A nearest line counts only if it has a name.
    """
    far = cut(nearby_lines(stations, segments(lines), max(limit_km, NAME_FAR_KM)))
    j = far.join(stations.select("station", F.col("name").alias("own")), "station").join(lines.select("line_id", F.col("name").alias("line_name")), "line_id")
    j = j.withColumn("base_a", name_base("own")).withColumn("base_b", name_base("line_name"))
    j = j.withColumn("likeness", F.when((F.col("base_a") == "") | (F.col("base_b") == ""), 0.0).when(F.col("base_a") == F.col("base_b"), 1.0).otherwise(base_similarity(F.col("base_a"), F.col("base_b"), NAME_LIKENESS)))
    near = F.col("metres") <= limit_km * 1000
    named = F.col("likeness") >= NAME_LIKENESS
    grade = F.when(named & near, 0).when(named, 1).when(near, 2)
    w = W.partitionBy("station").orderBy("grade", F.when(F.col("grade") < 2, -F.col("likeness")).otherwise(0.0), "metres", "line_id")
    best = j.withColumn("grade", grade).where("grade is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    usable = (F.col("grade") < 2) | (F.coalesce("line_name", F.lit("")) != "")
    method = F.when(~usable, "none").when(F.col("grade") == 0, "name").when(F.col("grade") == 1, "name, far").otherwise("nearest")
    found = best.select("station", F.when(usable, F.col("line_id")).alias("line_id"), F.round("metres", 1).alias("metres"), F.round("along", 1).alias("along"), method.alias("method"))
    return stations.select("station").join(found, "station", "left").withColumn("method", F.coalesce("method", F.lit("none")))


def touching(lines: DataFrame, within_m: float = 30.0) -> DataFrame:
    """(node, line_id, x, y): line ends that lie within within_m of one another share the least end's node."""
    n = F.size("pts")
    ends = cut(lines.select("line_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("pts")[0].alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("pts", n).alias("p")))).alias("e")).select((F.col("line_id") * 2 + F.col("e.end")).alias("node"), "line_id", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y")))
    step = within_m / X.DEGREE_M
    a = ends.withColumn("r", F.floor(F.col("y") / step)).withColumn("c", F.floor(F.col("x") / (4 * step)))
    b = a.withColumnsRenamed({"node": "node_b", "x": "x_b", "y": "y_b", "line_id": "line_b"}).withColumn("r", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1))).withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    pairs = a.join(b, ["r", "c"]).where((F.col("node") < F.col("node_b")) & (X.flat_m(F.col("y"), F.col("x"), F.col("y_b"), F.col("x_b")) <= within_m)).select(F.col("node").alias("a"), F.col("node_b").alias("b"))
    c = graph.components(ends.select("node"), pairs)
    return ends.join(c, "node").select(F.col("component").alias("node"), "line_id", "x", "y")


def channels(lines: DataFrame, within_m: float = 30.0) -> DataFrame:
    """(line_id, channel): lines of one name that touch one another are one channel, named by its least line."""
    t = touching(lines, within_m).join(lines.select("line_id", name_base("name").alias("base")), "line_id").where("base <> ''")
    same = t.groupBy("base", "node").agg(F.min("line_id").alias("a"))
    edges = t.join(same, ["base", "node"]).select("a", F.col("line_id").alias("b")).where("a <> b")
    return graph.components(lines.select(F.col("line_id").alias("node")), edges).select(F.col("node").alias("line_id"), F.col("component").alias("channel"))


def order_stations(placed: DataFrame, swap_m: float = 2000.0) -> DataFrame:
    """(channel, station, position): from far to near the outlet, unknown last, then by name; within swap_m an
    upstream label of the same place goes before a downstream one.

    placed: channel, station, label, to_outlet_m.
    """
    p = placed.withColumn("marker", X.flow_marker(F.col("label")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > MAX_CHANNEL_STATIONS:
            raise ValueError(f"a channel has at most {MAX_CHANNEL_STATIONS} stations")
        f = f.assign(far=-f["to_outlet_m"].fillna(-math.inf)).sort_values(["far", "label", "station"]).reset_index(drop=True)
        order = list(range(len(f)))
        for _ in range(len(order)):
            moved = False
            for k in range(len(order) - 1):
                a, b = order[k], order[k + 1]
                gap = abs(f["to_outlet_m"][a] - f["to_outlet_m"][b])
                if f["marker"][a] == "DS" and f["marker"][b] == "US" and gap <= swap_m:
                    order[k], order[k + 1], moved = b, a, True
            if not moved:
                break
        return pd.DataFrame({"channel": f["channel"], "station": [f["station"][i] for i in order], "position": range(1, len(order) + 1)})

    kinds = dict(placed.dtypes)
    return p.groupBy("channel").applyInPandas(run, f"channel {kinds['channel']}, station {kinds['station']}, position int")


def samples_along(edges: DataFrame, every_m: float = 100.0) -> DataFrame:
    """(edge, k, t): points every every_m metres of each edge, ends included, as metres above its lower node."""
    n = F.greatest(F.ceil(F.col("length") / every_m), F.lit(1))
    return edges.select("edge", "length", n.alias("n"), F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k")).select("edge", "k", (F.col("length") * F.col("k") / F.col("n")).alias("t"))


def clip_and_simplify(lines: DataFrame, west: float, south: float, east: float, north: float, tolerance_m: float = 20.0) -> DataFrame:
    """Lines cut to a box and thinned by Douglas-Peucker; parts of a metre or less are left out."""

    def clip(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        d, lo, hi = q - p, 0.0, 1.0
        for axis, low, high in ((0, west, east), (1, south, north)):
            for delta, room in ((-d[axis], p[axis] - low), (d[axis], high - p[axis])):
                if delta == 0:
                    if room < 0:
                        return None
                elif delta < 0:
                    lo = max(lo, room / delta)
                else:
                    hi = min(hi, room / delta)
        return None if lo >= hi else (p + lo * d, p + hi * d)

    def thin(pts: np.ndarray) -> np.ndarray:
        k = np.array([math.cos(math.radians(float(pts[:, 1].mean()))), 1.0]) * X.DEGREE_M
        m, keep, stack = pts * k, {0, len(pts) - 1}, [(0, len(pts) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            base = m[b] - m[a]
            rel = m[a + 1 : b] - m[a]
            length = math.hypot(*base)
            t = np.clip(rel @ base / length**2, 0, 1) if length else np.zeros(len(rel))
            away = np.hypot(*(rel - t[:, None] * base).T)
            at = int(away.argmax())
            if away[at] > tolerance_m:
                keep.add(a + 1 + at)
                stack += [(a, a + 1 + at), (a + 1 + at, b)]
        return pts[sorted(keep)]

    def run(frames):
        for f in frames:
            rows = []
            for line_id, pts in zip(f["line_id"], f["pts"]):
                a = np.array([(p["x"], p["y"]) for p in pts], float)
                part: list[list[np.ndarray]] = []
                run_: list[np.ndarray] = []
                for p, q in zip(a[:-1], a[1:]):
                    got = clip(p, q)
                    if got is None:
                        continue
                    if run_ and np.allclose(run_[-1], got[0]):
                        run_.append(got[1])
                    else:
                        run_ = [*got]
                        part.append(run_)
                for k, piece in enumerate(part):
                    xy = np.array(piece)
                    if np.hypot(*(np.diff(xy, axis=0) * [math.cos(math.radians(xy[0, 1])) * X.DEGREE_M, X.DEGREE_M]).T).sum() > 1:
                        rows.append((line_id, k, [{"x": float(x), "y": float(y)} for x, y in thin(xy)]))
            yield pd.DataFrame(rows, columns=["line_id", "part", "pts"])

    return lines.select("line_id", "pts").mapInPandas(run, f"line_id {dict(lines.dtypes)['line_id']}, part int, pts array<struct<x:double,y:double>>")
