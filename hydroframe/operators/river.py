"""Lines as a directed river graph, stations on it, and their relations along the water.

Lines are cut where another line's end meets their inside, ends close to one another become nodes, stations are
snapped, and every connected part is oriented to its outlet. Cutting, joining and snapping are grid-keyed joins; the
orientation works through one connected part per call (MAX_EDGES bounds it); shares and relations are level loops of
joins with checkpoints.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions import text as X
from hydroframe.functions import names
from hydroframe.operators import channels, graph, interpolate, network
from hydroframe.plans.io import cut
from hydroframe.sources.tables import with_row_id

JOIN_M = 30.0
T_JOIN_M = 100.0
LABEL_JUNCTION_M = 500.0
#: Edges of a connected part that is oriented by one call.
MAX_EDGES = 500_000
MAX_OUTLETS = 40
LOW_SPREAD_M, LOW_BAND_M = 5.0, 3.0
# Kinds and names of lines that keep their drawn direction.
CANAL_KINDS = ["canal", "ditch", "drain", "irrigation", "aqueduct"]
CANAL_NAME = r"(?i)\b(?:CANAL|NAHAR|NEHAR|BRANCH|DISTRIBUTARY|DISTY|FEEDER|MINOR)\b"
# Shares of the water that lines take where it divides, by words of their names; other canals, rivers.
RANKS = [(r"(?i)\bMINOR\b", 1.0), (r"(?i)\b(?:DISTRIBUTARY|DISTY)\b", 2.0), (r"(?i)\bBRANCH\b", 4.0)]
CANAL_RANK, RIVER_RANK = 8.0, 16.0
RELATIONS = ("DOWN", "UP", "UNCONNECTED")


def is_canal(kind: Column, name: Column) -> Column:
    """Whether a line is an artificial channel."""
    return F.coalesce(F.lower(kind).isin(CANAL_KINDS), F.lit(False)) | F.coalesce(name.rlike(CANAL_NAME), F.lit(False))


def split_rank(kind: Column, name: Column) -> Column:
    """The weight of a line where water divides and no discharges are known: rivers before main, branch and minor canals."""
    text = F.coalesce(name, F.lit(""))
    rank = F.when(~is_canal(kind, text), RIVER_RANK)
    for words, weight in RANKS:
        rank = rank.when(text.rlike(words), weight)
    return rank.otherwise(CANAL_RANK)


def cut_lines(lines: DataFrame) -> DataFrame:
    """(line_id, part, from_m, to_m, x1, y1, x2, y2): lines cut at T-junctions, in drawn order."""
    segs = cut(channels.segments(lines))
    total = segs.groupBy("line_id").agg(F.sum("length").alias("total"))
    ends = lines.select(F.explode(F.array(F.struct((F.col("line_id") * 2).alias("station"), F.col("pts")[0].alias("p")), F.struct((F.col("line_id") * 2 + 1).alias("station"), F.element_at("pts", -1).alias("p")))).alias("e"))
    ends = ends.select("e.station", F.col("e.p.y").alias("lat"), F.col("e.p.x").alias("lon"))
    met = channels.nearby_lines(ends, segs, T_JOIN_M / 1000).where("floor(station / 2) <> line_id").join(total, "line_id")
    marks = met.where((F.col("along") > JOIN_M) & (F.col("along") < F.col("total") - JOIN_M)).select("line_id", F.round("along", 3).alias("m"))
    marks = marks.unionByName(total.select("line_id", F.lit(0.0).alias("m"))).unionByName(total.select("line_id", F.col("total").alias("m"))).distinct()
    w = W.partitionBy("line_id").orderBy("m")
    parts = marks.withColumn("to_m", F.lead("m").over(w)).withColumn("part", F.row_number().over(w)).where("to_m - m > 1").withColumnRenamed("m", "from_m")

    def at(df: DataFrame, m: str, x: str, y: str) -> DataFrame:
        j = df.join(segs.select("line_id", "seg", F.col("x1").alias("a"), F.col("y1").alias("b"), F.col("x2").alias("c"), F.col("y2").alias("d"), "length", "before"), "line_id").where((F.col(m) >= F.col("before") - 1e-6) & (F.col(m) <= F.col("before") + F.col("length") + 1e-6))
        t = F.when(F.col("length") > 0, (F.col(m) - F.col("before")) / F.col("length")).otherwise(0.0)
        keep = df.columns
        return j.groupBy(*keep).agg(F.min_by(F.struct((F.col("a") + t * (F.col("c") - F.col("a"))).alias("x"), (F.col("b") + t * (F.col("d") - F.col("b"))).alias("y")), "seg").alias("p")).select(*keep, F.col("p.x").alias(x), F.col("p.y").alias(y))

    return at(at(parts, "from_m", "x1", "y1"), "to_m", "x2", "y2")


def raw_edges(lines: DataFrame) -> DataFrame:
    """(edge, line_id, up, down, length, from_m, to_m, canal, area, discharge): edges in drawn direction between merged
    nodes, a T-junction's end joining the cut it made."""
    parts = cut(with_row_id(cut_lines(lines).orderBy("line_id", "part"), "edge"))
    ends = parts.select(F.explode(F.array(F.struct((F.col("edge") * 2).alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct((F.col("edge") * 2 + 1).alias("node"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select("e.*")
    step = T_JOIN_M / X.DEGREE_M
    a = ends.withColumn("r", F.floor(F.col("y") / step)).withColumn("c", F.floor(F.col("x") / (3 * step)))
    b = a.select(F.col("node").alias("node_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"), F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)).alias("r"), "c")
    b = b.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    gap = X.flat_m(F.col("y"), F.col("x"), F.col("y_b"), F.col("x_b"))
    inner = parts.join(parts.groupBy("line_id").agg(F.min("part").alias("first"), F.max("part").alias("last")), "line_id")
    cuts = inner.where("part > first").select((F.col("edge") * 2).alias("node")).unionByName(inner.where("part < last").select((F.col("edge") * 2 + 1).alias("node")))
    pairs = a.join(b, ["r", "c"]).where("node <> node_b").withColumn("gap", gap)
    close = pairs.where((F.col("gap") <= JOIN_M) & (F.col("node") < F.col("node_b"))).select(F.col("node").alias("a"), F.col("node_b").alias("b"))
    t_joins = pairs.where(F.col("gap") <= T_JOIN_M + 1).join(cuts.select(F.col("node").alias("node_b")).distinct(), "node_b").join(cuts.select("node"), "node", "left_anti").groupBy("node").agg(F.min_by("node_b", F.struct("gap", "node_b")).alias("b")).select(F.col("node").alias("a"), "b")
    node = cut(graph.components(ends.select("node"), close.unionByName(t_joins)))
    n = lambda c: node.select(F.col("node").alias("_n"), F.col("component").alias(c))
    e = parts.join(n("up"), F.col("edge") * 2 == F.col("_n")).drop("_n").join(n("down"), F.col("edge") * 2 + 1 == F.col("_n")).drop("_n")
    extra = lines.select("line_id", is_canal(F.col("kind"), F.col("name")).alias("canal"), F.col("upstream_area").alias("area"), "discharge")
    return e.where("up <> down").join(extra, "line_id").select("edge", "line_id", "up", "down", (F.col("to_m") - F.col("from_m")).alias("length"), "from_m", "to_m", "canal", "area", "discharge")


def _orient(f: pd.DataFrame) -> pd.DataFrame:
    """Natural edges turned to the outlet, canals as drawn; canals, then lesser edges, leave until no cycle is left."""
    if len(f) > MAX_EDGES:
        raise ValueError(f"a connected part has at most {MAX_EDGES} edges")
    f = f.sort_values("edge").reset_index(drop=True)
    up, down = f["up"].tolist(), f["down"].tolist()
    natural = [i for i in range(len(f)) if not f["canal"][i]]
    around: dict[int, list[tuple[int, float]]] = {}
    for i in natural:
        around.setdefault(up[i], []).append((down[i], f["length"][i]))
        around.setdefault(down[i], []).append((up[i], f["length"][i]))
    height = {n: h for n, h in [*zip(f["up"], f["up_m"]), *zip(f["down"], f["down_m"])] if h is not None and not pd.isna(h)}

    def distances(start: int) -> dict[int, float]:
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, n = heapq.heappop(heap)
            if d > best[n]:
                continue
            for m, length in around[n]:
                if d + length < best.get(m, math.inf):
                    best[m] = d + length
                    heapq.heappush(heap, (d + length, m))
        return best

    todo = set(around)
    while todo:
        part = set(distances(next(iter(todo))))
        todo -= part
        own = [i for i in natural if up[i] in part]
        ends = sorted(n for n in part if len(around[n]) == 1)
        known = [n for n in ends if n in height]
        drawn_away = {up[i] for i in own}
        if len(known) >= 2 and max(height[n] for n in known) - min(height[n] for n in known) >= LOW_SPREAD_M:
            low = min(height[n] for n in known)
            options = [n for n in known if height[n] <= low + LOW_BAND_M]
        else:
            options = sorted(ends, key=lambda n: (n in drawn_away, n))[:MAX_OUTLETS] or [min(part)]
        scored = []
        for o in options:
            d = distances(o)
            scored.append((-sum(f["length"][i] for i in own if d[down[i]] < d[up[i]]), o, d))
        d = min(scored, key=lambda s: s[:2])[2]
        for i in own:
            if d[up[i]] < d[down[i]] or (d[up[i]] == d[down[i]] and up[i] < down[i]):
                up[i], down[i] = down[i], up[i]
    keep = set(range(len(f)))
    while True:
        left, count, out = set(keep), {}, {}
        for i in keep:
            count[down[i]] = count.get(down[i], 0) + 1
            out.setdefault(up[i], []).append(i)
        free = [n for n in {up[i] for i in keep} if not count.get(n)]
        while free:
            for i in out.get(free.pop(), []):
                left.discard(i)
                count[down[i]] -= 1
                if not count[down[i]]:
                    free.append(down[i])
        starts = {up[i] for i in left}
        cyclic = [i for i in left if down[i] in starts]
        if not cyclic:
            break
        keep.discard(min(cyclic, key=lambda i: (not f["canal"][i], f["edge"][i])))
    ids = sorted(keep)
    g = f.loc[ids].copy()
    turned = [up[i] != f["up"][i] for i in ids]
    g["up"], g["down"], g["turned"] = [up[i] for i in ids], [down[i] for i in ids], turned
    return g[["edge", "line_id", "up", "down", "length", "from_m", "to_m", "canal", "area", "discharge", "turned"]]


def build(lines: DataFrame, stations: DataFrame, limit_km: float = 2.0, junctions: str = "auto", heights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with share, station positions): the oriented graph of the parts that have stations.

    lines: line_id, name, kind, upstream_area, discharge, pts; stations: station, name, lat, lon; heights: node, m.
    junctions: area, equal, order or auto (area where every natural edge has one). A position is metres above the
    lower node of an edge.
    """
    if junctions not in ("auto", "area", "equal", "order"):
        raise ValueError("junctions is auto, area, equal or order")
    e = cut(raw_edges(lines))
    matched = channels.match_stations(stations, lines, limit_km).where("line_id is not null").select("station", "line_id", "along")
    on = matched.join(e.select("edge", "line_id", "from_m", "to_m"), "line_id").where((F.col("along") >= F.col("from_m") - 0.1) & (F.col("along") <= F.col("to_m") + 0.1)).groupBy("station").agg(F.min_by(F.struct("edge", "along"), "edge").alias("p")).select("station", "p.*")
    on = cut(on)
    nodes = e.select(F.col("up").alias("node")).union(e.select("down")).distinct()
    part = graph.components(nodes, e.select(F.col("up").alias("a"), F.col("down").alias("b")))
    e = e.join(part.select(F.col("node").alias("up"), "component"), "up")
    used = on.join(e.select("edge", "component"), "edge").select("component").distinct()
    h = heights.select("node", F.col("m").cast("double").alias("m")) if heights is not None else nodes.select("node", F.lit(None).cast("double").alias("m")).where("false")
    e = e.join(used, "component", "left_semi").join(h.select(F.col("node").alias("up"), F.col("m").alias("up_m")), "up", "left").join(h.select(F.col("node").alias("down"), F.col("m").alias("down_m")), "down", "left")
    kinds = dict(e.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("edge", "line_id", "up", "down", "length", "from_m", "to_m", "canal", "area", "discharge")) + ", turned boolean"
    o = cut(e.groupBy("component").applyInPandas(_orient, schema))
    if junctions == "auto":
        lacking = o.where("NOT canal AND NOT coalesce(area > 0, false)").isEmpty()
        junctions = "area" if lacking and not o.isEmpty() else "equal"
    rank = o.join(lines.select("line_id", split_rank(F.col("kind"), F.col("name")).alias("rank")), "line_id")
    known = F.min(F.coalesce((F.col("discharge") > 0).cast("int"), F.lit(0))).over(W.partitionBy("up")) == 1
    weighted = rank.select("edge", "up", "down", "length", F.when(known, F.col("discharge").cast("double")).otherwise(F.col("rank")).alias("weight"))
    shares = cut(graph.flow_shares(weighted))
    flow = shares.join(o.select("edge", "area", "canal", "from_m", "to_m", "turned"), "edge")
    into = W.partitionBy("down")
    if junctions == "equal":
        share = 1 / F.count(F.lit(1)).over(into)
    else:
        weight = F.when(~F.col("canal") & (F.col("area") > 0), F.col("area")).otherwise(F.col("flow")) if junctions == "area" else F.col("flow")
        share = F.coalesce(F.try_divide(weight, F.sum(weight).over(into)), 1 / F.count(F.lit(1)).over(into))
    flow = flow.withColumn("share", share)
    position = on.join(flow.select("edge", "from_m", "to_m", "turned", "length"), "edge").select("station", "edge", F.least(F.greatest(F.when(F.col("turned"), F.col("along") - F.col("from_m")).otherwise(F.col("to_m") - F.col("along")), F.lit(0.0)), F.col("length")).alias("t"))
    placed = flow.join(o.select("edge", "line_id"), "edge")
    return cut(placed.select("edge", "up", "down", "length", "share", "canal", "line_id", "from_m", "to_m", "turned")), cut(position)


def locate(points: DataFrame, edges: DataFrame, lines: DataFrame) -> DataFrame:
    """points (edge, t, ...) with lat and lon; edges as from build(). An interval join keyed by line."""
    along = F.when(F.col("turned"), F.col("from_m") + F.col("t")).otherwise(F.col("to_m") - F.col("t"))
    p = points.join(edges.select("edge", "line_id", "from_m", "to_m", "turned"), "edge").withColumn("along", along)
    s = channels.segments(lines)
    j = p.join(s, "line_id").where((F.col("along") >= F.col("before") - 1e-6) & (F.col("along") <= F.col("before") + s["length"] + 1e-6))
    k = F.when(s["length"] > 0, (F.col("along") - F.col("before")) / s["length"]).otherwise(0.0)
    at = F.min_by(F.struct((F.col("y1") + k * (F.col("y2") - F.col("y1"))).alias("lat"), (F.col("x1") + k * (F.col("x2") - F.col("x1"))).alias("lon")), "seg")
    return j.groupBy(*points.columns).agg(at.alias("_p")).select(*points.columns, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))


def below_named_junctions(positions: DataFrame, edges: DataFrame, lines: DataFrame, labels: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """positions with every station whose label says that it lies downstream of a water moved just below the junction
    of that water, if it lies within 500 m above it; moved says which.

    labels: station, label; edges as from build(). Stations with such labels walk down junction by junction.
    """
    said = labels.select("station", F.trim(F.regexp_extract("label", network.DOWNSTREAM_OF, 1)).alias("said")).where("said <> ''")
    said = said.withColumn("said", F.coalesce(F.nullif(names.parse_water_body("said"), F.lit("")), F.col("said")))
    said = (said if aliases is None else names.canonical_names(said, "said", aliases)).withColumn("a", names.name_base("said"))
    named = edges.join(lines.select("line_id", F.col("name").alias("line_name")), "line_id").withColumn("b", names.name_base("line_name"))
    named = cut(named.select("edge", "up", "down", "length", "canal", "line_name", "b"))
    like = cut(names.near_bases(said.select(F.col("a").alias("base")), named.select(F.col("b").alias("base")), network.REFERENCE_LIKENESS))
    at = positions.join(named.select("edge", "down"), "edge").join(said.select("station", "a"), "station")
    front = cut(at.select("station", "a", F.col("down").alias("node"), F.col("edge").alias("came"), F.col("t").alias("distance")).where(F.col("distance") <= LABEL_JUNCTION_M))
    first = named.groupBy(F.col("up").alias("node")).agg(F.min_by(F.struct("edge", "length", "down"), F.struct("canal", "edge")).alias("below"))
    moved: DataFrame | None = None
    while not front.isEmpty():
        here = front.join(first, "node")
        joining = front.join(named.select(F.col("down").alias("node"), F.col("edge").alias("e"), "b", "line_name"), "node").where("e <> came").join(like.select("a", "b"), ["a", "b"]).groupBy("station").agg(F.min_by("line_name", "e").alias("moved"))
        found = cut(here.join(joining, "station").select("station", F.col("below.edge").alias("edge"), F.greatest(F.col("below.length") - 1, F.lit(0.0)).alias("t"), "moved"))
        moved = found if moved is None else moved.unionByName(found)
        on = here.join(found.select("station"), "station", "left_anti").select("station", "a", F.col("below.down").alias("node"), F.col("below.edge").alias("came"), (F.col("distance") + F.col("below.length")).alias("distance"))
        front = cut(on.where(F.col("distance") <= LABEL_JUNCTION_M))
    if moved is None:
        return positions.withColumn("moved", F.lit(None).cast("string"))
    rest = positions.join(moved.select("station"), "station", "left_anti").withColumn("moved", F.lit(None).cast("string"))
    return rest.unionByName(moved.select(*positions.columns, "moved"))


def flow_segments(edges: DataFrame, positions: DataFrame, limit_km: float, tree: bool = False) -> DataFrame:
    """(station, edge, lo, hi, base, slope, share, relation): where on which edge a station is felt; the distance of a
    point x metres above the edge's lower node is base + slope * x."""
    limit = limit_km * 1000
    p = positions.join(edges, "edge").select("station", "edge", "t", "up", "down", "length", "share")
    row = lambda df, lo, hi, base, slope, share, relation: df.select("station", "edge", lo.alias("lo"), hi.alias("hi"), base.alias("base"), F.lit(float(slope)).alias("slope"), share.alias("share"), F.lit(relation).alias("relation"))
    z, one = F.lit(0.0), F.lit(1.0)
    own = row(p, z, F.col("t"), F.col("t"), -1, one, "DOWN").unionByName(row(p, F.col("t"), F.col("length"), -F.col("t"), 1, one, "UP"))
    d = cut(graph.reach(edges, p.select("station", F.col("down").alias("node"), F.col("t").alias("distance"), "share"), limit, "down"))
    u = cut(graph.reach(edges, p.select("station", F.col("up").alias("node"), (F.col("length") - F.col("t")).alias("distance"), F.lit(1.0).alias("share")), limit, "up"))
    e = edges.select("edge", "up", "down", "length", F.col("share").alias("own"))
    below = d.join(e, d["node"] == e["up"])
    down = row(below, z, F.col("length"), F.col("distance") + F.col("length"), -1, F.col("share"), "DOWN")
    above = u.join(e, u["node"] == e["down"])
    up = row(above, z, F.col("length"), F.col("distance"), 1, F.col("share") * F.col("own"), "UP")
    out = own.unionByName(down).unionByName(up)
    if tree:
        # Other branches into every node on the way down, and all that lies above them.
        passed = below.select("station", F.col("edge").alias("via"), F.col("down").alias("node")).unionByName(p.select("station", F.col("edge").alias("via"), F.col("down").alias("node")))
        side = d.join(e, d["node"] == e["down"]).select("station", "node", "edge", "up", "length", "distance")
        side = cut(side.join(passed, (side["station"] == passed["station"]) & (side["node"] == passed["node"]) & (side["edge"] == passed["via"]), "left_anti"))
        first = row(side, z, F.col("length"), F.col("distance"), 1, z, "UNCONNECTED")
        more = graph.reach(edges, side.select("station", F.col("up").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), z.alias("share")), limit, "up")
        rest = row(more.join(e, more["node"] == e["down"]), z, F.col("length"), F.col("distance"), 1, z, "UNCONNECTED")
        out = out.unionByName(first).unionByName(rest)
    return out


def relate(targets: DataFrame, segments: DataFrame, limit_km: float) -> DataFrame:
    """(target, station, relation, distance, share): the closest record of every pair within the limit.

    targets: target, edge, t. An interval join, keyed by edge; connected records come before unconnected ones.
    """
    d = F.col("base") + F.col("slope") * F.col("t")
    j = targets.join(segments, "edge").where((F.col("t") >= F.col("lo") - 1e-6) & (F.col("t") <= F.col("hi") + 1e-6)).withColumn("distance", F.greatest(d, F.lit(0.0))).where(F.col("distance") <= limit_km * 1000)
    order = F.when(F.col("relation") == "DOWN", 0).when(F.col("relation") == "UP", 1).otherwise(2)
    best = j.groupBy("target", "station").agg(F.min_by(F.struct("relation", "distance", "share"), F.struct("distance", order)).alias("b"))
    return best.select("target", "station", "b.*")


def along_river(targets: DataFrame, relations: DataFrame, values: DataFrame, power: float = 2.0, decay_km: float | None = None) -> DataFrame:
    """(target, estimate, nearest_m, n_stations[, confidence]) from connected stations with a share.

    values: station, value. Targets without any are left out; drop a station's own pair for leave-one-out.
    """
    pairs = relations.where("relation <> 'UNCONNECTED' AND share > 0").join(values, "station").select("target", F.col("distance").alias("d"), "share", F.col("value").alias("s_value"), F.col("station").alias("s_id"))
    return interpolate.idw(targets.select("target").join(pairs, "target"), ["target"], power, F.col("share"), decay_km)


def is_tree(edges: DataFrame) -> bool:
    """Whether water never divides."""
    return edges.groupBy("up").count().where("count > 1").isEmpty()
