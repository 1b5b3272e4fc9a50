"""All interpolated surfaces of a table in one plan: limit, runs of both bounds, maps, validation and a summary.

Periods are all years and every year; a surface is a period and a parameter family, with a lower and an upper run. With
a river graph estimates are made along the water, every SPACING_M metres, and painted on the grid as ribbons; without
one, or for surfaces without a station on it, distances are straight and every cell is estimated. All surfaces are rows
of the same tables, never a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.functions import text as X
from hydroframe.operators import channels, interpolate, river, stats
from hydroframe.plans.io import cut

SPACING_M = 100.0
LEAST_DECAY_M = 1_000.0
BOUNDS = ("lower", "upper")
ON = ["period", "family"]
# What surfaces say about themselves.
NO_NETWORK = "No drain/river map was found near these stations, so distances are straight lines across land and stations on different channels influence each other."
OFF_NETWORK = "None of these stations lie on the river map, so distances are straight lines across land."
CANAL = "Canals run in rotation and can be dry; a canal sample reflects its source river only while the canal runs, so compare it with river samples from the same month or season."


@dataclass(frozen=True)
class Surfaces:
    """values: station intervals with positions; limits: the compared limits (none where it was given); cells: painted
    cells with lower, upper and confidence in percent; checks: leave-one-out errors per surface and bound; about: one
    row a surface; limit_km: None without limit."""

    values: DataFrame
    limits: DataFrame | None
    cells: DataFrame
    checks: DataFrame
    about: DataFrame
    limit_km: float | None


def placed_values(records: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """station_values() of the located numbers with the position of each station: the map's where it is given, else its
    first record's.

    records: row_id, station, family, variant, unit, year, value, latitude, longitude; positions: station, lat, lon.
    """
    r = records.where("value is not null and not isnan(value) and family <> '' and latitude between -90 and 90 and longitude between -180 and 180")
    first = r.groupBy("station").agg(F.min_by(F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), "row_id").alias("p")).select("station", "p.*")
    if positions is not None:
        on_map = positions.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("station", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        first = first.join(on_map, "station", "left").select("station", F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"))
    return stats.station_values(r, digits=12).join(first, "station").withColumnRenamed("station", "id")


def by_bound(values: DataFrame) -> DataFrame:
    """One row per surface, bound and station that has the bound."""
    both = F.inline(F.array(*(F.struct(F.lit(b).alias("bound"), F.col(b).alias("value")) for b in BOUNDS)))
    return values.select(*ON, "id", "lat", "lon", both).where("value is not null")


def no_limit_decay(bounds: DataFrame, relations: DataFrame | None) -> float:
    """Metres over which confidence fades without a limit: the longest distance between linked stations of a surface of
    three or more."""
    on = [*ON, "bound"]
    enough = bounds.groupBy(*on).count().where("count >= 3").select(*on)
    b = bounds.where("period = 'all_years'").join(enough, on, "left_semi")
    if relations is None:
        longest = interpolate.all_pairs(b, b, on).agg(F.max("d")).first()[0]
    else:
        pairs = b.select(*on, F.col("id").alias("target")).join(relations, "target").join(b.select(*on, F.col("id").alias("station")), [*on, "station"])
        longest = pairs.agg(F.max("distance")).first()[0]
    return max(longest or 0.0, LEAST_DECAY_M)


def _runs(pairs: DataFrame, by: list[str], power: float, share: bool, decay_km: float) -> DataFrame:
    """Lower, upper and confidence (the lesser of both runs) per by."""
    e = interpolate.idw(pairs, [*by, "bound"], power, F.col("share") if share else None, decay_km)
    of = lambda b, c: F.max(F.when(F.col("bound") == b, F.col(c)))
    return e.groupBy(*by).agg(of("lower", "estimate").alias("lower"), of("upper", "estimate").alias("upper"), F.min("confidence").alias("confidence"))


def interpolate_all(
    records: DataFrame, network: tuple[DataFrame, DataFrame, DataFrame] | None = None, positions: DataFrame | None = None, max_distance_km: float | str = "auto", power: float = 2.0, size: int = interpolate.GRID, reason: str | None = None,
) -> Surfaces:
    """Every surface of the records.

    network: (edges, positions on them, lines) as from river.build, or None with the reason why there is none.
    """
    interpolate.check_positive(power, "power")
    if max_distance_km != "auto":
        interpolate.check_positive(max_distance_km, "max_distance_km")
    values = cut(placed_values(records, positions))
    bounds = cut(by_bound(values))
    on = [*ON, "bound"]
    relations = at = edges = None
    if network is not None and not network[1].isEmpty():
        edges, at, lines = network
        segments = cut(river.flow_segments(edges, at, 1e9, river.is_tree(edges)))
        relations = cut(river.relate(at.select(F.col("station").alias("target"), "edge", "t"), segments, 1e9))
    on_map = values.select("id").distinct().join(at.select(F.col("station").alias("id")), "id", "left_semi") if at is not None else values.select("id").where("false")
    there = cut(bounds.join(on_map, "id", "left_semi"))
    scored = (bounds if at is None else there).where("period = 'all_years'")
    limits = None
    if max_distance_km == "auto":
        limits = cut(interpolate.choose_reach(scored.withColumn("surface", F.concat_ws(":", "family", "bound")), power, relations=relations))
        best = limits.where("chosen").first()
        limit_km = interpolate.FALLBACK_KM if best is None else None if best["reach_km"] < 0 else best["reach_km"]
    else:
        limit_km = float(max_distance_km)
    decay_km = limit_km if limit_km is not None else no_limit_decay(bounds if at is None else there, relations) / 1000
    n_points = values.groupBy(*ON).agg(F.count(F.lit(1)).alias("n_points"))
    single = n_points.where("n_points = 1").select(*ON)
    river_surfaces = there.select(*ON).distinct().join(single, ON, "left_anti")
    # Straight lines, where no station of a surface lies on the map: every cell.
    off = bounds.join(river_surfaces, ON, "left_anti").join(single, ON, "left_anti")
    box = interpolate.extent(off, ON, digits=12)
    grid = box.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    step = lambda a: (F.col(f"max_{a}") - F.col(f"min_{a}")) / (size - 1)
    grid = grid.select(*ON, "row", "col", (F.col("max_lat") - F.col("row") * step("lat")).alias("lat"), (F.col("min_lon") + F.col("col") * step("lon")).alias("lon"))
    sides = off.select(*ON, "bound", "id", "lat", "lon", "value")
    near = interpolate.all_pairs(grid, sides, ON) if limit_km is None else interpolate.near_pairs(grid, sides, limit_km, ON)
    cells = _runs(near.withColumnRenamed("s_bound", "bound"), [*ON, "row", "col"], power, False, decay_km)
    # Stations' own points; a surface of one station is nothing else.
    own = values.select(*ON, "id", "lat", "lon", "lower", "upper", F.lit(1.0).alias("confidence"), F.lit(True).alias("station"))
    lone = own.join(single, ON, "left_semi")
    painted = lone.drop("id")
    if at is not None:
        reach_m = 1e12 if limit_km is None else limit_km * 1000
        samples = channels.samples_along(edges, SPACING_M).select(F.concat_ws(":", "edge", "k").alias("target"), "edge", "t")
        r = river.relate(samples, segments, reach_m / 1000).where("relation <> 'UNCONNECTED' AND share > 0")
        pairs = r.join(there.select(*ON, "bound", F.col("id").alias("station"), F.col("value").alias("s_value")), "station").select(*ON, "bound", "target", F.col("station").alias("s_id"), F.col("distance").alias("d"), "share", "s_value")
        along = _runs(pairs.join(single, ON, "left_anti"), [*ON, "target"], power, True, decay_km)
        points = along.join(river.locate(samples, edges, lines).select("target", "lat", "lon"), "target")
        painted = painted.unionByName(points.select(*ON, "lat", "lon", "lower", "upper", "confidence", F.lit(False).alias("station")))
        painted = painted.unionByName(own.join(on_map, "id", "left_semi").join(river_surfaces, ON, "left_semi").drop("id"))
    painted = cut(painted)
    ribbons = interpolate.paint(painted, interpolate.extent(painted, ON, digits=12), size, ON, ("lower", "upper", "confidence"))
    shown = ["lower", "upper"]
    out = cells.select(*ON, "row", "col", *(F.round(c, 4).alias(c) for c in shown), "confidence").unionByName(ribbons.select(*ON, "row", "col", *shown, "confidence"))
    out = out.where("lower is not null or upper is not null").withColumn("confidence", F.rint(F.col("confidence") * 100).cast("int"))
    loo = interpolate.leave_one_out(off, limit_km, power, on)
    if at is not None:
        loo = loo.unionByName(interpolate.leave_one_out(there.join(river_surfaces, ON, "left_semi"), limit_km, power, on, relations))
    checks = interpolate.validation(loo, on)
    return Surfaces(values, limits, out, checks, _about(values, n_points, river_surfaces, on_map, edges, at, reason), limit_km)


def _about(values: DataFrame, n_points: DataFrame, river_surfaces: DataFrame, on_map: DataFrame, edges: DataFrame | None, at: DataFrame | None, reason: str | None) -> DataFrame:
    """One row a surface: method, points, unit, whether it is an interval, and its warning."""
    canal = at.join(edges.where("canal"), "edge").select(F.col("station").alias("id"), F.lit(True).alias("canal")) if at is not None else on_map.withColumn("canal", F.lit(True))
    v = values.join(on_map.withColumn("there", F.lit(True)), "id", "left").join(canal, "id", "left")
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("id").cast("string")))), ", ")
    g = v.groupBy(*ON).agg(
        F.min_by("unit", "id").alias("unit"), F.max((F.col("kind") != "reading").cast("int")).alias("interval"), F.count("there").alias("n_there"), F.max("canal").alias("canal"), listed(F.col("there").isNull()).alias("left_out"), listed(F.col("kind") == "max only").alias("only_max"), listed(F.col("kind") == "min only").alias("only_min")
    )
    g = g.join(n_points, ON).join(river_surfaces.withColumn("river", F.lit(True)), ON, "left")
    method = F.when(F.col("n_points") == 1, "single").when(F.col("river"), "river_idw").otherwise("straight_idw")
    none = NO_NETWORK + (f" ({reason})" if reason else "")
    parts = [
        F.when(F.col("river") & (F.col("left_out") != ""), F.concat((F.col("n_points") - F.col("n_there")).cast("string"), F.lit(" station(s) are not on the river map and were left out: "), F.col("left_out"), F.lit("."))),
        F.when(F.col("river") & F.col("canal"), CANAL), F.when(method == "straight_idw", OFF_NETWORK if at is not None else none),
        F.when(F.col("only_max") != "", F.concat(F.lit("Only a Max is reported at "), "only_max", F.lit(", so it counts for the upper bound only."))),
        F.when(F.col("only_min") != "", F.concat(F.lit("Only a Min is reported at "), "only_min", F.lit(", so it counts for the lower bound only."))),
    ]
    return g.select(*ON, method.alias("method"), "n_points", F.when(method == "river_idw", F.col("n_there")).otherwise(F.col("n_points")).alias("n_used"), "unit", (F.col("interval") == 1).alias("interval"), F.nullif(F.concat_ws(" ", *parts), F.lit("")).alias("warning"))


def summary(s: Surfaces) -> DataFrame:
    """One row: surfaces of all years and of years, parameters, methods used, limit and how it was chosen, mapped
    stations, and warnings."""
    a = s.about
    every = a.agg(
        F.count_if(F.col("period") == "all_years").alias("all_year_surfaces"), F.count_if(F.col("period") != "all_years").alias("yearly_surfaces"), F.array_sort(F.collect_set("family")).alias("parameters"),
        F.array_sort(F.collect_set(F.when(F.col("period") == "all_years", F.col("method")))).alias("methods"), F.array_sort(F.collect_set("warning")).alias("warnings"),
    )
    stations = s.values.agg(F.countDistinct("id").alias("mapped_stations"))
    chosen = "fixed" if s.limits is None else "auto"
    limit = F.lit(s.limit_km).cast("double") if s.limit_km is not None else F.lit(None).cast("double")
    # Two rows of one.
    return every.join(F.broadcast(stations)).select("*", limit.alias("limit_km"), F.lit(chosen).alias("limit_chosen"))


def surface_for(about: DataFrame, parameter_family: str, exact: str | None = None, year: int | None = None, fall_back: bool = False) -> DataFrame:
    """The (period, family) to show for a parameter: the exact name before its family, of the year, or of all years
    (also where the year has none, if fall_back)."""
    wanted = F.when(F.lower("family") == (exact or parameter_family).lower(), 0).when(F.lower("family") == parameter_family.lower(), 1)
    period = F.when(F.col("period") == ("all_years" if year is None else str(year)), 0)
    if fall_back:
        period = period.when(F.col("period") == "all_years", 1)
    ranked = about.withColumn("_r", F.struct(period.alias("p"), wanted.alias("w"), "family")).where(period.isNotNull() & wanted.isNotNull())
    return ranked.agg(F.min_by(F.struct("period", "family"), "_r").alias("b")).where("b is not null").select("b.*")


def figure_table(cells: DataFrame, box: DataFrame, bound: str = "upper", size: int = interpolate.GRID) -> DataFrame:
    """The painted cells of surfaces with their position, the value of one bound, and its place on the ramp of its surface."""
    if bound not in BOUNDS:
        raise ValueError("bound is lower or upper")
    step = lambda a: (F.col(f"max_{a}") - F.col(f"min_{a}")) / (size - 1)
    ends = cells.groupBy(*ON).agg(F.min(bound).alias("low"), F.max(bound).alias("high"))
    j = cells.where(F.col(bound).isNotNull()).join(box, ON).join(ends, ON)
    lat, lon = F.col("max_lat") - F.col("row") * step("lat"), F.col("min_lon") + F.col("col") * step("lon")
    return j.select(*ON, "row", "col", lat.alias("lat"), lon.alias("lon"), F.col(bound).alias("value"), "confidence", X.ramp_position(F.col(bound), F.col("low"), F.col("high")).alias("position"))


def probe(cells: DataFrame, box: DataFrame, points: DataFrame, size: int = interpolate.GRID) -> DataFrame:
    """points (id, lat, lon) with the values of the cell they lie in on every surface; box as from extent(), by surface."""
    dy, dx = (F.col("max_lat") - F.col("min_lat")) / (size - 1), (F.col("max_lon") - F.col("min_lon")) / (size - 1)
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))
    # A box is a row a surface; points meet boxes by the degree they lie in.
    degrees = lambda a: F.explode(F.sequence(F.floor(F.col(f"min_{a}")), F.floor(F.col(f"max_{a}"))))
    filed = box.withColumn("_y", degrees("lat")).withColumn("_x", degrees("lon"))
    met = points.withColumn("_y", F.floor("lat")).withColumn("_x", F.floor("lon")).join(filed, ["_y", "_x"]).where(inside)
    at = met.select("id", *ON, F.rint((F.col("max_lat") - F.col("lat")) / dy).cast("int").alias("row"), F.rint((F.col("lon") - F.col("min_lon")) / dx).cast("int").alias("col"))
    return at.join(cells, [*ON, "row", "col"], "left")
