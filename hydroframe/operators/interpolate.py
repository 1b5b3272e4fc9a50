"""Straight-line and along-channel interpolation: weighting, validation, choice of reach, grids and kriging.

Stations and targets meet through grid cells of the reach's size, not in a cross join; only searches without a
reach pair every target with every station: grids in arrays, in blocks of stations, others as rows, where the station
side is small (checked by MAX_STATIONS).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hydroframe.functions import text as X

#: Stations of one surface that a search without limit, or a dense solve, may have.
MAX_STATIONS = 5_000
REACHES_KM: tuple[float | None, ...] = (2.0, 4.0, 8.0, 16.0, 32.0, None)
FALLBACK_KM = 8.0
GRID = 192
#: Rows of a grid that one call estimates, and places that it looks at together.
BAND, PLACES = 8, 2_048
LEAST_SPAN, PAD = 0.01, 0.08
RANGE_FACTORS, NUGGETS = (0.5, 1.0, 2.0, 4.0), (0.1, 0.3, 0.6)
# Parts of tail-up, tail-down and straight-line correlation in the mixed models.
MIXES = ((0.5, 0.5, 0.0), (0.5, 0.0, 0.5), (0.0, 0.5, 0.5), (1 / 3, 1 / 3, 1 / 3), (0.6, 0.2, 0.2), (0.2, 0.6, 0.2), (0.2, 0.2, 0.6))
MIN_KRIGING = 50


def check_positive(value: float, name: str) -> float:
    """A positive finite number that is no truth value."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be a positive number")
    return float(value)


def near_pairs(targets: DataFrame, stations: DataFrame, limit_km: float, on: Sequence[str] = ()) -> DataFrame:
    """(target columns, station columns prefixed s_, d): all within limit_km metres by the great circle.

    Cells are as high as the limit; a target looks into the cells that its limit reaches at its latitude.
    """
    step = limit_km * 1000 / X.DEGREE_M
    row = lambda c: F.floor(F.col(c) / step)
    band = F.greatest(F.cos(F.radians((F.abs(F.col("_r")) + 1) * step)), F.lit(0.02))
    col = lambda c: F.floor(F.col(c) * band / step)
    s = stations.select(*on, *(F.col(c).alias(f"s_{c}") for c in stations.columns if c not in on)).withColumn("_r", row("s_lat"))
    s = s.withColumn("_c", col("s_lon"))
    t = targets.withColumn("_r", F.explode(F.sequence(row("lat") - 1, row("lat") + 1)))
    t = t.withColumn("_c", F.explode(F.sequence(col("lon") - 1, col("lon") + 1)))
    d = X.haversine_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    return t.join(s, [*on, "_r", "_c"]).drop("_r", "_c").withColumn("d", d).where(F.col("d") <= limit_km * 1000)


def all_pairs(targets: DataFrame, stations: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every target with every station of its surface; refused where a surface has more than MAX_STATIONS."""
    most = stations.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    if most > MAX_STATIONS:
        raise ValueError(f"a surface without limit has at most {MAX_STATIONS} stations")
    s = stations.select(*on, *(F.col(c).alias(f"s_{c}") for c in stations.columns if c not in on))
    return targets.join(s, list(on)).withColumn("d", X.haversine_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")))


def idw(pairs: DataFrame, by: Sequence[str], power: float = 2.0, share: Column | None = None, decay_km: float | None = None) -> DataFrame:
    """Inverse-distance estimate per target: weights share / km^power, a station closer than 1 m decides alone."""
    share = F.lit(1.0) if share is None else share
    weight = share / F.pow(F.greatest(F.col("d"), F.lit(1.0)) / 1000, F.lit(power))
    aggregates = [F.min("d").alias("nearest_m"), F.min_by("s_value", F.struct("d", "s_id")).alias("exact"), (F.sum(weight * F.col("s_value")) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).alias("n_stations")]
    if decay_km:
        aggregates.append(F.max(share * F.exp(-3 * F.col("d") / (decay_km * 1000))).alias("confidence"))
    g = pairs.groupBy(*by).agg(*aggregates)
    return g.withColumn("estimate", F.when(F.col("nearest_m") < 1, F.col("exact")).otherwise(F.col("mean"))).drop("exact", "mean")


def leave_one_out(stations: DataFrame, limit_km: float | None, power: float = 2.0, on: Sequence[str] = ("surface",), relations: DataFrame | None = None) -> DataFrame:
    """Each station with the estimate of the others within the limit, null where none is, and the others' mean; along
    the water where relations are given."""
    check_positive(power, "power")
    if limit_km is not None:
        check_positive(limit_km, "limit_km")
    stations = stations.select(*on, "id", "lat", "lon", "value")
    if relations is not None:
        pairs = linked_pairs(stations, relations, on).where(F.lit(True) if limit_km is None else F.col("d") <= limit_km * 1000)
    else:
        pairs = (all_pairs(stations, stations, on) if limit_km is None else near_pairs(stations, stations, limit_km, on)).where(F.col("id") != F.col("s_id"))
    e = idw(pairs, [*on, "id"], power, None if relations is None else F.col("share")).select(*on, "id", "estimate", "n_stations")
    totals = stations.groupBy(*on).agg(F.sum("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = stations.join(totals, list(on)).join(e, [*on, "id"], "left")
    return j.withColumn("others_mean", F.try_divide(F.col("_s") - F.col("value"), F.col("_n") - 1)).drop("_s", "_n")


def validation(loo: DataFrame, on: Sequence[str] = ("surface",), digits: int = 4) -> DataFrame:
    """rmse, mae, baseline rmse and skill per surface over the stations that could be estimated."""
    e, b = F.col("estimate") - F.col("value"), F.col("others_mean") - F.col("value")
    g = loo.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_stations"), F.count("estimate").alias("n_checked"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(F.when(F.col("estimate").isNotNull(), b * b))).alias("baseline_rmse")
    )
    skill = F.round(1 - F.try_divide(F.col("rmse"), F.col("baseline_rmse")), 3)
    return g.select(*on, "n_stations", "n_checked", *(F.round(c, digits).alias(c) for c in ("rmse", "mae", "baseline_rmse")), skill.alias("skill"))


def linked_pairs(stations: DataFrame, relations: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every station of a surface with the others that flow connects it with: id, s_id, s_value, d, share."""
    mine = stations.select(*on, "id").join(relations.where("relation <> 'UNCONNECTED' AND share > 0 AND target <> station"), F.col("id") == F.col("target"))
    return mine.select(*on, "id", F.col("station").alias("s_id"), F.col("distance").alias("d"), "share").join(stations.select(*on, F.col("id").alias("s_id"), F.col("value").alias("s_value")), [*on, "s_id"])


def choose_reach(stations: DataFrame, power: float = 2.0, reaches: Sequence[float | None] = REACHES_KM, on: Sequence[str] = ("surface",), relations: DataFrame | None = None) -> DataFrame:
    """(reach_km, n_surfaces, score, baseline, chosen): rmse over the population deviation, averaged over surfaces.

    Distances are straight, or along the water where relations (target, station, relation, distance, share) are given.

    Surfaces count with three stations and some spread; a station without estimate counts with the others' mean. All
    limits are searched in one pass at the widest finite one; errors are compared after rounding, ties go to the
    shorter reach; without any surface the fallback is chosen.
    """
    st = stations.select(*on, "id", "lat", "lon", "value")
    check_positive(power, "power")
    finite = [check_positive(r, "reach") for r in reaches if r is not None]
    share = None if relations is None else F.col("share")
    every_pair = None if relations is None else linked_pairs(st, relations, on)
    parts = near_pairs(st, st, max(finite), on).where(F.col("id") != F.col("s_id")) if every_pair is None else every_pair
    wide = parts.withColumn("reach_km", F.explode(F.array(*map(F.lit, finite)))).where(F.col("d") <= F.col("reach_km") * 1000)
    e = idw(wide, [*on, "id", "reach_km"], power, share)
    if None in reaches:
        far = idw(all_pairs(st, st, on).where(F.col("id") != F.col("s_id")) if every_pair is None else every_pair, [*on, "id"], power, share).withColumn("reach_km", F.lit(-1.0))
        e = e.unionByName(far)
    stats = st.groupBy(*on).agg(F.sum("value").alias("_s"), F.count(F.lit(1)).alias("_n"), F.stddev_pop("value").alias("_sd")).where("_n >= 3 and _sd > 0")
    every = st.join(stats, list(on)).withColumn("reach_km", F.explode(F.array(*(F.lit(-1.0 if r is None else float(r)) for r in reaches))))
    every = every.withColumn("others", (F.col("_s") - F.col("value")) / (F.col("_n") - 1)).join(e.select(*on, "id", "reach_km", "estimate"), [*on, "id", "reach_km"], "left")
    g = every.groupBy(*on, "reach_km").agg(
        (F.sqrt(F.avg(F.pow(F.coalesce("estimate", "others") - F.col("value"), F.lit(2)))) / F.first("_sd")).alias("e"), (F.sqrt(F.avg(F.pow(F.col("others") - F.col("value"), F.lit(2)))) / F.first("_sd")).alias("b")
    )
    scores = g.groupBy("reach_km").agg(F.count(F.lit(1)).alias("n_surfaces"), F.round(F.avg("e"), 4).alias("score"), F.round(F.avg("b"), 4).alias("baseline"))
    order = F.row_number().over(W.orderBy("score", F.when(F.col("reach_km") < 0, 1e9).otherwise(F.col("reach_km"))))
    return scores.withColumn("chosen", order == 1).withColumn("beats_baseline", F.col("score") < F.col("baseline"))


def extent(stations: DataFrame, on: Sequence[str] = ("surface",), digits: int = 6) -> DataFrame:
    """Padded box per surface: widened to 0.01 degrees where it is less, then 8 % more on each side, clamped to Earth."""
    g = stations.groupBy(*on).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))))
    out = list(on)
    for c, edge in (("lat", 90.0), ("lon", 180.0)):
        low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
        span = F.greatest(high - low, F.lit(LEAST_SPAN))
        half = span * (0.5 + PAD)
        narrow = high - low < LEAST_SPAN
        low, high = F.when(narrow, (low + high) / 2 - half).otherwise(low - span * PAD), F.when(narrow, (low + high) / 2 + half).otherwise(high + span * PAD)
        out += [F.round(F.greatest(low, F.lit(-edge)), digits).alias(f"min_{c}"), F.round(F.least(high, F.lit(edge)), digits).alias(f"max_{c}")]
    return g.select(*out)


def grid(stations: DataFrame, size: int = GRID, limit_km: float | None = None, power: float = 2.0, on: Sequence[str] = ("surface",), digits: int = 4) -> DataFrame:
    """Estimated cells of all surfaces in one job; row 0 is the northern edge. Cells without estimate are left out."""
    check_positive(power, "power")
    if limit_km is not None:
        check_positive(limit_km, "limit_km")
    st = stations.select(*on, "id", "lat", "lon", "value")
    if limit_km is None:
        found = _unlimited_grid(st, size, float(power), on)
    else:
        cells = extent(st, on).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        cells = cells.select(*on, "row", "col", (F.col("max_lat") - F.col("row") * (F.col("max_lat") - F.col("min_lat")) / (size - 1)).alias("lat"), (F.col("min_lon") + F.col("col") * (F.col("max_lon") - F.col("min_lon")) / (size - 1)).alias("lon"))
        found = idw(near_pairs(cells, st, limit_km, on), [*on, "row", "col"], power)
    return found.select(*on, "row", "col", F.round("estimate", digits).alias("estimate"), F.round("nearest_m", 1).alias("nearest_m"))


def _unlimited_grid(st: DataFrame, size: int, power: float, on: Sequence[str]) -> DataFrame:
    """(on, row, col, estimate, nearest_m) of every cell from all stations of its surface, in arrays per band of rows.

    Stations at one position have one distance, so their values are summed first. Within a band distances are made of
    parts that depend on the row or the column alone; stations come in blocks, so any number of them is worked through.
    """
    own = F.col("value").cast("double")
    places = st.where(" and ".join(f"`{c}` is not null" for c in on)).groupBy(*on, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    places = places.agg(F.sum(own).alias("_sum"), F.count(F.lit(1)).cast("double").alias("_n"), F.min(F.when(own.isNotNull(), F.struct("id", own.alias("value")))).alias("_first"))
    # Of places equally near, the one with the smallest id decides, so they come in its order.
    bands = places.join(extent(st, on), list(on)).withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit((size - 1) // BAND))))
    kinds = dict(st.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("_id", "ascending")], null_placement="at_end"))
        lat, lon, total, n, first = (t.column(c).to_numpy().astype(float) for c in ("lat", "lon", "_sum", "_n", "_value"))
        low, high, west, east = (float(t.column(c)[0].as_py() if t.column(c)[0].is_valid else math.nan) for c in ("min_lat", "max_lat", "min_lon", "max_lon"))
        valued = t.column("_value").is_valid().to_numpy()
        total = np.where(t.column("_sum").is_valid().to_numpy(), total, 0.0)
        band = t.column("_band")[0].as_py()
        rows = np.arange(band * BAND, min((band + 1) * BAND, size))
        la, lo = np.radians(lat), np.radians(lon)
        row_la = np.radians(high - rows * (high - low) / max(size - 1, 1))
        col_lo = np.radians(west + np.arange(size) * (east - west) / max(size - 1, 1))
        estimate, nearest = np.empty((len(rows), size)), np.empty((len(rows), size))
        for k, r in enumerate(row_la):
            up, down, least, best, exact = np.zeros(size), np.zeros(size), np.full(size, np.inf), np.full(size, np.inf), np.full(size, np.nan)
            for at in range(0, len(la), PLACES):
                b = slice(at, at + PLACES)
                h = np.sin((la[b] - r) / 2)[:, None] ** 2 + (np.cos(r) * np.cos(la[b]))[:, None] * np.sin((lo[b, None] - col_lo) / 2) ** 2
                d = 2 * X.EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
                w = np.fmax(d, 1.0) / 1000
                w = 1 / (w * w) if power == 2 else w**-power
                up += total[b] @ w
                down += n[b] @ w
                least = np.fmin(least, np.fmin.reduce(d, axis=0))
                near = np.where(valued[b, None] & np.isfinite(d), d, np.inf)
                i = near.argmin(0)
                closer = near[i, np.arange(size)] < best
                best, exact = np.where(closer, near[i, np.arange(size)], best), np.where(closer, first[b][i], exact)
            estimate[k], nearest[k] = np.where(least < 1, exact, up / down), least
        cells = len(rows) * size
        none = (nearest < 1) & np.isnan(estimate) if valued.any() else np.ones(estimate.shape, bool)
        names = {c: t.column(c).combine_chunks().take(pa.array(np.zeros(cells, np.int64))) for c in on}
        found = {"estimate": pa.array(estimate.ravel(), mask=none.ravel()), "nearest_m": pa.array(nearest.ravel(), mask=~np.isfinite(nearest.ravel()))}
        return pa.table({**names, "row": pa.array(np.repeat(rows, size).astype(np.int32)), "col": pa.array(np.tile(np.arange(size, dtype=np.int32), len(rows))), **found})

    bands = bands.select(*on, "_band", "lat", "lon", "_sum", "_n", F.col("_first.id").alias("_id"), F.col("_first.value").alias("_value"), "min_lat", "max_lat", "min_lon", "max_lon")
    # By number, as the rows are few and would be merged into one task.
    spread = bands.repartition(max(int(st.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), *on, "_band")
    return spread.groupBy(*on, "_band").applyInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in on), "row int, col int, estimate double, nearest_m double"]))


def covariance(model: str, share: np.ndarray, linked: np.ndarray, d: np.ndarray, straight: np.ndarray, reach: float, mix: tuple[float, float, float]) -> np.ndarray:
    """Correlation of the exponential models: tail-up needs flow, tail-down any link, mixed adds the straight line."""
    up = np.where(share > 0, np.sqrt(share) * np.exp(-3 * np.where(linked, d, 0) / reach), 0.0)
    down = np.where(linked, np.exp(-3 * np.where(linked, d, 0) / reach), 0.0)
    return {"tail_up": up, "tail_down": down, "straight": np.exp(-3 * straight / reach), "mixed": mix[0] * up + mix[1] * down + mix[2] * np.exp(-3 * straight / reach)}[model]


def krige(cov: np.ndarray, values: np.ndarray, target: np.ndarray, sill: float, nugget: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, variances) of ordinary kriging; target has a row per target, cov the stations' sills on its diagonal."""
    n = len(values)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n], system[n, :n], system[:n, n] = cov, 1.0, 1.0
    right = np.vstack([target.T, np.ones(len(target))])
    w = np.linalg.solve(system, right)
    return w[:n].T @ values, np.maximum(sill + nugget - (w[:n] * right[:n]).sum(0) - w[n], 0.0)


def fit_kriging(lat: np.ndarray, lon: np.ndarray, values: np.ndarray) -> dict[str, object] | None:
    """The straight-line model with the least leave-one-out error; None where the values have no spread."""
    la, lo = np.radians(lat), np.radians(lon)
    a = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    d = 2 * X.EARTH_M * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
    variance = float(values.var(ddof=1)) if len(values) > 1 else 0.0
    if not variance > 0:
        return None
    middle = float(np.median(d[d > 0])) if (d > 0).any() else 1.0
    best: dict[str, object] | None = None
    for factor in RANGE_FACTORS:
        shape = np.exp(-3 * d / (middle * factor))
        for nugget in NUGGETS:
            sill = variance * (1 - nugget)
            cov = shape * sill + np.eye(len(values)) * variance * nugget
            try:
                inverse = np.linalg.inv(np.block([[cov, np.ones((len(values), 1))], [np.ones((1, len(values))), np.zeros((1, 1))]]))
            except np.linalg.LinAlgError:
                continue
            # Leaving out one row of the system: the residual is the dual weight over the inverse's diagonal.
            loo = values - (inverse[:-1, :-1] @ values) / np.diag(inverse)[:-1]
            rmse = float(np.sqrt(np.mean((loo - values) ** 2)))
            if best is None or rmse < best["rmse"]:
                best = {"rmse": rmse, "range_km": middle * factor / 1000, "nugget": nugget, "loo": loo}
    return best


def kriging(stations: DataFrame, least: int = MIN_KRIGING, on: Sequence[str] = ("surface",)) -> DataFrame:
    """Per surface: number of stations, fitted range, nugget share, leave-one-out rmse; null with a note below least.

    A surface is one dense solve, so it is refused beyond MAX_STATIONS.
    """
    most = stations.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    if most > MAX_STATIONS:
        raise ValueError(f"a dense solve has at most {MAX_STATIONS} stations")
    names = [f"{f.name} {f.dataType.simpleString()}" for f in stations.select(*on).schema.fields]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        model = fit_kriging(f["lat"].to_numpy(float), f["lon"].to_numpy(float), f["value"].to_numpy(float)) if len(f) >= least else None
        note = None if model else (f"at least {least} stations are needed" if len(f) < least else "no spread")
        row = {**{k: f[k].iloc[0] for k in on}, "n": len(f), "range_km": model and round(model["range_km"], 3), "nugget": model and model["nugget"], "rmse": model and round(model["rmse"], 4), "note": note}
        return pd.DataFrame([row])

    return stations.groupBy(*on).applyInPandas(run, ", ".join([*names, "n int, range_km double, nugget double, rmse double, note string"]))


def fit_river_kriging(d: np.ndarray, share: np.ndarray, linked: np.ndarray, straight: np.ndarray, values: np.ndarray, model: str, limit_m: float) -> dict[str, object] | None:
    """The parameters of one covariance model with the least leave-one-out error; None where nothing fits.

    d, share and linked relate stations along the water, straight by the great circle. A station without support
    within the limit (flow for tail_up, any link otherwise) has no estimate.
    """
    variance = float(values.var(ddof=1)) if len(values) > 1 else 0.0
    off = ~np.eye(len(values), dtype=bool)
    known = d[off & linked & (d > 0)]
    if not variance > 0 or not len(known):
        return None
    support = ((share > 0) if model == "tail_up" else linked) & off & (d <= limit_m)
    mixes = MIXES if model == "mixed" else [(0.0, 0.0, 0.0)]
    best: dict[str, object] | None = None
    for factor in RANGE_FACTORS:
        reach = float(np.median(known)) * factor
        for mix in mixes:
            shape = covariance(model, share, linked, d, straight, reach, mix)
            shape = (shape + shape.T) / 2
            for nugget in NUGGETS:
                cov = shape * variance * (1 - nugget)
                np.fill_diagonal(cov, variance)
                n = len(values)
                try:
                    inverse = np.linalg.inv(np.block([[cov, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]]))
                except np.linalg.LinAlgError:
                    continue
                loo = values - (inverse[:n, :n] @ values) / np.diag(inverse)[:n]
                loo = np.where(support.any(1), loo, np.nan)
                if not np.isfinite(loo).any():
                    continue
                rmse = float(np.sqrt(np.nanmean((loo - values) ** 2)))
                if best is None or rmse < best["rmse"]:
                    best = {"rmse": rmse, "range_km": reach / 1000, "nugget": nugget, "mix": mix, "loo": loo}
    return best


def krige_targets(stations: DataFrame, relations: DataFrame, targets: DataFrame, model: str, limit_km: float = 1e6, on: str = "surface") -> DataFrame:
    """(surface, target, estimate, confidence) by the fitted river model of every surface: confidence is one less the
    share of the standard deviation that is left, and a target without support within the limit has neither.

    stations: surface, id, lat, lon, value; relations: target, station, distance, share among stations and from targets
    to stations; targets: target, lat, lon. A surface is one dense solve of at most MAX_STATIONS stations; its targets
    come in parts, so any number of them is worked through.
    """
    most = stations.groupBy(on).count().agg(F.max("count")).first()[0] or 0
    if most > MAX_STATIONS:
        raise ValueError(f"a dense solve has at most {MAX_STATIONS} stations")
    kinds, kind_t = dict(stations.dtypes), dict(targets.dtypes)["target"]
    inner = stations.select(on, F.col("id").alias("target")).join(relations, "target").join(stations.select(on, F.col("id").alias("station")), [on, "station"])
    own = stations.join(inner.groupBy(on, F.col("target").alias("id")).agg(F.collect_list(F.struct("station", "distance", "share")).alias("pairs")), [on, "id"], "left")
    solved = own.groupBy(on).agg(F.sort_array(F.collect_list(F.struct("id", "lat", "lon", "value", "pairs"))).alias("all"))
    outer = targets.join(relations.select(F.col("target"), "station", "distance", "share"), "target").join(stations.select(on, F.col("id").alias("station")), "station")
    asked = outer.groupBy(on, "target", "lat", "lon").agg(F.collect_list(F.struct("station", "distance", "share")).alias("pairs"))

    def matrices(rows: list, pairs: list, at: dict) -> tuple[np.ndarray, np.ndarray]:
        d, share = np.full((len(rows), len(at)), np.inf), np.zeros((len(rows), len(at)))
        for i, ps in enumerate(pairs):
            for p in ps if ps is not None else []:
                if p["station"] in at:
                    d[i, at[p["station"]]], share[i, at[p["station"]]] = p["distance"], p["share"]
        return d, share

    def straight(lat: np.ndarray, lon: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
        la, lo, la2, lo2 = map(np.radians, (lat, lon, lat2, lon2))
        a = np.sin((la[:, None] - la2) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la2) * np.sin((lo[:, None] - lo2) / 2) ** 2
        return 2 * X.EARTH_M * np.arcsin(np.sqrt(np.clip(a, 0, 1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits: dict = {}
        for f in frames:
            for name, part in f.groupby(on):
                if name not in fits:
                    all_ = part["all"].iloc[0]
                    at = {r["id"]: i for i, r in enumerate(all_)}
                    v, lat, lon = (np.array([r[c] for r in all_], float) for c in ("value", "lat", "lon"))
                    d, share = matrices(all_, [r["pairs"] for r in all_], at)
                    np.fill_diagonal(d, 0)
                    np.fill_diagonal(share, 1)
                    away = straight(lat, lon, lat, lon)
                    fits[name] = at, v, lat, lon, d, share, away, fit_river_kriging(np.where(np.isfinite(d), d, 0.0), share, np.isfinite(d), away, v, model, limit_km * 1000)
                at, v, lat, lon, d, share, away, fit = fits[name]
                if fit is None:
                    continue
                variance = float(v.var(ddof=1))
                sill, nugget = variance * (1 - fit["nugget"]), variance * fit["nugget"]
                cov = covariance(model, share, np.isfinite(d), d, away, fit["range_km"] * 1000, fit["mix"])
                cov = (cov + cov.T) / 2 * sill
                np.fill_diagonal(cov, variance)
                td, tshare = matrices(list(part["target"]), list(part["pairs"]), at)
                to = covariance(model, tshare, np.isfinite(td), td, straight(part["lat"].to_numpy(float), part["lon"].to_numpy(float), lat, lon), fit["range_km"] * 1000, fit["mix"]) * sill
                estimate, left = krige(cov, v, to, sill, nugget)
                ok = ((tshare > 0 if model == "tail_up" else np.isfinite(td)) & (td <= limit_km * 1000)).any(1)
                out = pd.DataFrame({on: part[on].to_numpy(), "target": part["target"].to_numpy(), "estimate": estimate, "confidence": np.clip(1 - np.sqrt(left / variance), 0, 1)})
                yield out[ok]

    return asked.join(solved, on).mapInPandas(run, f"{on} {kinds[on]}, target {kind_t}, estimate double, confidence double")


def choose_method(relations: DataFrame, stations: DataFrame, limit_km: float = 1e6, power: float = 2.0, least: int = MIN_KRIGING, on: str = "surface") -> DataFrame:
    """Per surface the method with the least error on the stations that all can estimate; ties go to river_idw.

    relations: target, station, relation, distance, share among stations; stations: surface, id, lat, lon, value. A
    surface is one dense solve of at most MAX_STATIONS stations.
    """
    most = stations.groupBy(on).count().agg(F.max("count")).first()[0] or 0
    if most > MAX_STATIONS:
        raise ValueError(f"a dense solve has at most {MAX_STATIONS} stations")
    kinds = dict(stations.dtypes)
    r = stations.select(on, F.col("id").alias("target")).join(relations, "target").select(on, F.struct("target", "station", "distance", "share").alias("r")).groupBy(on).agg(F.collect_list("r").alias("pairs"))
    rows = stations.join(r, on, "left").select(on, "id", "lat", "lon", "value", "pairs")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id").reset_index(drop=True)
        n, at = len(f), {k: i for i, k in enumerate(f["id"])}
        v = f["value"].to_numpy(float)
        d, share = np.full((n, n), np.inf), np.zeros((n, n))
        pairs = f["pairs"].iloc[0]
        for p in pairs if pairs is not None else []:
            if p["target"] in at and p["station"] in at:
                i, j = at[p["target"]], at[p["station"]]
                d[i, j], share[i, j] = p["distance"], p["share"]
        np.fill_diagonal(d, 0)
        np.fill_diagonal(share, 1)
        linked = np.isfinite(d)
        la, lo = np.radians(f["lat"].to_numpy(float)), np.radians(f["lon"].to_numpy(float))
        a = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
        straight = 2 * X.EARTH_M * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
        off = ~np.eye(n, dtype=bool)
        w = np.where(off & (share > 0) & (d <= limit_km * 1000), share / (np.maximum(np.where(linked, d, 1), 1) / 1000) ** power, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            found = {"river_idw": (w @ v) / w.sum(1)}
        note = None
        if n < least:
            note = f"at least {least} stations are needed"
        else:
            for model in ("tail_up", "tail_down", "mixed"):
                fit = fit_river_kriging(np.where(linked, d, 0.0), share, linked, straight, v, model, limit_km * 1000)
                if fit:
                    found[model] = fit["loo"]
        common = np.logical_and.reduce([np.isfinite(x) for x in found.values()])
        errors = {k: float(np.sqrt(np.mean((x[common] - v[common]) ** 2))) for k, x in found.items()} if common.any() else {}
        out = [(f[on].iloc[0], k, n, int(common.sum()), round(e, 4), note) for k, e in errors.items()]
        best = min(out, key=lambda x: (x[4], x[1] != "river_idw"))[1] if out else None
        return pd.DataFrame([(*x, x[1] == best) for x in out], columns=[on, "method", "n_stations", "n_common", "rmse", "note", "chosen"])

    return rows.groupBy(on).applyInPandas(run, f"{on} {kinds[on]}, method string, n_stations int, n_common int, rmse double, note string, chosen boolean")


def paint(points: DataFrame, box: DataFrame, size: int = GRID, on: Sequence[str] = ("surface",), columns: Sequence[str] = ("estimate",)) -> DataFrame:
    """(surface, row, col, columns, gap_m): estimated points along channels as ribbons on the grid of each surface.

    A ribbon is at least 200 m or three quarters of a cell wide to either side; the nearest point gives a cell its
    values, a station's own point first. points: surface, lat, lon, columns, station (bool); box as from extent().
    """
    p = points.join(box, list(on))
    dy, dx = (F.col("max_lat") - F.col("min_lat")) / (size - 1), (F.col("max_lon") - F.col("min_lon")) / (size - 1)
    k = F.cos(F.radians((F.col("max_lat") + F.col("min_lat")) / 2))
    p = p.withColumn("cy", dy * X.DEGREE_M).withColumn("cx", dx * X.DEGREE_M * k).withColumn("half", F.greatest(F.lit(200.0), 0.75 * F.greatest("cy", "cx")))
    p = p.withColumn("fr", (F.col("max_lat") - F.col("lat")) / dy).withColumn("fc", (F.col("lon") - F.col("min_lon")) / dx)
    p = p.withColumn("r0", F.rint("fr").cast("int")).withColumn("c0", F.rint("fc").cast("int"))
    spread = lambda centre, cell: F.explode(F.sequence(F.col(centre) - F.ceil(F.col("half") / F.col(cell)).cast("int"), F.col(centre) + F.ceil(F.col("half") / F.col(cell)).cast("int")))
    p = p.withColumn("row", spread("r0", "cy")).withColumn("col", spread("c0", "cx")).where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))
    gap = F.hypot((F.col("row") - F.col("fr")) * F.col("cy"), (F.col("col") - F.col("fc")) * F.col("cx"))
    own = F.col("station") & (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))
    p = p.withColumn("gap", gap).where((~F.col("station") & (F.col("gap") <= F.col("half"))) | own).withColumn("first", F.when(own, 0).otherwise(1))
    g = p.groupBy(*on, "row", "col").agg(F.min_by(F.struct(*columns, "gap"), F.struct("first", F.round("gap", 6).alias("gap"), *columns)).alias("b"))
    return g.select(*on, "row", "col", *(F.round(F.col("b")[c], 4).alias(c) for c in columns), F.round("b.gap", 1).alias("gap_m"))


def surfaces(values: DataFrame, limit_km: float, power: float = 2.0, decay_km: float | None = None) -> DataFrame:
    """(period, family, bound, id, estimate, confidence): leave-one-out runs of the lower and the upper bounds.

    values: period, family, id, lat, lon, lower, upper. Both bounds are one plan with the bound as a column; a bound
    that a station lacks takes no part.
    """
    on = ["period", "family", "bound"]
    long = values.select("period", "family", "id", "lat", "lon", F.inline(F.array(F.struct(F.lit("lower").alias("bound"), F.col("lower").alias("value")), F.struct(F.lit("upper").alias("bound"), F.col("upper").alias("value"))))).where("value is not null")
    pairs = near_pairs(long, long, limit_km, on).where(F.col("id") != F.col("s_id"))
    e = idw(pairs, [*on, "id"], power, decay_km=decay_km or limit_km)
    return long.select(*on, "id", "value").join(e.select(*on, "id", "estimate", "confidence"), [*on, "id"], "left")
