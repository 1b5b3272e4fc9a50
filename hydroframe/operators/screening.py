"""Screening of samples against threshold tables. Rules are data: each is compiled into one column expression over the
inputs of a sample, so all uses are judged in one grouped plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions import text as X


@dataclass(frozen=True)
class Rule:
    """value must lie in [low, high]; either end may be open. says is the reason, {} standing for the value.

    Broken core rules make a sample unsafe, others call for caution. A rule is not applied where the input `unless` is
    known, or where the rule of `unless_broken` is broken. relaxed is the upper end where screening isn't strict.
    """

    use: str
    key: str
    low: float | None
    high: float | None
    core: bool
    says: str
    unless: str | None = None
    unless_broken: str | None = None
    relaxed: float | None = None


# Thresholds per use and input, with their reasons; [] stands for the upper end.
RULES = [
    Rule("human_consumption", "pH", 6.5, 8.5, True, "pH {} outside 6.5-8.5"), Rule("human_consumption", "turbidity", None, 1.0, True, "Turbidity {} NTU exceeds [] NTU", relaxed=5.0),
    Rule("human_consumption", "tds", None, 500.0, True, "TDS {} mg/L exceeds 500 mg/L desirable limit"), Rule("human_consumption", "nitrate", None, 45.0, True, "Nitrate {} mg/L exceeds 45 mg/L"),
    Rule("human_consumption", "fluoride", None, 1.0, True, "Fluoride {} mg/L exceeds [] mg/L", relaxed=1.5), Rule("human_consumption", "total_coliform", None, 0.0, True, "Total coliform {} MPN/100mL should be 0"),
    Rule("human_consumption", "e_coli", None, 0.0, True, "E. coli detected"), Rule("human_consumption", "chloride", None, 250.0, False, "Chloride {} mg/L exceeds 250 mg/L desirable limit"),
    Rule("human_consumption", "sulphate", None, 200.0, False, "Sulphate {} mg/L exceeds 200 mg/L desirable limit"), Rule("human_consumption", "hardness", None, 200.0, False, "Hardness {} mg/L as CaCO3 exceeds 200 mg/L desirable limit"),
    Rule("human_consumption", "alkalinity", None, 200.0, False, "Alkalinity {} mg/L as CaCO3 exceeds 200 mg/L desirable limit"),
    Rule("agriculture", "pH", 6.0, 8.5, True, "pH {} outside 6.0-8.5"), Rule("agriculture", "ec", None, 2250.0, True, "EC {} µS/cm exceeds 2250 µS/cm"), Rule("agriculture", "sar", None, 26.0, True, "SAR {} exceeds 26"),
    Rule("agriculture", "boron", None, 2.0, True, "Boron {} mg/L exceeds 2.0 mg/L"), Rule("agriculture", "chloride", None, 140.0, False, "Chloride {} mg/L may be restrictive for chloride-sensitive crops"),
    Rule("agriculture", "nitrate", None, 30.0, False, "Nitrate {} mg/L is high for irrigation screening"), Rule("agriculture", "rsc", None, 2.5, False, "RSC {} meq/L exceeds 2.5 meq/L"),
    Rule("agriculture", "bicarbonate", None, 610.0, False, "Bicarbonate {} mg/L is high and may create alkalinity hazard", unless_broken="rsc"), Rule("agriculture", "carbonate", None, 120.0, False, "Carbonate {} mg/L is high and may create alkalinity hazard", unless_broken="rsc"),
    Rule("aquatic_life", "pH", 6.5, 8.5, True, "pH {} outside 6.5-8.5"), Rule("aquatic_life", "dissolved_oxygen", 4.0, None, True, "DO {} mg/L below 4.0 mg/L"), Rule("aquatic_life", "free_ammonia", None, 1.2, True, "Free ammonia {} mg/L exceeds 1.2 mg/L"),
    Rule("aquatic_life", "bod", None, 3.0, False, "BOD {} mg/L exceeds 3.0 mg/L"), Rule("aquatic_life", "nitrate", None, 10.0, False, "Nitrate {} mg/L is high for stream ecology screening"), Rule("aquatic_life", "phosphate", None, 0.1, False, "Phosphate {} mg/L may promote eutrophication"),
    Rule("aquatic_life", "turbidity", None, 25.0, False, "Turbidity {} NTU is high for healthy stream habitat"), Rule("aquatic_life", "temperature", None, 32.0, False, "Temperature {}°C is stressful for many stream organisms"),
    Rule("bathing", "pH", 6.5, 8.5, True, "pH {} outside 6.5-8.5"), Rule("bathing", "dissolved_oxygen", 5.0, None, True, "DO {} mg/L below 5.0 mg/L"), Rule("bathing", "bod", None, 3.0, True, "BOD {} mg/L exceeds 3.0 mg/L"),
    Rule("bathing", "fecal_coliform", None, 0.0, True, "Fecal coliform {} MPN/100mL should be 0"), Rule("bathing", "total_coliform", None, 0.0, True, "Total coliform {} MPN/100mL should be 0", unless="fecal_coliform"),
    Rule("bathing", "turbidity", None, 10.0, False, "Turbidity {} NTU is high for safe/pleasant bathing"), Rule("bathing", "e_coli", None, 0.0, False, "E. coli detected"),
]
# Inputs of each use in the order of reports, and those of which one must be known for a judgement.
INPUTS = {
    "human_consumption": "pH turbidity tds nitrate fluoride chloride sulphate hardness alkalinity total_coliform e_coli".split(),
    "agriculture": "pH ec sar boron chloride nitrate bicarbonate carbonate rsc".split(),
    "aquatic_life": "pH dissolved_oxygen free_ammonia bod nitrate phosphate turbidity temperature".split(),
    "bathing": "pH dissolved_oxygen bod total_coliform fecal_coliform turbidity e_coli".split(),
}
CORE = {
    "human_consumption": "pH turbidity tds nitrate fluoride total_coliform e_coli".split(),
    "agriculture": "pH ec sar boron".split(),
    "aquatic_life": "pH dissolved_oxygen free_ammonia".split(),
    "bathing": "pH dissolved_oxygen bod total_coliform fecal_coliform e_coli".split(),
}
# Names of the inputs and states in reports.
LABELS = {
    "pH": "pH", "turbidity": "Turbidity", "tds": "TDS", "nitrate": "Nitrate", "fluoride": "Fluoride", "chloride": "Chloride", "sulphate": "Sulphate", "hardness": "Hardness", "alkalinity": "Alkalinity", "total_coliform": "Total coliform",
    "fecal_coliform": "Fecal coliform", "e_coli": "E. coli", "ec": "EC", "sar": "SAR", "boron": "Boron", "bicarbonate": "Bicarbonate", "carbonate": "Carbonate", "rsc": "RSC", "dissolved_oxygen": "DO", "free_ammonia": "Free ammonia", "bod": "BOD",
    "phosphate": "Phosphate", "temperature": "Temperature",
}
STATES = {"safe": "Pass", "caution": "Caution", "unsafe": "Fail", "unknown": "Insufficient data"}
NO_SAMPLE = "No sample matches the requested period."
# Parameters that feed an input, and near matches that are only reported.
CONFIRMED = {"ph": "pH", "turbidity": "turbidity", "tds": "tds", "fluoride": "fluoride", "chloride": "chloride", "sulphate": "sulphate", "so4": "sulphate", "th as caco3": "hardness", "total alkalinity as caco3": "alkalinity", "total coliform": "total_coliform", "t-coliform": "total_coliform", "boron(b)": "boron", "do": "dissolved_oxygen", "bod": "bod", "phosphate": "phosphate", "temperature": "temperature", "faecal coliform": "fecal_coliform"}
PROXY = {"no3-n": "nitrate", "nitrate": "nitrate", "p-alkalinity": "alkalinity", "conductivity": "ec", "nh3-n": "free_ammonia", "phosphate-p": "phosphate"}
# Parameter names, in lower-case words, of each scale.
SCALE_ALIASES = {
    "ph": "ph", "turbidity": "turbidity", "tds": "tds", "no3 n": "nitrate", "nitrate": "nitrate", "fluoride": "fluoride", "chloride": "chloride", "sulphate": "sulphate", "so4": "sulphate", "th as caco3": "hardness", "hardness": "hardness",
    "total alkalinity as caco3": "alkalinity", "p alkalinity": "alkalinity", "conductivity": "conductivity", "boron b": "boron", "boron": "boron", "do": "do", "dissolved oxygen": "do", "nh3 n": "ammonia", "free ammonia": "ammonia", "bod": "bod",
    "phosphate": "phosphate", "phosphate p": "phosphate", "temperature": "temperature", "total coliform": "total_coliform", "t coliform": "total_coliform", "faecal coliform": "fecal_coliform", "fecal coliform": "fecal_coliform",
}
# Scales of safe values as (use, scale, low, high, unit, axis from, axis to); the use '' holds for uses that don't define the scale.
SCALES = [
    ("human_consumption", "ph", 6.5, 8.5, "", 0.0, 14.0), ("human_consumption", "turbidity", None, 1.0, "NTU", None, None), ("human_consumption", "tds", None, 500.0, "mg/L", None, None), ("human_consumption", "nitrate", None, 45.0, "mg/L", None, None),
    ("human_consumption", "fluoride", None, 1.0, "mg/L", None, None), ("human_consumption", "chloride", None, 250.0, "mg/L", None, None), ("human_consumption", "sulphate", None, 200.0, "mg/L", None, None),
    ("human_consumption", "hardness", None, 200.0, "mg/L as CaCO3", None, None), ("human_consumption", "alkalinity", None, 200.0, "mg/L as CaCO3", None, None), ("human_consumption", "total_coliform", None, 0.0, "MPN/100mL", 0.0, 1000.0),
    ("agriculture", "ph", 6.0, 8.5, "", 0.0, 14.0), ("agriculture", "conductivity", None, 2250.0, "uS/cm", None, None), ("agriculture", "boron", None, 2.0, "mg/L", 0.0, 4.0), ("agriculture", "chloride", None, 140.0, "mg/L", None, None), ("agriculture", "nitrate", None, 30.0, "mg/L", None, None),
    ("aquatic_life", "ph", 6.5, 8.5, "", 0.0, 14.0), ("aquatic_life", "do", 4.0, None, "mg/L", 0.0, 10.0), ("aquatic_life", "ammonia", None, 1.2, "mg/L as N", 0.0, 3.0), ("aquatic_life", "bod", None, 3.0, "mg/L", 0.0, 10.0), ("aquatic_life", "nitrate", None, 10.0, "mg/L", None, None),
    ("aquatic_life", "phosphate", None, 0.1, "mg/L", 0.0, 1.0), ("aquatic_life", "turbidity", None, 25.0, "NTU", None, None), ("aquatic_life", "temperature", None, 32.0, "°C", 0.0, 40.0),
    ("bathing", "ph", 6.5, 8.5, "", 0.0, 14.0), ("bathing", "do", 5.0, None, "mg/L", 0.0, 10.0), ("bathing", "bod", None, 3.0, "mg/L", 0.0, 10.0), ("bathing", "total_coliform", None, 0.0, "MPN/100mL", 0.0, 2000.0), ("bathing", "fecal_coliform", None, 0.0, "MPN/100mL", 0.0, 2000.0),
    ("bathing", "turbidity", None, 10.0, "NTU", None, None), ("", "total_coliform", None, 0.0, "MPN/100mL", 0.0, 2000.0), ("", "fecal_coliform", None, 0.0, "MPN/100mL", 0.0, 2000.0),
]


def status(value: Column, low: Column, high: Column) -> Column:
    """safe, unsafe or unknown of one value on one scale; a null end is open."""
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "unknown").when(outside, "unsafe").otherwise("safe")


def scales_table(spark: SparkSession) -> DataFrame:
    """The scales as a table of a few dozen rows."""
    return spark.createDataFrame(SCALES, "use_case string, scale string, low double, high double, unit string, axis_low double, axis_high double")


def on_scales(values: DataFrame, use: str) -> DataFrame:
    """values (parameter, value, ...) with scale, low, high, status and axis under a use; a scale that the use doesn't
    define is the common one, values without scale come without status."""
    if use not in INPUTS:
        raise ValueError(f"unknown use: {use}")
    ours = [s for s in SCALES if s[0] == use]
    known = {s[1] for s in ours}
    scales = values.sparkSession.createDataFrame([s[1:] for s in ours + [s for s in SCALES if s[0] == "" and s[1] not in known]], "scale string, low double, high double, unit string, axis_low double, axis_high double")
    v = values.withColumn("scale", X.scale_key(X.screening_family(F.col("parameter")), SCALE_ALIASES)).join(F.broadcast(scales), "scale", "left")
    kind = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), "range").when(F.col("low").isNotNull(), "min").otherwise("max")
    there = F.col("low").isNotNull() | F.col("high").isNotNull()
    axis = X.axis_end(kind, F.col("axis_low"), F.col("axis_high"), F.col("low"), F.col("high"), F.col("value"))
    return v.withColumn("status", F.when(there, status(F.col("value"), F.col("low"), F.col("high")))).withColumn("axis", F.when(there, axis)).drop("axis_low", "axis_high")


def inputs(records: DataFrame, *by: str) -> DataFrame:
    """One row per sample with `confirmed` and `proxy`: per input its value and parameter, plain before max before min,
    later files first, then file order. One grouping by the sample; records: by, file_name, row_id, parameter,
    numeric_value."""
    name = F.lower(X.screening_family(F.col("parameter")))
    maps = {k: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for k, m in (("confirmed", CONFIRMED), ("proxy", PROXY))}
    v = X.variant(F.col("parameter"))
    rank = F.when(v == "", 2).when(v == "max", 1).otherwise(0)
    number = (F.col("numeric_value").isNotNull()) & ~F.isnan("numeric_value") & (F.abs("numeric_value") < float("inf"))
    r = records.select(*by, F.when(number, F.struct(F.col("numeric_value").alias("value"), "parameter")).alias("b"), F.struct(rank.alias("r"), F.col("file_name").alias("f"), (-F.col("row_id")).alias("i")).alias("o"), *(F.try_element_at(m, name).alias(k) for k, m in maps.items()))

    def best(kind: str, keys: Sequence[str]) -> Column:
        cells = [F.max_by("b", F.when((F.col(kind) == k) & F.col("b").isNotNull(), F.col("o"))).alias(k) for k in keys]
        return F.struct(*cells).alias(kind)

    return r.groupBy(*by).agg(best("confirmed", sorted(set(CONFIRMED.values()))), best("proxy", sorted(set(PROXY.values()))))


def judge(use: str, value: dict[str, Column], strict: bool = True, rules: Sequence[Rule] = tuple(RULES)) -> Column:
    """struct(status, core_reasons, extended_reasons) of a use, from a column per known input; other inputs don't count."""
    null = F.lit(None).cast("double")
    own = [r for r in rules if r.use == use]
    end = lambda r: r.relaxed if r.relaxed is not None and not strict else r.high
    of = lambda k: value.get(k, null)

    def outside(r: Rule) -> Column:
        ends = [of(r.key) < r.low] if r.low is not None else []
        ends += [of(r.key) > end(r)] if end(r) is not None else []
        return F.coalesce(reduce(lambda a, b: a | b, ends), F.lit(False))

    def reasons(core: bool) -> Column:
        out = []
        for r in own:
            if r.core == core:
                bad = outside(r)
                if r.unless:
                    bad = bad & of(r.unless).isNull()
                if r.unless_broken:
                    bad = bad & ~reduce(lambda a, b: a | b, [outside(x) for x in own if x.key == r.unless_broken])
                limit = f"{end(r):g}" if end(r) is not None else ""
                before, _, after = r.says.replace("[]", limit).partition("{}")
                out.append(F.when(bad, F.concat(F.lit(before), X.short_number(of(r.key)), F.lit(after)) if "{}" in r.says else F.lit(r.says)))
        return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<string>")

    known = reduce(lambda a, b: a | b, [of(k).isNotNull() for k in CORE[use]])
    core, extended = reasons(True), reasons(False)
    state = F.when(~known, "unknown").when(F.size(core) > 0, "unsafe").when(F.size(extended) > 0, "caution").otherwise("safe")
    return F.struct(F.lit(use).alias("use_case"), state.alias("status"), core.alias("core_reasons"), extended.alias("extended_reasons"))


def screen(records: DataFrame, by: Sequence[str] = ("station", "sample"), uses: Sequence[str] = tuple(INPUTS), strict: bool = True) -> DataFrame:
    """Every sample under every use: status and its label, reasons, and which inputs were confirmed, only near matches,
    or missing.

    records: by, file_name, row_id, parameter, numeric_value.
    """
    i = inputs(records, *by)

    def one(use: str) -> Column:
        found = {k: F.col("confirmed")[k] for k in INPUTS[use] if k in CONFIRMED.values()}
        near = {k: F.col("proxy")[k] for k in INPUTS[use] if k in PROXY.values()}
        no = F.lit(False)
        has = lambda m, k: m[k].isNotNull() if k in m else no
        said = lambda k, m: F.concat(F.lit(f"{LABELS[k]} via "), m[k]["parameter"]) if k in m else F.lit(None)
        filled = lambda cells: F.filter(F.array(*cells), lambda x: x.isNotNull())
        j = judge(use, {k: c["value"] for k, c in found.items()}, strict)
        return F.struct(
            j["use_case"].alias("use_case"), j["status"].alias("status"), j["core_reasons"].alias("core_reasons"), j["extended_reasons"].alias("extended_reasons"),
            filled([F.when(has(found, k), said(k, found)) for k in INPUTS[use]]).alias("confirmed"),
            filled([F.when(~has(found, k) & has(near, k), said(k, near)) for k in INPUTS[use]]).alias("proxy"),
            filled([F.when(~has(found, k) & ~has(near, k), F.lit(LABELS[k])) for k in INPUTS[use]]).alias("missing"),
        )

    states = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    out = i.select(*by, F.inline(F.array(*map(one, uses))))
    return out.select(*by, "use_case", "status", F.element_at(states, F.col("status")).alias("label"), "core_reasons", "extended_reasons", "confirmed", "proxy", "missing")


def screen_stations(records: DataFrame, use: str, year: int | None = None, month: int | None = None, strict: bool = True) -> DataFrame:
    """Each station's latest sample (of a year, a month) under one use; a station without one is unknown, with the reason.

    records: station, file_name, sort_key, year, month_index, row_id, parameter, numeric_value. A sample is what a
    station has in one file under one sort key.
    """
    if use not in INPUTS:
        raise ValueError(f"unknown use: {use}")
    fits = F.lit(True)
    if year is not None:
        fits = fits & (F.col("year") == year)
    if month is not None:
        fits = fits & (F.col("month_index") == month)
    stations = records.groupBy("station").agg(F.max(F.when(fits, F.struct("sort_key", "file_name"))).alias("last"))
    of = records.join(stations, "station").where((F.col("sort_key") == F.col("last.sort_key")) & F.col("file_name").eqNullSafe(F.col("last.file_name")))
    judged = screen(of, ("station", "sort_key", "file_name"), (use,), strict)
    out = stations.select("station").join(judged, "station", "left")
    why = F.when(F.col("status").isNull(), F.array(F.lit(NO_SAMPLE))).otherwise(F.concat("core_reasons", "extended_reasons"))
    return out.select("station", "sort_key", "file_name", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("label", F.lit(STATES["unknown"])).alias("label"), why.alias("reasons"), "confirmed", "proxy", "missing")


def latest(samples: DataFrame) -> DataFrame:
    """The latest sample of each station: greatest sort_key, then file name, then file order; aggregated map-side."""
    row = F.struct(*(F.col(f"`{c}`") for c in samples.columns))
    best = samples.groupBy("station").agg(F.max_by(row, F.struct("sort_key", "file_name", -F.col("row_id"))).alias("b"))
    return best.select("b.*")
