"""Column functions on texts, numbers, dates and positions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
MONTH_LABELS = ["", "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Markers that count as missing cells.
MISSING_MARKERS = ["", "na", "n/a", "null", "none", "nan"]
# Columns that may carry the water body, in order of preference.
WATER_BODY_COLUMNS = ["Water Body", "Water Body Name", "Waterbody", "Drain", "Drain Name", "River", "River Name", "Channel", "Stream"]
EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0

_NUMBER = r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"


def clean(c: Column) -> Column:
    """Text without byte marks and mojibake, en dashes as hyphens, blanks collapsed; null as ''."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c.cast("string"), F.lit("")), "–﻿Â", "-"), r"[\s ]+", " "))


def clean_typed(c: Column, dtype: str) -> Column:
    """clean() of a typed cell: a numeric zero or false counts as blank, the text '0' does not."""
    if dtype == "string":
        return clean(c)
    blank = ~c if dtype == "boolean" else (c == 0) if dtype.startswith(("int", "big", "small", "tiny", "double", "float", "decimal")) else F.lit(False)
    return F.when(F.coalesce(blank, F.lit(True)), F.lit("")).otherwise(clean(c))


def number(c: Column) -> Column:
    """The number in a text: thousands separators dropped, 12x10^3 read as a power; null where there is none."""
    t = F.regexp_replace(F.trim(c), ",", "")
    power = r"^(\d+(?:\.\d+)?)x10\^(\d+)$"
    plain = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    scaled = F.regexp_extract(t, power, 1).try_cast("double") * F.pow(F.lit(10.0), F.regexp_extract(t, power, 2).try_cast("double"))
    x = F.when(t.rlike(power), scaled).otherwise(plain)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def frame_number(c: Column) -> Column:
    """The stricter number of tables: plain notation only, neither separators nor written powers."""
    t = F.trim(c)
    x = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def normalize_parameter(c: Column) -> Column:
    """clean(), with the aliases of total coliform unified and (Max)/(Min) kept."""
    t = clean(c)
    alias = r"(?i)^(t[.\-\s]*coliform|total\s+coliform)\s*(\((max|min)\))?$"
    tail = F.lower(F.regexp_extract(t, alias, 3))
    return F.when(t.rlike(alias), F.concat(F.lit("Total Coliform"), F.when(tail == "", "").otherwise(F.concat(F.lit(" ("), F.initcap(tail), F.lit(")"))))).otherwise(t)


def family(c: Column) -> Column:
    """A parameter without (max)/(min); spellings of both coliforms unified."""
    t = F.trim(F.regexp_replace(clean(c), r"(?i)\s*\((max|min)\)\s*$", ""))
    return F.when(t.rlike(r"(?i)^(t[.\-\s]*|total\s+)coliform$"), "Total Coliform").when(t.rlike(r"(?i)^f(a?ecal)?[.\-\s]*coliform$"), "Faecal Coliform").otherwise(t)


def variant(c: Column) -> Column:
    """'max', 'min' or '' of a trailing qualifier, blanks inside allowed."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"(?i)\(\s*(max|min)\s*\)$", 1))


def screening_family(c: Column) -> Column:
    """A parameter without its trailing qualifier, spelling untouched."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(variant(c) != "", F.trim(F.regexp_replace(t, r"\s*\([^)]*\)\s*$", ""))).otherwise(t)


def month_number(c: Column) -> Column:
    """1 to 12 from a month's name, abbreviation or number; 1 where it can't be read."""
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    n = F.when(t.rlike(r"^\d{1,4}$"), t.try_cast("int"))
    return F.coalesce(F.try_element_at(names, t), F.when(n.between(1, 12), n), F.lit(1))


def parse_day(c: Column) -> Column:
    """The day of a date text: day-month-year, ISO, day/month/year, month/day/year, tried in this order."""
    t = F.trim(c)
    tried = [F.when(t.rlike(shape), F.try_to_date(t, form)) for shape, form in ((r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"))]
    return F.coalesce(*tried)


def date_range(date: Column, year: Column, month: Column, source: Column) -> Column:
    """struct(start, end, precision) of a row's date: a day, a written range, or the month or year it falls in.

    The year falls back to the first in the source's name; null where nothing can be read or a range is reversed.
    """
    shape = r"^\[?\s*(\d{1,2}-\d{1,2}-\d{4})\s*[,/]\s*(\d{1,2}-\d{1,2}-\d{4})\s*\]?$"
    t = clean(date)
    day = parse_day(t)
    low, high = (F.try_to_date(F.when(t.rlike(shape), F.regexp_extract(t, shape, k)), "d-M-yyyy") for k in (1, 2))
    written = F.regexp_extract(clean(year), r"^((19|20)\d\d)(\.0)?$", 1)
    y = F.coalesce(written.try_cast("int"), F.regexp_extract(F.coalesce(source, F.lit("")), r"((19|20)\d\d)", 1).try_cast("int"))
    m = F.when(clean(month) != "", month_number(month))
    first = F.make_date(y, F.coalesce(m, F.lit(1)), F.lit(1))
    last = F.when(m.isNull(), F.make_date(y, F.lit(12), F.lit(31))).otherwise(F.last_day(first))
    start = F.when(day.isNotNull(), day).when(t != "", low).otherwise(first)
    end = F.when(day.isNotNull(), day).when(t != "", high).otherwise(last)
    whole = (F.month(start) == 1) & (F.dayofmonth(start) == 1) & (F.month(end) == 12) & (F.dayofmonth(end) == 31)
    precision = F.when(day.isNotNull(), "day").when(whole, "year").otherwise("month")
    return F.when(start <= end, F.struct(start.alias("date_start"), end.alias("date_end"), precision.alias("date_precision")))


def sort_key(start: Column, precision: Column) -> Column:
    """year * 100 + month; month 0 for a whole year."""
    return F.year(start) * 100 + F.when(precision == "year", 0).otherwise(F.month(start))


def month_label(start: Column, precision: Column) -> Column:
    """Jan to Dec; '' for a whole year."""
    return F.when(precision == "year", "").otherwise(F.element_at(F.array(*map(F.lit, MONTH_LABELS)), F.month(start) + 1))


def midpoint(start: Column, end: Column) -> Column:
    """The moment half way between the beginnings of two days."""
    return F.timestamp_seconds((F.unix_timestamp(start.cast("timestamp")) + F.unix_timestamp(end.cast("timestamp"))) / 2)


def first_filled(*columns: Column) -> Column:
    """The first column that isn't blank, cleaned; '' where all are."""
    return F.coalesce(*(F.nullif(clean(c), F.lit("")) for c in columns), F.lit(""))


def slug(c: Column, default: str = "location") -> Column:
    """Lower-case letters and digits joined by hyphens."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit(default))


def label_tokens(c: Column) -> Column:
    """Distinct upper-case words of a label, pasted decimal coordinates left out, sorted."""
    t = F.regexp_replace(F.upper(c), r"(?<![A-Z0-9])\d{1,3}\.\d+(?![A-Z0-9])", " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit("([A-Z0-9]+)"), F.lit(1))))


def flow_marker(c: Column) -> Column:
    """'US' or 'DS' where a label names exactly one side, else ''."""
    up, down = c.rlike(r"(?i)\b(u\s*/\s*s|upstream)\b"), c.rlike(r"(?i)\b(d\s*/\s*s|downstream)\b")
    return F.when(up & ~down, "US").when(down & ~up, "DS").otherwise("")


def scale_key(c: Column, aliases: dict[str, str]) -> Column:
    """The key of a parameter's scale: known aliases, else its words joined by underscores."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(known, words), F.regexp_replace(words, r"\s+", "_"))


def short_number(c: Column) -> Column:
    """7.0 as '7', 7.25 as '7.25'."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane around the mean latitude."""
    x = (lon2 - lon1) * DEGREE_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + F.pow((lat2 - lat1) * DEGREE_M, F.lit(2)))


def valid_position(lat: Column, lon: Column) -> Column:
    """Both coordinates present and on Earth."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def axis_end(kind: Column, fixed_low: Column, fixed_high: Column, low: Column, high: Column, value: Column) -> Column:
    """struct(low, high) of a scale's axis: fixed ends (the upper one giving way to the value); for a range three quarters
    of its width, or one, around it, and a quarter of that around the value; else from zero to 1.6 times the threshold,
    1.15 times the value, or one above the threshold."""
    room = F.greatest((high - low) * 0.75, F.lit(1.0))
    fixed = fixed_low.isNotNull() & fixed_high.isNotNull()
    threshold = F.when(kind == "min", low).otherwise(high)
    least = F.when(fixed, fixed_low).when(kind == "range", F.greatest(F.lit(0.0), F.least(low - room, value - room * 0.25))).otherwise(F.coalesce(fixed_low, F.lit(0.0)))
    most = F.when(fixed, F.greatest(fixed_high, value)).when(kind == "range", F.greatest(high + room, value + room * 0.25)).otherwise(F.greatest(threshold * 1.6, F.coalesce(value * 1.15, F.lit(0.0)), threshold + 1))
    return F.struct(least.alias("low"), most.alias("high"))


def compact_number(c: Column) -> Column:
    """A number for display: two decimals, one from 10, none from 1,000 (with separators), and from 10,000 a power such
    as 1.5E+4; NA where there is none."""
    plain = lambda n: F.regexp_replace(F.format_number(F.round(c, n), n), r"(\.\d*?)0+$|\.0*$", "$1")
    tidy = lambda n: F.regexp_replace(plain(n), r"\.$", "")
    size = F.abs(c)
    power = F.floor(F.log10(size)).cast("int")
    mantissa = F.round(c / F.pow(F.lit(10.0), power), 2)
    # Rounding up to ten moves the power.
    over = F.abs(mantissa) >= 10
    mantissa, power = F.when(over, mantissa / 10).otherwise(mantissa), F.when(over, power + 1).otherwise(power)
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", mantissa), r"0+$", ""), r"\.$", "")
    scaled = F.concat(digits, F.lit("E+"), power.cast("string"))
    return F.when(c.isNull() | F.isnan(c) | (size == float("inf")), "NA").when(size >= 10000, scaled).when(size >= 1000, F.format_number(F.round(c, 0), 0)).when(size >= 10, tidy(1)).otherwise(tidy(2))


# Positions and colours (red, green, blue, opacity) of the map's ramp.
RAMP = [(0.0, (29, 78, 216, 88)), (0.18, (8, 145, 178, 112)), (0.42, (5, 150, 105, 138)), (0.68, (234, 179, 8, 164)), (1.0, (220, 38, 38, 188))]
#: Ratio of a positive range's ends from which its scale is logarithmic.
LOG_FROM = 100.0


def ramp_position(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies between low and high, 0 to 1; by logarithms where the range is positive and wide."""
    wide = (low > 0) & (high > 0) & (high / low >= LOG_FROM)
    logs = (F.log10(value) - F.log10(low)) / F.coalesce(F.nullif(F.log10(high) - F.log10(low), F.lit(0.0)), F.lit(1.0))
    plain = (value - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))
    x = F.when(wide, logs).otherwise(plain)
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)))))


def ramp_color(position: Column) -> Column:
    """array(red, green, blue, opacity) of a position on the ramp."""
    out = F.array(*map(F.lit, RAMP[-1][1]))
    for (a, left), (b, right) in reversed(list(zip(RAMP, RAMP[1:]))):
        amount = (position - a) / (b - a)
        out = F.when(position <= b, F.array(*(F.floor(left[k] + (right[k] - left[k]) * amount + 0.5).cast("int") for k in range(4)))).otherwise(out)
    return out
