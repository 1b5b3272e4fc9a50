"""A grammar of numbers and unit expressions.

A unit expression is read as a product of powers; its dimension is a vector of exponents over BASES and its
size a scale (and, for temperatures, an offset) to the base units. Two units convert into each other when their
vectors agree. Amounts of substance convert to masses only where the substance is known.

    expression := group (("/" | "per") group)*        every group after a slash divides
    group      := (factor)+                           juxtaposed or joined by "." or "*"
    factor     := number | atom exponent?
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

BASES = ("mass", "length", "amount", "count", "conductance", "temperature", "turbidity")


def _vector(**powers: int) -> tuple[int, ...]:
    return tuple(powers.get(b, 0) for b in BASES)


NONE = _vector()
CONCENTRATION = _vector(mass=1, length=-3)
MOLARITY = _vector(amount=1, length=-3)
VOLUME = _vector(length=3)

# Metric prefixes.
PREFIXES = {"": 1.0, "n": 1e-9, "µ": 1e-6, "u": 1e-6, "mc": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "k": 1e3, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "deci": 1e-1, "kilo": 1e3}
# Atoms that take prefixes, as (vector, scale to kg, m, mol, count, S, K, NTU).
METRIC = {
    "g": (_vector(mass=1), 1e-3), "gm": (_vector(mass=1), 1e-3), "gms": (_vector(mass=1), 1e-3), "gram": (_vector(mass=1), 1e-3), "grams": (_vector(mass=1), 1e-3), "gramme": (_vector(mass=1), 1e-3),
    "l": (VOLUME, 1e-3), "ltr": (VOLUME, 1e-3), "lit": (VOLUME, 1e-3), "litre": (VOLUME, 1e-3), "litres": (VOLUME, 1e-3), "liter": (VOLUME, 1e-3), "liters": (VOLUME, 1e-3),
    "m": (_vector(length=1), 1.0), "metre": (_vector(length=1), 1.0), "meter": (_vector(length=1), 1.0), "cc": (VOLUME, 1e-6),
    "mol": (_vector(amount=1), 1.0), "mole": (_vector(amount=1), 1.0), "moles": (_vector(amount=1), 1.0), "mols": (_vector(amount=1), 1.0),
    "s": (_vector(conductance=1), 1.0), "siemens": (_vector(conductance=1), 1.0), "mho": (_vector(conductance=1), 1.0), "mhos": (_vector(conductance=1), 1.0),
}
# Atoms without prefixes.
PLAIN = {
    "mpn": (_vector(count=1), 1.0), "cfu": (_vector(count=1), 1.0), "no": (_vector(count=1), 1.0), "nos": (_vector(count=1), 1.0), "org": (_vector(count=1), 1.0), "organisms": (_vector(count=1), 1.0),
    "ntu": (_vector(turbidity=1), 1.0), "fnu": (_vector(turbidity=1), 1.0), "ftu": (_vector(turbidity=1), 1.0), "fau": (_vector(turbidity=1), 1.0), "jtu": (_vector(turbidity=1), 1.0),
    "ppm": (CONCENTRATION, 1e-3), "ppb": (CONCENTRATION, 1e-6), "ppt": (CONCENTRATION, 1.0),
    "thousand": (NONE, 1e3), "million": (NONE, 1e6), "hundred": (NONE, 1e2), "lakh": (NONE, 1e5),
    "ph": (NONE, 1.0), "unit": (NONE, 1.0), "units": (NONE, 1.0),
}
# Temperature scales as (scale, offset): kelvin = scale * x + offset.
SCALES = {
    "c": (1.0, 273.15), "celsius": (1.0, 273.15), "centigrade": (1.0, 273.15), "degc": (1.0, 273.15), "degcelsius": (1.0, 273.15),
    "k": (1.0, 0.0), "kelvin": (1.0, 0.0), "degk": (1.0, 0.0),
    "f": (5 / 9, 273.15 - 32 * 5 / 9), "fahrenheit": (5 / 9, 273.15 - 32 * 5 / 9), "degf": (5 / 9, 273.15 - 32 * 5 / 9), "degfahrenheit": (5 / 9, 273.15 - 32 * 5 / 9),
}
# Molar masses in kg/mol, by lower-case canonical parameter.
MOLAR_MASS = {"chloride": 35.453e-3, "nitrate": 62.0049e-3, "fluoride": 18.9984e-3, "boron(b)": 10.811e-3, "do": 31.998e-3}

# Texts that stand for no value.
MISSING = frozenset({"", "-", "--", "---", "na", "n/a", "n.a.", "nil", "null", "nan", "none given", "#n/a", "?", "."})

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")


@dataclass(frozen=True)
class Unit:
    """vector: exponents over BASES. base = scale * x + offset."""

    vector: tuple[int, ...]
    scale: float
    offset: float = 0.0


def is_missing(text: str | None) -> bool:
    """Null, blank, or a marker that stands for no value; BDL, ND and '<x' are results."""
    return text is None or text.strip().lower() in MISSING


def _atom(word: str) -> tuple[tuple[int, ...], float] | None:
    if word in PLAIN:
        return PLAIN[word]
    for cased in (word,):
        if cased in METRIC:
            return METRIC[cased]
        for cut in range(1, len(cased)):
            head, tail = cased[:cut], cased[cut:]
            if head in PREFIXES and tail in METRIC:
                vector, scale = METRIC[tail]
                return vector, PREFIXES[head] * scale
    return None


_TOKEN = re.compile(r"\d+(?:\.\d+)?\^-?\d+|\d+(?:\.\d+)?|[a-zµ°%]+|\^|[-+]\d+|/|.")


@lru_cache(maxsize=65536)
def parse_unit(text: str) -> Unit | None:
    """The unit that text states; None if text is no unit expression."""
    t = text.replace("Â", "").replace("â\x81»", "-").translate(_SUPER).replace("μ", "µ").replace("⁄", "/").replace("\\", "/").replace("∕", "/").replace("·", ".").replace("×", "x")
    t = t.strip().strip("()[] ,;:").strip().lower()
    if not t:
        return None
    squeezed = re.sub(r"[\s.°º]|deg(?:ree)?s?(?=\W|\s)", "", t)
    for s in (squeezed, re.sub(r"^degrees?", "", squeezed), re.sub(r"^deg", "", squeezed)):
        if s in SCALES:
            scale, offset = SCALES[s]
            return Unit(_vector(temperature=1), scale, offset)
    if (dotless := t.replace(".", "")) in PLAIN:
        vector, scale = PLAIN[dotless]
        return Unit(vector, scale)
    t = re.sub(r"\bper\b", "/", t)
    t = re.sub(r"(?<![a-z])x\s*(?=\d)", "", t)
    vector, scale, sign, last = [0] * len(BASES), 1.0, 1, None
    tokens = [x for x in _TOKEN.findall(t) if not x.isspace() and x not in ".*"]
    i = 0
    while i < len(tokens):
        x = tokens[i]
        i += 1
        if x == "/":
            sign, last = -1, None
            continue
        if x[0].isdigit():
            base, _, power = x.partition("^")
            scale *= (float(base) ** int(power or 1)) ** sign
            last = None
            continue
        found = _atom(x)
        if found is None:
            parts = next(((a, b) for n in range(1, len(x)) if (a := _atom(x[:n])) and (b := _atom(x[n:]))), None)
            if parts is None:
                return None
            (va, sa), (vb, sb) = parts
            if vb == VOLUME and va != VOLUME:  # "mgl": a concentration written without its slash
                vb, sb = tuple(-p for p in vb), 1 / sb
            found = tuple(a + b for a, b in zip(va, vb)), sa * sb
        power = 1
        if i < len(tokens) and tokens[i] == "^":
            i += 1
        if i < len(tokens) and re.fullmatch(r"[-+]?\d", tokens[i]) and (tokens[i][0] in "-+" or tokens[i - 1] == "^" or x in ("m", "cm", "dm", "mm")):
            power = int(tokens[i])
            i += 1
        for k, p in enumerate(found[0]):
            vector[k] += sign * power * p
        scale *= found[1] ** (sign * power)
        last = x
    if last is None and not any(vector):
        return None
    return Unit(tuple(vector), scale)


@lru_cache(maxsize=65536)
def conversion(stated: str, common: str, parameter: str = "") -> tuple[float, float] | None:
    """(factor, offset) with common value = factor * stated value + offset; None where the units don't convert."""
    a, b = parse_unit(stated), parse_unit(common)
    if a is None or b is None:
        return None
    scale = a.scale
    if a.vector == MOLARITY and b.vector == CONCENTRATION and (mass := MOLAR_MASS.get(parameter.lower())):
        scale *= mass
    elif a.vector != b.vector:
        return None
    return scale / b.scale, (a.offset - b.offset) / b.scale


def differs(change: tuple[float, float] | None) -> bool:
    """Whether a conversion changes scale or zero point."""
    return change is not None and (abs(change[0] - 1) > 1e-9 or abs(change[1]) > 1e-9)


_NUMBER = re.compile(
    r"""^\s*(?P<about>approx\.?|about|ca\.?|circa|~|≈|<=|>=|<|>|≤|≥|less\s+than|more\s+than)?\s*
    (?P<mantissa>[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.+\d*)?)
    (?:\s*[x×*]\s*10\s*(?:\^|\*\*)\s*(?P<power>[-+]?\d+)|[eE](?P<e>[-+]?\d+))?
    \s*(?P<mark>[*?†#]*)\s*(?P<rest>.*)$""",
    re.X | re.S,
)
_SLIP = re.compile(r"(?<=[\d.,])[Oo](?=[\dOo.,\s*?]|$)|^[Oo](?=[.,]?\d|[.,][Oo\d])")
PLAIN_NUMBER = re.compile(r"^\s*[-+]?(\d+(\.\d+)?|\.\d+)\s*$", re.A)


def parse_number(text: str | None) -> tuple[float, str, bool] | None:
    """(number, what follows it, whether it is a bound such as '<5'); None if text starts with no number.

    Reads thousands separators, powers of ten, doubled points, letters O for zeros, and marks such as '~' and '*'.
    """
    if text is None:
        return None
    t = text
    while (u := _SLIP.sub("0", t)) != t:
        t = u
    m = _NUMBER.match(t)
    mantissa = m["mantissa"] if m else ""
    if not re.search(r"\d", mantissa):
        return None
    mantissa = re.sub(r"\.+", ".", mantissa.replace(",", ""))
    try:
        value = float(mantissa) * 10.0 ** int(m["power"] or m["e"] or 0)
    except (ValueError, OverflowError):
        return None
    if not math.isfinite(value):
        return None
    return value, m["rest"].strip(), (m["about"] or "")[:1] in tuple("<>≤≥lm")
