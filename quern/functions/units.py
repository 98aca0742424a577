"""Numbers and unit expressions: a small grammar over exponent vectors.

A unit is an exponent vector over the base dimensions, a factor to the base
units (exact, as a fraction) and an offset. An expression is a sequence of
terms; every term has one or more readings (``m`` is a metre or a million,
``K`` a kelvin or a thousand), and the reading kept is the first of those that
use the most terms and whose product has the exponents that the attribute's
dimension asks for. It is found in one pass over the terms: what may still follow
depends on the currency, the unit and an open power only.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from functools import lru_cache

BASE = ("length", "mass", "time", "temperature", "money", "item")


def _v(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(b, 0) for b in BASE)


#: Exponents of each dimension of the attribute catalogue.
DIMENSIONS = {
    "area": _v(length=2), "mass": _v(mass=1), "distance": _v(length=1), "energy": _v(mass=1, length=2, time=-2),
    "volume": _v(length=3), "share": _v(), "count": _v(item=1), "duration": _v(time=1),
    "temperature": _v(temperature=1), "money": _v(money=1),
}
_L, _A, _V3, _M, _T, _K, _E, _N, _R = (
    DIMENSIONS[d] for d in ("distance", "area", "volume", "mass", "duration", "temperature", "energy", "count", "share")
)
_f = Fraction

# Units by the spellings that name them. Base units: metre, kilogram, second, kelvin, item, whole.
_UNITS: list[tuple[str, tuple[int, ...], Fraction, Fraction]] = [
    ("m metre metres meter meters mtr mtrs", _L, _f(1), _f(0)),
    ("km kms kilometre kilometres kilometer kilometers", _L, _f(1000), _f(0)),
    ("mi mile miles", _L, _f("1609.344"), _f(0)),
    ("nmi nautical_mile nautical_miles", _L, _f(1852), _f(0)),
    ("ft foot feet", _L, _f("0.3048"), _f(0)),
    ("yd yard yards", _L, _f("0.9144"), _f(0)),
    ("cm centimetre centimetres", _L, _f("0.01"), _f(0)),
    ("mm millimetre millimetres", _L, _f("0.001"), _f(0)),
    ("sqm", _A, _f(1), _f(0)),
    ("sqft sft", _A, _f("0.09290304"), _f(0)),
    ("msf", _A, _f("92903.04"), _f(0)),
    ("sqkm", _A, _f(10**6), _f(0)),
    ("ha hectare hectares", _A, _f(10**4), _f(0)),
    ("acre acres ac", _A, _f("4046.8564224"), _f(0)),
    ("t tonne tonnes mt metric_ton metric_tons metric_tonne metric_tonnes", _M, _f(1000), _f(0)),
    ("kt kilotonne kilotonnes", _M, _f(10**6), _f(0)),
    ("kg kgs kilogram kilograms", _M, _f(1), _f(0)),
    ("g gram grams", _M, _f("0.001"), _f(0)),
    ("quintal quintals qtl", _M, _f(100), _f(0)),
    ("short_ton short_tons", _M, _f("907.18474"), _f(0)),
    ("long_ton long_tons", _M, _f("1016.0469088"), _f(0)),
    ("lb lbs pound pounds", _M, _f("0.45359237"), _f(0)),
    ("kwh unit units", _E, _f(3600000), _f(0)),
    ("mwh", _E, _f(3600000) * 1000, _f(0)),
    ("gwh", _E, _f(3600000) * 10**6, _f(0)),
    ("twh", _E, _f(3600000) * 10**9, _f(0)),
    ("mu", _E, _f(3600000) * 10**6, _f(0)),
    ("j joule joules", _E, _f(1), _f(0)),
    ("kj kilojoule kilojoules", _E, _f(1000), _f(0)),
    ("mj megajoule megajoules", _E, _f(10**6), _f(0)),
    ("gj gigajoule gigajoules", _E, _f(10**9), _f(0)),
    ("tj terajoule terajoules", _E, _f(10**12), _f(0)),
    ("l litre litres liter liters ltr ltrs", _V3, _f("0.001"), _f(0)),
    ("kl kilolitre kilolitres kiloliter kiloliters", _V3, _f(1), _f(0)),
    ("ml megalitre megalitres", _V3, _f(1000), _f(0)),
    ("us_gal us_gallon us_gallons gallon gallons gal", _V3, _f("0.003785411784"), _f(0)),
    ("bbl bbls barrel barrels", _V3, _f("0.158987294928"), _f(0)),
    ("cum", _V3, _f(1), _f(0)),
    ("% pct percent per_cent percentage_point percentage_points pp", _R, _f("0.01"), _f(0)),
    ("bp bps basis_point basis_points", _R, _f("0.0001"), _f(0)),
    ("‰ per_mille per_mil permille", _R, _f("0.001"), _f(0)),
    ("d day days", _T, _f(86400), _f(0)),
    ("h hr hrs hour hours", _T, _f(3600), _f(0)),
    ("min mins minute minutes", _T, _f(60), _f(0)),
    ("s sec secs second seconds", _T, _f(1), _f(0)),
    ("wk wks week weeks", _T, _f(604800), _f(0)),
    ("fortnight fortnights", _T, _f(1209600), _f(0)),
    ("c °c ℃ celsius centigrade deg_c degree_c degrees_c degree_celsius degrees_celsius", _K, _f(1), _f("273.15")),
    ("f °f ℉ fahrenheit deg_f degree_f degrees_f degree_fahrenheit degrees_fahrenheit", _K, _f(5, 9), _f("459.67")),
    ("k kelvin", _K, _f(1), _f(0)),
    ("count number numbers no nos item items person persons people personnel employee employees staff customer customers "
     "account accounts parcel parcels shipment shipments vehicle vehicles truck trucks unit units", _N, _f(1), _f(0)),
]
# Scale words.
_SCALES = {
    "hundred": 100, "dozen": 12, "dozens": 12, "k": 10**3, "thousand": 10**3, "thousands": 10**3, "000": 10**3,
    "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "lacs": 10**5, "m": 10**6, "mn": 10**6, "mm": 10**6, "mio": 10**6,
    "million": 10**6, "millions": 10**6, "cr": 10**7, "crs": 10**7, "crore": 10**7, "crores": 10**7,
    "b": 10**9, "bn": 10**9, "billion": 10**9, "billions": 10**9, "tn": 10**12, "trillion": 10**12, "trillions": 10**12,
}
# Currencies.
_CURRENCIES = {
    "₹": "INR", "rs": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR", "$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD",
    "dollars": "USD", "us_dollar": "USD", "us_dollars": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "£": "GBP", "gbp": "GBP", "pound_sterling": "GBP", "pounds_sterling": "GBP", "pound": "GBP", "pounds": "GBP", "sterling": "GBP",
}
_POWERS = {"sq": 2, "square": 2, "cu": 3, "cubic": 3}
#: Common units of the catalogue: dimension's unit as (factor to base, offset).
COMMON = {
    "SQ_M": (_f(1), _f(0)), "TONNE": (_f(1000), _f(0)), "KM": (_f(1000), _f(0)), "KWH": (_f(3600000), _f(0)),
    "LITRE": (_f("0.001"), _f(0)), "PERCENT": (_f("0.01"), _f(0)), "COUNT": (_f(1), _f(0)), "DAY": (_f(86400), _f(0)),
    "CELSIUS": (_f(1), _f("273.15")),
}


def _readings() -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for names, vector, factor, offset in _UNITS:
        for name in names.split():
            out.setdefault(name, []).append(("unit", vector, factor, offset))
    for name, code in _CURRENCIES.items():
        out.setdefault(name, []).append(("money", code))
    for name, n in _SCALES.items():
        out.setdefault(name, []).append(("scale", _f(n)))
    for name, n in _POWERS.items():
        out.setdefault(name, []).append(("power", n))
    return out


_READINGS = _readings()
_LONGEST = 3  # words that a compound name such as "degrees_celsius" has at most
_TERM = re.compile(r"us\$|[°℃℉%‰₹$€£]\s?[cf]?(?![a-z])|[°℃℉%‰₹$€£]|000|[a-z]+|[²³]|\^[23]")


_Parsed = tuple[str | None, Fraction | None, tuple[Fraction, Fraction] | None]
#: Texts up to this length are remembered with what they state.
_REMEMBERED = 80


def parse_unit(text: str, dimension: str) -> _Parsed:
    """(currency, scale, unit) that ``text`` states for ``dimension``.

    Each is None where it is not stated or does not fit; ``unit`` is (factor,
    offset) to the base unit. Words that are no terms are skipped.
    """
    return _remembered(text, dimension) if len(text) <= _REMEMBERED else _parse(text, dimension)


@lru_cache(maxsize=50_000)
def _remembered(text: str, dimension: str) -> _Parsed:
    return _parse(text, dimension)


def _terms(text: str) -> list[str]:
    # letter case separates nothing here: kwh, KWH and kWh are one unit
    words = [w.replace(" ", "") for w in _TERM.findall(text.lower().replace("sq.", "sq ").replace("cu.", "cu "))]
    terms, i = [], 0
    while i < len(words):
        for n in range(min(_LONGEST, len(words) - i), 0, -1):
            name = "_".join(words[i : i + n])
            if name in _READINGS or (n == 1 and re.fullmatch(r"[²³]|\^[23]", name)):
                terms.append(name)
                i += n
                break
        else:
            i += 1
    return terms


def _parse(text: str, dimension: str) -> _Parsed:
    want = DIMENSIONS[dimension]
    # (currency, unit, open power, whether a power may follow the unit) -> (terms used, scale), in order of the first readings
    states = {(None, None, 1, False): (0, None)}
    for term in _terms(text):
        after: dict[tuple, tuple[int, Fraction | None]] = {}
        for state, (used, scale) in states.items():
            for reading in _read(term):
                if (to := _after(state, reading, want, dimension)) is not None:
                    factor = (scale or 1) * reading[1] if reading[0] == "scale" else scale
                    if to not in after or after[to][0] < used + 1:
                        after.pop(to, None)
                        after[to] = (used + 1, factor)
            if state not in after or after[state][0] < used:
                after.pop(state, None)
                after[state] = (used, scale)
        states = after
    done = [(used, currency, scale, unit) for (currency, unit, power, _), (used, scale) in states.items() if power == 1 and (unit is None or unit[0] == want)]
    _, currency, scale, unit = max(done, key=lambda d: d[0])
    return currency, scale, unit and unit[1:]


def _read(term: str) -> list[tuple]:
    return _READINGS[term] if term in _READINGS else [("after", 2 if term[-1] in "²2" else 3)]


def _after(state: tuple, reading: tuple, want: tuple[int, ...], dimension: str) -> tuple | None:
    """The state that a term's reading leads to, None if it doesn't fit."""
    currency, unit, power, open_ = state
    kind = reading[0]
    if kind == "scale":
        return state
    if kind == "money":
        return (reading[1], unit, power, open_) if dimension == "money" and currency in (None, reading[1]) else None
    if kind == "power":
        return currency, unit, reading[1], open_
    if kind == "after":
        return (currency, _raised(unit, reading[1]), power, False) if open_ else None
    if unit is not None or dimension == "money":
        return None
    unit = _raised(reading[1:4], power)
    # a unit that no power can bring to the dimension leads nowhere
    return (currency, unit, 1, True) if any(_raised(unit, n)[0] == want for n in (1, 2, 3)) else None


def _raised(unit: tuple, power: int) -> tuple:
    vector, factor, offset = unit
    return tuple(e * power for e in vector), factor**power, offset


_THOUSAND = re.compile(r"(?<![\d])\s*['’‘`]000\b")
_NUMBER = re.compile(r"(\(\s*)?([-−–]\s?)?(\d(?:[\d.,'’]|[ \u00a0\u202f\u2009](?=\d{3}(?!\d)))*)(\s*\))?")


def _ascii_digits(text: str) -> str:
    """``text`` with the decimal digits of all scripts as ASCII digits."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def parse_number(text: str) -> tuple[int, int, str] | None:
    """(mantissa, decimals, rest) of the first number of ``text``, or None.

    The decimal mark is the last of ``.`` and ``,`` when both occur; a lone
    comma before exactly three digits, or several commas, part thousands, other
    lone commas are decimal; several points part thousands. A minus sign or
    parentheses around the number make it negative.
    """
    t = _thousands(_ascii_digits(text))
    m = _NUMBER.search(t)
    return (*_value(m), t[: m.start()] + " " + t[m.end() :]) if m else None


def _thousands(t: str) -> str:
    """``t`` with a quoted 000 after a number as the word that it stands for."""
    return re.sub(r"(?<=\s)['’‘`]000\b|^['’‘`]000\b", " thousand ", t) if "000" in t else t


def _value(m: re.Match) -> tuple[int, int]:
    """(mantissa, decimals) of a match of a number."""
    digits = re.sub(r"['’ \u00a0\u202f\u2009]", "", m[3]).rstrip(".,")
    point, comma = digits.count("."), digits.count(",")
    if point and comma:
        mark = "." if digits.rfind(".") > digits.rfind(",") else ","
    elif comma == 1:
        whole, part = digits.split(",")
        mark = "," if len(part) != 3 or whole.strip("0") == "" else None
    elif point == 1:
        mark = "."
    else:
        mark = None
    whole, _, part = digits.rpartition(mark) if mark else (digits, "", "")
    whole = re.sub(r"[.,]", "", whole)
    negative = bool(m[2]) or bool(m[1] and m[4])
    mantissa = int((whole or "0") + part)
    return (-mantissa if negative else mantissa), len(part)


# Number words, and those that stand for parts of one.
_NUMBER_WORDS = {w: n for n, w in enumerate(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
)} | {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SPELT = re.compile(rf"\b(minus\s+|negative\s+)?({'|'.join(sorted(_NUMBER_WORDS, key=len, reverse=True))})(?:[\s-]+({'|'.join(list(_NUMBER_WORDS)[1:10])}))?\b(?!\s*-)", re.I)
_EXPONENT = re.compile(r"\s*(?:[eE]|[x×*·]\s*10\s*\^?)\s*([-+−]?)(\d{1,3})(?![\w.])")
_SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
_RAISED_TEN = re.compile(r"([x×*·]\s*10)\s*([⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)")
_FRACTION = re.compile(r"(?<![\d/.,])(\d{1,3})\s?/\s?(\d{1,3})(?![\d/.,])")
_PART = re.compile(r"\s?([½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞])")


def stated_number(text: str) -> tuple[Fraction, str] | None:
    """(number, rest) of the first number of ``text``: digits of any script, with a power of ten or a fraction, or number words."""
    t = _ascii_digits(text)
    if "10" in t:
        t = _RAISED_TEN.sub(lambda m: f"{m[1]}^{m[2].translate(_SUPERSCRIPTS)}", t)
    # 1½, ½ and 1 1/2; the sign and the parentheses stay where they are
    extra, part = Fraction(0), None
    if not t.isascii() and (part := _PART.search(t)):
        extra = Fraction(unicodedata.numeric(part[1])).limit_denominator(8)
    elif "/" in t and (part := _FRACTION.search(t)) and int(part[2]) > int(part[1]) > 0:
        extra = Fraction(int(part[1]), int(part[2]))
    if extra:
        before = t[: part.start()].rstrip()
        t = (before if before[-1:].isdigit() else before + " 0") + t[part.end() :]
    t = _thousands(t)
    m = _NUMBER.search(t)
    if m is None:
        return _spelt_number(t)
    mantissa, decimals = _value(m)
    value = Fraction(mantissa, 10**decimals)
    if extra:
        value = -(abs(value) + extra) if mantissa < 0 or m[2] or (m[1] and m[4]) else value + extra
    # a power of ten right after the digits
    tail = t[m.end() :]
    if power := _EXPONENT.match(tail):
        ten = Fraction(10) ** int(power[2])
        value, tail = (value / ten if power[1] in ("-", "−") else value * ten), tail[power.end() :]
    return value, t[: m.start()] + " " + tail


def _spelt_number(t: str) -> tuple[Fraction, str] | None:
    """``stated_number`` of number words."""
    spelt = _SPELT.search(t)
    if not spelt:
        return None
    first, second = _NUMBER_WORDS[spelt[2].lower()], _NUMBER_WORDS[spelt[3].lower()] if spelt[3] else 0
    value = Fraction(first + (second if first >= 20 else 0))
    return (-value if spelt[1] else value), t[: spelt.start()] + " " + t[spelt.end() :]


# what a quote says of all its figures: a noun for figures, then "in" and the unit, in brackets or up to the end of the clause
_FIGURES = r"(?:figures|amounts|values|numbers|quantities|data|sums)"
_SAID = r"(?:(?:are|is|being)\s+)?(?:(?:stated|expressed|given|shown|reported|presented|quoted)\s+)?in"
# a full stop ends a clause unless it ends an abbreviation that goes on with the unit
_CLAUSE = r"((?:[^.;:—\])]|(?<=\brs)\.|(?<=\bsq)\.|(?<=\bcu)\.|(?<=\bno)\.|\([^()]*\))+)"
_HEADERS = (
    re.compile(rf"\[\s*(?:all\s+)?(?:{_FIGURES}\s+)?(?:{_SAID}|in)\s+([^\]]+)\]", re.I),
    re.compile(rf"\(\s*(?:all\s+)?{_FIGURES}\s+{_SAID}\s+((?:[^()]|\([^()]*\))+)\)", re.I),
    re.compile(r"\(([^()]+(?:\([^()]*\))?[^()]*),\s*(?:unless|except)\b[^()]*\)", re.I),
    re.compile(rf"\bunits?\s*[:=]\s*{_CLAUSE}", re.I),
    re.compile(rf"\b{_FIGURES}\s+{_SAID}\s+{_CLAUSE}", re.I),
)


def quoted_units(quote: str | None) -> list[str]:
    """The units that a quote declares for its figures, as written."""
    return [m[1] for pattern in _HEADERS if (m := pattern.search(quote))] if quote else []


def to_common(raw: str | None, canonical_unit: str | None, quote: str | None, dimension: str | None, common: str | None) -> tuple[str, int] | None:
    """(common unit, value times 1000) of a recorded quantity, or None if it states no number.

    What ``raw`` states prevails; what it leaves open comes from
    ``canonical_unit`` or, if that says RAW, from the quote. Amounts keep their
    own currency; without any currency they give None.
    """
    if raw is None or dimension not in DIMENSIONS:
        return None
    number = stated_number(raw)
    if number is None:
        return None
    value, rest = number
    currency, scale, unit = parse_unit(rest, dimension)
    told = (canonical_unit or "").strip()
    others = quoted_units(quote) if told.upper() == "RAW" else [told.replace("_", " ")]
    # the first declaration that means something for the dimension
    currency2, scale2, unit2 = next((p for p in (parse_unit(o, dimension) for o in others) if p != (None, None, None)), (None, None, None))
    if dimension == "money":
        currency = currency or currency2
        if currency is None:
            return None
        return currency, _nearest(value * (scale or scale2 or 1) * 1000)
    if unit is None:
        unit, scale = unit2, scale or scale2
    factor, offset = COMMON[common]
    if unit is None:
        return common, _nearest(value * (scale or 1) * 1000)
    base = (value * (scale or 1) + unit[1]) * unit[0]
    return common, _nearest((base / factor - offset) * 1000)


def _nearest(x: Fraction) -> int:
    """Nearest whole number, halves away from zero."""
    n = (abs(x.numerator) * 2 + x.denominator) // (2 * x.denominator)
    return n if x >= 0 else -n
