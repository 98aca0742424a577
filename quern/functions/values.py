"""Value expressions: numbers with scales and units as typed, and their comparison."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let, strip

# Scale words of recorded values, and currency marks in order of precedence.
MULTIPLIERS = {
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "trillion": 1e12, "tn": 1e12,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "million": 1e6, "millions": 1e6, "mn": 1e6, "thousand": 1e3, "k": 1e3,
}
CURRENCY_MARKS = (
    ("₹", "INR"), ("rs", "INR"), ("inr", "INR"), ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"),
    ("£", "GBP"), ("gbp", "GBP"), ("¥", "JPY"), ("jpy", "JPY"),
)
PERCENT_MARKS = ("%", "percent", "ratio")
TOLERANCE = 0.005
# Scales of extracted values, first match counts.
EXTRACTED_SCALES = ((r"crores?|cr", 1e7), (r"lakhs?|l", 1e5), (r"billion|bn|b", 1e9), (r"million|mn|m", 1e6), (r"thousand|k", 1e3))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def value_and_unit(raw: Column, unit: Column) -> Column:
    """struct(value double, unit string) of a recorded value and its unit hint.

    The unit is the first currency mark contained in either, else COUNT; any
    percent mark overrides it. The first number is scaled by the first scale
    word. Blank values give (null, RAW). Marks are looked for inside words, and
    scales glued to digits do not count: both are the recorded data's rules.
    """
    texts = let(strip(F.coalesce(raw, F.lit(""))), lambda v: F.struct(v.alias("value"), F.lower(F.concat(v, F.lit(" "), strip(F.coalesce(unit, F.lit(""))))).alias("both")))
    return let(texts, lambda x: _value_and_unit(x["value"], x["both"]))


def _value_and_unit(value: Column, both: Column) -> Column:
    money = reduce(lambda c, m: c.when(F.contains(both, F.lit(m[0])), F.lit(m[1])), CURRENCY_MARKS[1:], F.when(F.contains(both, F.lit(CURRENCY_MARKS[0][0])), F.lit(CURRENCY_MARKS[0][1])))
    percent = reduce(lambda c, m: c | F.contains(both, F.lit(m)), PERCENT_MARKS[1:], F.contains(both, F.lit(PERCENT_MARKS[0])))
    kind = F.when(percent, F.lit("PERCENT")).otherwise(money.otherwise(F.lit("COUNT")))
    digits = F.regexp_replace(F.replace(ascii_digits(value), F.lit(","), F.lit("")), r"[^\d.\-]", " ")
    number = F.nullif(F.regexp_extract(digits, r"[-+]?\d*\.?\d+", 0), F.lit("")).try_cast("double")
    scales = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in MULTIPLIERS.items()))
    word = F.regexp_extract(both, r"\b(" + "|".join(MULTIPLIERS) + r")\b", 1)
    scaled = number * F.coalesce(F.try_element_at(scales, word), F.lit(1.0))
    blank = value == ""
    return F.struct(F.when(~blank, scaled).alias("value"), F.when(blank, F.lit("RAW")).otherwise(kind).alias("unit"))


def extracted_number(text: Column) -> Column:
    """Number of an extracted value (double), null if what is left after marks and one scale is no number."""
    return let(strip(F.regexp_replace(text, r"₹|\$|Rs\.?|INR|,", "")), _scaled_number)


def _scaled_number(t: Column) -> Column:
    alone = lambda p: rf"(?i)\b(?:{p})\b"
    first = reduce(lambda c, x: c.when(F.regexp_like(t, F.lit(alone(x[1][0]))), x[0]), list(enumerate(EXTRACTED_SCALES))[1:], F.when(F.regexp_like(t, F.lit(alone(EXTRACTED_SCALES[0][0]))), 0)).otherwise(-1)
    removed = lambda n: reduce(lambda c, x: c.when(n == x[0], F.regexp_replace(t, alone(x[1][0]), "")), list(enumerate(EXTRACTED_SCALES))[1:], F.when(n == 0, F.regexp_replace(t, alone(EXTRACTED_SCALES[0][0]), "")))
    unscaled = F.when(F.endswith(t, F.lit("%")), F.replace(t, F.lit("%"), F.lit(""))).otherwise(t)
    scales = F.array(*(F.lit(v) for _, v in EXTRACTED_SCALES))
    number = lambda b: F.when(b.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), b.try_cast("double"))
    bare = lambda n: strip(F.regexp_replace(strip(removed(n).otherwise(unscaled)), r"^[>~<]+", ""))
    return let(first, lambda n: let(bare(n), number) * F.coalesce(F.get(scales, n), F.lit(1.0)))


def numbers_match(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two doubles agree within a relative tolerance; both zero agree; null never does."""
    close = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(tolerance)
    return F.coalesce(((a == 0) & (b == 0)) | close, F.lit(False))


def value_text(number: Column, text: Column) -> Column:
    """The text that a value is compared by where one of the two is no number; null if it has neither."""
    return F.lower(strip(F.coalesce(F.when(number.isNotNull(), F.coalesce(text, number.cast("string"))), text)))


def values_match(num_a: Column, str_a: Column, num_b: Column, str_b: Column, tolerance: float = TOLERANCE) -> Column:
    """Agreement of two values kept as (number, text) pairs.

    Numbers are compared as numbers; otherwise the texts, trimmed and in lower
    case. A value that has neither is null and matches nothing.
    """
    numeric = num_a.isNotNull() & num_b.isNotNull()
    return F.when(numeric, numbers_match(num_a, num_b, tolerance)).otherwise(F.coalesce(value_text(num_a, str_a) == value_text(num_b, str_b), F.lit(False)))


def typed_values_match(num_a: Column, str_a: Column, bool_a: Column, num_b: Column, str_b: Column, bool_b: Column, tolerance: float = TOLERANCE) -> Column:
    """``values_match`` of values that may be booleans too (at most one of the three columns of a value is not null).

    Booleans count as the numbers 0 and 1 against numbers and each other;
    against a text they are compared by its truth, which only '' lacks.
    """
    number = lambda n, b: F.coalesce(n, b.cast("double"))
    boolean = bool_a.isNotNull() | bool_b.isNotNull()
    true = lambda s, b: F.coalesce(b, s != "")
    mixed = boolean & (number(num_a, bool_a).isNull() | number(num_b, bool_b).isNull())
    truth = F.coalesce(true(str_a, bool_a) == true(str_b, bool_b), F.lit(False))
    return F.when(mixed, truth).otherwise(values_match(number(num_a, bool_a), str_a, number(num_b, bool_b), str_b, tolerance))
