"""Periods as typed (fiscal, quarterly, calendar, single days) and how two of them relate."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let, strip
from quern.functions.values import ascii_digits

# Texts that mean a period without end.
PERPETUAL_TEXTS = ("none", "perpetual", "unknown", "since inception")
# Relations of two closed intervals.
EQUAL, DISJOINT, SUBSET, SUPERSET, OVERLAPPING, PERPETUAL = "EQUAL", "DISJOINT", "SUBSET", "SUPERSET", "OVERLAPPING", "PERPETUAL"
# The months' names, which their first three letters stand for too.
MONTHS = "january february march april may june july august september october november december".split()
# A dated day and a fiscal year in running text.
DATED = r"(?:as of|dated|ended)\s+(?:[a-z]+\s+\d{1,2},\s*\d{4}|\d{1,2}\s+[a-z]+\s+\d{4})"
FISCAL = r"\b(?:fy\s*20\d\d|fy\s*\d\d|fiscal\s*20\d\d|fiscal\s*\d\d)\b"
# A fiscal year of a page, a quarter and a year of a quote, and what has no end.
PAGE_FISCAL = r"\b(?:fy\s*20\d\d|fy\s*\d\d|fiscal\s*20\d\d)\b"
QUARTER, YEAR, EVER = r"\bq[1-4]\s*(?:fy\s*\d\d|20\d\d)?\b", r"\b(?:19|20)\d\d\b", r"\bsince inception\b"


def _year(text: Column) -> Column:
    n = F.nullif(text, F.lit("")).try_cast("int")
    return F.when(n < 100, n + 2000).otherwise(n)


def single_day(text: Column) -> Column:
    """Day of a written date (month name, day and year, in the two usual orders), as a date, or null."""
    t = F.regexp_replace(strip(text), r"(?i)^(?:as of|dated|ended)\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1"), r"\s+", " ")
    months = F.create_map(*chain.from_iterable((F.lit(k), F.lit(f"{n:02}")) for n, m in enumerate(MONTHS, 1) for k in dict.fromkeys((m, m[:3]))))
    part = lambda t, i: F.regexp_extract(t, r"^([a-z]+) (\d{1,2}),? (\d{4})$|^(\d{1,2}) ([a-z]+) (\d{4})$", i)
    either = lambda t, i, j: F.concat(part(t, i), part(t, j))
    iso = lambda t: F.concat_ws("-", either(t, 3, 6), F.try_element_at(months, either(t, 1, 5)), F.lpad(either(t, 2, 4), 2, "0"))
    # without a month name there are two parts only, which are no date
    return let(F.lower(t), lambda t: F.when(F.regexp_like(t, F.lit("[a-z] .*[0-9]{4}$")), F.when(F.length(iso(t)) == 10, iso(t)).try_cast("date")))


def stated_period(expr: Column) -> Column:
    """struct(start_date, end_date, granularity, raw) of a period as typed.

    Fiscal years end on 31 March; one year names the year of the end, a range
    is taken as written, a range's short end takes its start's century. A text
    with a hyphen counts as fiscal, dates in ISO form included: that is the
    recorded data's rule. Each pattern is searched once.
    """
    pattern = r"(\d{2,4})(?:[-/](\d{2,4}))?"
    get = lambda a, p, i: F.nullif(F.regexp_extract(a, p, i), F.lit(""))
    found = lambda t: let(ascii_digits(t), lambda a: F.struct(
        t.alias("t"), F.lower(t).alias("low"), _year(get(a, pattern, 1)).alias("first"), get(a, pattern, 2).try_cast("int").alias("second"),
        get(a, r"(?i)Q([1-4])", 1).cast("int").alias("q"), get(a, r"(?i)^(?:CY\s*)?(\d{2,4})$", 1).alias("cal"),
    ))
    return let(let(strip(expr), found), lambda p: _period(expr, p))


def _period(expr: Column, p: Column) -> Column:
    """``stated_period`` from what its patterns found."""
    day = lambda y, md: F.concat(y.cast("string"), F.lit("-") if isinstance(md, Column) else F.lit("-" + md), *([md] if isinstance(md, Column) else []))
    year = lambda y, first, last: F.struct(day(y, first).alias("s"), day(y, last).alias("e"))
    fiscal = p["first"].isNotNull() & (F.contains(p["low"], F.lit("fy")) | F.contains(p["low"], F.lit("fiscal")) | F.contains(p["low"], F.lit("-")))
    end = F.when(p["second"].isNull(), p["first"]).when(p["second"] < 100, F.floor(p["first"] / 100).cast("int") * 100 + p["second"]).otherwise(p["second"])
    start = F.when(p["second"].isNull(), p["first"] - 1).otherwise(p["first"])
    starts, ends = F.array(*map(F.lit, ("04-01", "07-01", "10-01", "01-01"))), F.array(*map(F.lit, ("06-30", "09-30", "12-31", "03-31")))
    in_year = F.when(p["q"] == 4, end).otherwise(start)
    calendar = p["cal"].isNotNull() & (F.contains(p["low"], F.lit("cy")) | (F.length(p["cal"]) == 4))
    blank = expr.isNull() | (expr == "") | p["low"].isin(*PERPETUAL_TEXTS)
    none = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("e"))
    one = lambda kind, bounds: F.struct(F.lit(kind).alias("kind"), bounds.alias("b"))
    exact = let(single_day(p["t"]).cast("string"), lambda d: F.when(d.isNotNull(), one("EXACT_DATE", F.struct(d.alias("s"), d.alias("e")))).otherwise(one("UNKNOWN", none)))
    chosen = (
        F.when(blank, one("PERPETUAL", none))
        .when(fiscal & p["q"].isNotNull(), one("QUARTER", F.struct(day(in_year, F.get(starts, p["q"] - 1)).alias("s"), day(in_year, F.get(ends, p["q"] - 1)).alias("e"))))
        .when(fiscal, one("YEAR", F.struct(day(start, "04-01").alias("s"), day(end, "03-31").alias("e"))))
        .when(calendar, one("YEAR", year(_year(p["cal"]), "01-01", "12-31")))
        .otherwise(exact)
    )
    return let(chosen, lambda c: F.struct(
        c["b"]["s"].alias("start_date"), c["b"]["e"].alias("end_date"), c["kind"].alias("granularity"),
        F.when(c["kind"] == PERPETUAL, F.coalesce(F.nullif(expr, F.lit("")), F.lit("PERPETUAL"))).otherwise(p["t"]).alias("raw"),
    ))


def _get(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + pattern, 0), F.lit(""))


def page_hints(page: Column) -> Column:
    """struct(ever, dated, around): what ``temporal_hint`` needs of a page, so that quotes don't have to carry its text."""
    p = F.coalesce(page, F.lit(""))
    return F.struct(F.regexp_like(p, F.lit("(?i)" + EVER)).alias("ever"), _get(p, DATED).alias("dated"), _get(p, PAGE_FISCAL).alias("around"))


def hinted_period(quote: Column, hints: Column) -> Column:
    """``temporal_hint`` from a page's ``page_hints``."""
    ends = lambda c: _year(F.regexp_extract(c, r"\d+", 0))
    row = lambda s, e, g, r: F.struct(s.cast("string").alias("start_date"), e.cast("string").alias("end_date"), F.lit(g).alias("granularity"), r.alias("raw"))
    none = F.lit(None)
    fy = lambda c, r: let(ends(c), lambda y: row(F.concat((y - 1).cast("string"), F.lit("-04-01")), F.concat(y.cast("string"), F.lit("-03-31")), "YEAR", r))
    own = lambda q: F.struct(_get(q, DATED).alias("dated"), _get(q, FISCAL).alias("fiscal"), _get(q, QUARTER).alias("quarter"), _get(q, YEAR).alias("year"), F.regexp_like(q, F.lit("(?i)" + EVER)).alias("ever"))
    return let(F.struct(own(F.coalesce(quote, F.lit(""))).alias("q"), hints.alias("p")), lambda x: (
        F.when(x["q"]["ever"] | x["p"]["ever"], row(none, none, "PERPETUAL", F.lit("since inception")))
        .when(F.coalesce(x["q"]["dated"], x["p"]["dated"]).isNotNull(), row(none, none, "EXACT_DATE", strip(F.coalesce(x["q"]["dated"], x["p"]["dated"]))))
        .when(x["q"]["fiscal"].isNotNull(), fy(x["q"]["fiscal"], strip(x["q"]["fiscal"])))
        .when(x["q"]["quarter"].isNotNull(), row(none, none, "QUARTER", strip(x["q"]["quarter"])))
        .when(x["q"]["year"].isNotNull(), row(F.concat(x["q"]["year"], F.lit("-01-01")), F.concat(x["q"]["year"], F.lit("-12-31")), "YEAR", x["q"]["year"]))
        .when(x["p"]["around"].isNotNull(), fy(x["p"]["around"], F.concat(strip(x["p"]["around"]), F.lit(" (page context)"))))
    ))


def temporal_hint(quote: Column, page: Column) -> Column:
    """struct(start_date, end_date, granularity, raw): the horizon a quote states, else the one of its page; null if neither does.

    In order: since inception (quote or page), a dated day (quote, else page),
    a fiscal year, a quarter, a year of the quote, a fiscal year of the page.
    """
    return hinted_period(quote, page_hints(page))


def interval_relation(s1: Column, e1: Column, g1: Column, s2: Column, e2: Column, g2: Column) -> Column:
    """Relation of two closed intervals whose bounds are compared as text.

    A missing bound or a PERPETUAL granularity on either side gives PERPETUAL.
    """
    missing = lambda c: c.isNull() | (c == "")
    open_ = missing(s1) | missing(e1) | missing(s2) | missing(e2)
    ever = F.coalesce(g1 == PERPETUAL, F.lit(False)) | F.coalesce(g2 == PERPETUAL, F.lit(False))
    return (
        F.when(ever | open_, F.lit(PERPETUAL))
        .when((s1 == s2) & (e1 == e2), F.lit(EQUAL))
        .when((e1 < s2) | (e2 < s1), F.lit(DISJOINT))
        .when((s1 >= s2) & (e1 <= e2), F.lit(SUBSET))
        .when((s1 <= s2) & (e1 >= e2), F.lit(SUPERSET))
        .otherwise(F.lit(OVERLAPPING))
    )
