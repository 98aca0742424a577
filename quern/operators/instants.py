"""Days and clock times in many forms and zones, as UTC seconds.

An ordered cascade of anchored patterns, all as JVM expressions: a statement is
split into one or two moments, a moment into date, time and zone, and each part
is parsed strictly by the first pattern that matches it whole. A part that no
pattern takes, a day that does not exist or a clock time out of range makes the
moment null; nothing is guessed.

Policy for local times under daylight saving, applied by ``local_to_utc``:

* a time that occurs twice without naming its offset means its first
  occurrence;
* a time that the clocks skip is read with the offset in force before the
  change, that is, it moves forward by the length of the skip.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import let

# Month names and their short forms, by number.
MONTHS = {
    1: "january jan januar jänner enero ene janvier janv janeiro जनवरी января январь",
    2: "february feb februar febrero février fevrier févr fevereiro fev फ़रवरी फ़रवरी फरवरी февраля февраль",
    3: "march mar märz maerz mär marzo mars março मार्च марта март",
    4: "april apr abril abr avril avr अप्रैल апреля апрель",
    5: "may mai mayo maio मई мая май",
    6: "june jun juni junio juin junho जून июня июнь",
    7: "july jul juli julio juillet juil julho जुलाई июля июль",
    8: "august aug agosto ago août aout अगस्त августа август",
    9: "september sep sept septiembre septembre setembro set सितंबर सितम्बर сентября сентябрь",
    10: "october oct oktober okt octubre octobre outubro out अक्टूबर октября октябрь",
    11: "november nov noviembre novembre novembro नवंबर नवम्बर ноября ноябрь",
    12: "december dec dezember dez diciembre dic décembre decembre déc dezembro दिसंबर दिसम्बर декабря декабрь",
}
# Zone abbreviations and their offsets from UTC in seconds.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "bst": 3600, "cet": 3600, "cest": 7200, "ist": 19800, "npt": 20700,
    "sgt": 28800, "jst": 32400, "aest": 36000, "aedt": 39600, "est": -18000, "edt": -14400,
}
_DEVANAGARI = "०१२३४५६७८९"
_ZONE = r"\(?(z|[a-z]{3,4}|(?:utc|gmt)?\s?[+\-−]\d{1,2}(?::?\d{2})?|[a-z]+/[a-z_/+\-0-9]+)\)?"
_HALF = r"\s?[ap]\.?m\.?(?![a-z])"
_TIME = rf"\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?(?:{_HALF})?|\d{{1,2}}\.\d{{2}}{_HALF}|\d{{1,2}}{_HALF}|\d{{1,2}}h\d{{2}}|\d{{4}}\s?hrs?"
_DATE_FIRST = rf"(?i)^(.*?\d)(?:t|,?\sat\s|,\s?|\s)({_TIME})(?:\s?{_ZONE})?$"
_TIME_FIRST = rf"(?i)^({_TIME})(?:\s?{_ZONE})?(?:,\s?|,?\son\s)(.*\d)$"
_DATE_ONLY = rf"(?i)^(.*\d)\s{_ZONE}$"
_COMPACT = r"(?i)^(\d{8})t(\d{2})(\d{2})(\d{2})?(z|[+\-]\d{4})?$"
_LEAD = r"(?i)^(?:as\s(?:of|on|at)|dated|ended|on|w\.e\.f\.|with effect from|effective(?:\sfrom)?)\s+"
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_BAR = "\u0001"


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def tidy(text: Column) -> Column:
    """Digits as ASCII, one kind of blank, no blanks at the ends."""
    t = F.translate(text, _DEVANAGARI + "\u00a0\u202f\u2009", "0123456789   ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def moments(text: Column) -> Column:
    """The one or two statements of ``text``: array<string>, in order."""
    bar = f"$1{_BAR}$2"
    t = F.regexp_replace(tidy(text), _LEAD, "")
    t = F.regexp_replace(t, r"(?i)^between (.+) and (.+)$", bar)
    t = F.regexp_replace(t, r"(?i)^(?:from )?(.+) (?:to|until|till) (.+)$", bar)
    return F.split(F.regexp_replace(t, r"^(.+?) [—–-] (.+)$", bar), _BAR)


def _unless_split(pattern: str, to: str):
    return lambda x: F.when(F.contains(x, F.lit(_BAR)), x).otherwise(F.regexp_replace(x, pattern, to))


def _parts(m: Column) -> Column:
    """[date, time, zone] of a moment; a text that no pattern takes is its own date."""
    t = F.regexp_replace(F.trim(m), _COMPACT, f"$1{_BAR}$2:$3:$4{_BAR}$5")
    t = F.regexp_replace(t, r":(?=\u0001)", "")
    for pattern, to in ((_DATE_FIRST, f"$1{_BAR}$2{_BAR}$3"), (_TIME_FIRST, f"$3{_BAR}$1{_BAR}$2"), (_DATE_ONLY, f"$1{_BAR}{_BAR}$2")):
        t = let(t, _unless_split(pattern, to))
    return F.split(t, _BAR)


def _date_fields(d: Column, day_first: Column) -> Column:
    """``year|month|day``, ``year|w<week>|day`` or the text as it was."""
    t = F.regexp_replace(F.regexp_replace(d, _WEEKDAY, ""), r",$", "")
    t = F.regexp_replace(t, r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", f"$1{_BAR}$3{_BAR}$4")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", f"$1{_BAR}$2{_BAR}$3")
    t = F.regexp_replace(t, r"(?i)^(\d{4})-?(w\d{2})-?([1-7])$", f"$1{_BAR}$2{_BAR}$3")
    numeric = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$"
    order = F.when(day_first, F.lit(f"$4{_BAR}$3{_BAR}$1")).otherwise(F.lit(f"$4{_BAR}$1{_BAR}$3"))
    t = F.regexp_replace(t, F.lit(numeric), order)
    name = r"([^\d\s.,/\-]{2,})"
    t = F.regexp_replace(t, rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th|er|º|\.)?[\s-](?:de\s|of\s)?{name}\.?,?[\s-](?:de\s)?(\d{{4}}|\d{{2}})$", f"$3{_BAR}$2{_BAR}$1")
    return F.regexp_replace(t, rf"(?i)^{name}\.?\s(\d{{1,2}})(?:st|nd|rd|th)?,?\s(\d{{4}})$", f"$3{_BAR}$1{_BAR}$2")


def _month_map() -> Column:
    pairs = {name: n for n, names in MONTHS.items() for name in names.split()}
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def _days(f: Column) -> Column:
    """Day number of the split date fields; null unless such a day exists."""
    y = _int(F.try_element_at(f, F.lit(1)))
    year = F.when(F.length(F.try_element_at(f, F.lit(1))) == 2, y + 2000).otherwise(y)
    month_text = F.lower(F.try_element_at(f, F.lit(2)))
    month = F.coalesce(_int(month_text), F.try_element_at(_month_map(), month_text))
    day = _int(F.try_element_at(f, F.lit(3)))
    ymd = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    week = _int(F.regexp_extract(month_text, r"^w(\d{2})$", 1))
    # ISO week 1 holds 4 January; weeks start on Monday
    jan4 = F.try_to_date(F.format_string("%04d-01-04", year), "yyyy-MM-dd")
    monday = F.date_sub(jan4, F.weekday(jan4))
    in_week = F.date_add(monday, (week - 1) * 7 + day - 1)
    exists = (week >= 1) & (F.weekofyear(in_week) == week)
    return F.when(
        F.size(f) == 3, F.unix_date(F.when(week.isNotNull(), F.when(exists, in_week)).when(year.isNotNull() & month.isNotNull() & day.isNotNull(), ymd))
    ).cast("bigint")


def _clock(t: Column) -> Column:
    """``hour|minute|second|a or p`` of a time; blank parts were not stated."""
    c = F.regexp_replace(F.lower(t), r"^(\d{1,2})[:.h](\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s?(?:([ap])\.?m\.?)?$", f"$1{_BAR}$2{_BAR}$3{_BAR}$4")
    c = F.regexp_replace(c, r"^(\d{1,2})\s?([ap])\.?m\.?$", f"$1{_BAR}{_BAR}{_BAR}$2")
    return F.split(F.regexp_replace(c, r"^(\d{2})(\d{2})\s?hrs?$", f"$1{_BAR}$2{_BAR}{_BAR}"), _BAR)


def _offset(zone: Column) -> Column:
    """Seconds from UTC of a fixed offset or abbreviation, else null."""
    z = F.regexp_replace(F.lower(zone), r"^(?:utc|gmt)\s?(?=[+\-−])", "")
    short = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ABBREVIATIONS.items()))
    numeric = r"^([+\-−])(\d{1,2}):?(\d{2})?$"
    hours, minutes = _int(F.regexp_extract(z, numeric, 2)), _int(F.regexp_extract(z, numeric, 3))
    sign = F.when(F.regexp_extract(z, numeric, 1) == "+", 1).otherwise(-1)
    inside = (hours <= 14) & (F.coalesce(minutes, F.lit(0)) < 60)
    return F.coalesce(F.try_element_at(short, z), F.when(inside, sign * (hours * 3600 + F.coalesce(minutes, F.lit(0)) * 60)))


def _region_map() -> Column:
    """Lower-case zone id -> id, of the public zone database that Python ships or the system has."""
    import zoneinfo

    names = sorted(n for n in zoneinfo.available_timezones() if "/" in n and not n.startswith(("Etc/", "SystemV/", "posix/", "right/")))
    return F.create_map(*chain.from_iterable((F.lit(n.lower()), F.lit(n)) for n in names))


def local_to_utc(local: Column, zone: Column) -> Column:
    """UTC seconds of local seconds in a region, by the policy in the module's docstring."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as 2024-03-31T18:29:59Z, whatever the session's zone."""
    day = F.floor(seconds / 86400)
    rest = (seconds - day * 86400).cast("int")
    part = lambda n, per, of: F.lpad((F.floor(n / per) % of).cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"),
        part(rest, 3600, 24), F.lit(":"), part(rest, 60, 60), F.lit(":"), part(rest, 1, 60), F.lit("Z"),
    )


def _moment(m: Column, zone: Column, day_first: Column) -> Column:
    """struct(s, e): first and last UTC second of one moment, null where it states no day."""
    epoch = F.when(m.rlike(r"^\d{10}$"), m.try_cast("bigint")).when(m.rlike(r"^\d{13}$"), F.floor(m.try_cast("bigint") / 1000))
    return let(epoch, lambda x: F.when(x.isNotNull(), F.struct(x.alias("s"), x.alias("e"))).otherwise(let(_parts(m), lambda p: _worded(p, zone, day_first))))


def _worded(p: Column, zone: Column, day_first: Column) -> Column:
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)), F.lit(""))
    day = let(F.split(_date_fields(part(1), day_first), _BAR), _days)
    timed = part(2) != ""
    clock = let(F.when(timed, _clock(part(2))), _clock_span)
    named = F.nullif(part(3), F.lit(""))
    facts = F.struct(
        day.alias("d"), timed.alias("t"), clock["c"].alias("c"), clock["n"].alias("n"), let(named, _offset).alias("o"),
        F.when(named.isNull(), zone).when(named.contains("/"), F.try_element_at(_region_map(), F.lower(named))).alias("g"),
    )
    return let(facts, _seconds)


def _clock_span(t: Column) -> Column:
    """struct(c, n): second of the day and number of seconds of the split clock fields."""
    at = lambda i: _int(F.try_element_at(t, F.lit(i)))
    fields = F.struct(at(1).alias("h"), at(2).alias("m"), at(3).alias("s"), F.try_element_at(t, F.lit(4)).alias("p"), F.size(t).alias("z"))

    def span(f: Column) -> Column:
        hour = F.when(f["p"] == "", F.when(f["h"] <= 23, f["h"])).when(f["h"].between(1, 12), f["h"] % 12 + F.when(f["p"] == "p", 12).otherwise(0))
        minute, second = F.coalesce(f["m"], F.lit(0)), F.coalesce(f["s"], F.lit(0))
        clock = F.when((f["z"] == 4) & (minute < 60) & (second < 60), hour * 3600 + minute * 60 + second)
        return F.struct(clock.alias("c"), F.when(f["s"].isNotNull(), 1).when(f["m"].isNotNull(), 60).otherwise(3600).alias("n"))

    return let(fields, span)


def _seconds(f: Column) -> Column:
    # a day ends where the next one begins, so it has its full local length
    utc = lambda x: F.when(f["o"].isNotNull(), x - f["o"]).when(f["g"].isNotNull(), local_to_utc(x, f["g"]))
    start = f["d"] * 86400 + F.when(f["t"], f["c"]).otherwise(0)
    whole_day = F.struct(utc(start).alias("s"), (utc(start + 86400) - 1).alias("e"))
    timed = let(utc(start), lambda s: F.struct(s.alias("s"), (s + f["n"] - 1).alias("e")))
    return F.when(f["t"], timed).otherwise(whole_day)


def stated_span(text: Column, zone: Column, day_first: Column) -> Column:
    """struct(first, last): the UTC seconds that ``text`` covers.

    ``zone`` is the default zone, ``day_first`` tells how to read all-numeric
    dates whose year comes last. One moment covers its whole day, hour, minute
    or second; of two moments the first gives the beginning, the second the
    end. Both fields are null where ``text`` states no existing day (null,
    empty and coarser statements included).
    """
    def span(x: Column) -> Column:
        two = F.size(x) == 2
        whole = F.size(x).isin(1, 2) & ~F.exists(x, lambda y: y["s"].isNull())
        return F.struct(
            F.when(whole, x[0]["s"]).alias("first"),
            F.when(whole, F.when(two, F.try_element_at(x, F.lit(2))["e"]).otherwise(x[0]["e"])).alias("last"),
        )

    return let(F.transform(moments(text), lambda m: _moment(m, zone, day_first)), span)


def fact_instants(facts: DataFrame, source_docs: DataFrame) -> DataFrame:
    """First and last UTC second of point-in-time facts: (fact_id, start_utc, end_utc).

    Facts whose granularity is EXACT_DATE or UNKNOWN (any case) or null. What
    ``temporal_raw`` states prevails; if it states no existing day, the start
    of what ``start_date`` states and the end of what ``end_date`` states are
    taken, either alone standing for both. Facts that state no day give no
    row; repeated deliveries that mean the same give one row. Documents missing
    from ``source_docs`` count as UTC with the day first.
    """
    grain = F.upper(F.trim("granularity"))
    wanted = facts.where(F.col("granularity").isNull() | grain.isin("EXACT_DATE", "UNKNOWN"))
    docs = source_docs.select("doc_hash", F.col("time_zone").alias("_zone"), (F.upper("date_order") == "MDY").alias("_mdy"))
    known = wanted.join(docs, "doc_hash", "left").select(
        "fact_id", "temporal_raw", "start_date", "end_date",
        F.coalesce("_zone", F.lit("UTC")).alias("_zone"), (~F.coalesce("_mdy", F.lit(False))).alias("_dmy"),
    )
    digits = lambda t: F.when(t.rlike("[0-9०-९]"), t)
    read = lambda t: stated_span(digits(t), F.col("_zone"), F.col("_dmy"))
    # the bounds are only read where the statement itself names no day
    known = known.withColumn("_own", read(F.col("temporal_raw")))
    bounds = F.when(F.col("_own.first").isNull(), F.transform(F.array("start_date", "end_date"), read))
    known = known.withColumn("_bounds", bounds)
    first = F.coalesce("_own.first", F.col("_bounds")[0]["first"], F.col("_bounds")[1]["first"])
    last = F.coalesce("_own.last", F.col("_bounds")[1]["last"], F.col("_bounds")[0]["last"])
    return (
        known.select("fact_id", first.alias("_f"), last.alias("_l"))
        .where(F.col("_f").isNotNull())
        .select("fact_id", utc_text(F.col("_f")).alias("start_utc"), utc_text(F.col("_l")).alias("end_utc"))
        .distinct()
    )
