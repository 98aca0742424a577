import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions.units import parse_number, parse_unit, to_common
from quern.operators.instants import fact_instants
from quern.operators.periods import continuous_periods, day_bound, fact_periods
from quern.operators.quantities import convert_quantities
from quern.operators.wide import cells_of, widen
from tests.conftest import rows


def plain_periods(spans):
    out, by = set(), {}
    for k, a, z in spans:
        if a is not None and z is not None and a <= z:
            by.setdefault(k, []).append((a, z))
    for k, v in by.items():
        merged = []
        for a, z in sorted(v):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        out |= {(k, "period", a, z) for a, z in merged}
        out |= {(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed, reach, longest", [(1, 300, 40), (2, 20000, 9000), (3, 200000, 300), (4, 64, 3)])
def test_periods_against_brute_force(spark, seed, reach, longest):
    rnd = random.Random(seed)
    spans = []
    for _ in range(400):
        a = rnd.randint(-reach, reach)
        spans.append((rnd.choice(["x", "y", "x", None]), a, a + rnd.randint(-2, longest)))
    spans += [("x", None, 5), ("y", 5, None), *spans[:20]]
    df = spark.createDataFrame(spans, "e string, start_day long, end_day long").withColumn("k", F.lit("clash")).withColumn("m", F.lit(1))
    assert set(rows(continuous_periods(df, "e"))) == plain_periods(spans)


def test_fact_periods(spark):
    schema = "entity_canonical string, granularity string, start_date string, end_date string, kind string"
    facts = spark.createDataFrame([
        ("a", "year", "2020", "2020", "x"), ("a", "Quarter", "2021-01-01", "2021-03-31", "x"), ("a", "MONTH", "2021-05", "2021-05", "x"), ("a", "YEAR", "2022-02-30", "2022-03-01", "x"),
        ("a", "YEAR", "2023", None, "x"), ("a", "YEAR", "", "2023", "x"), ("a", "EXACT_DATE", "1990-01-01", "1990-01-01", "x"), ("b", "YEAR", "2021", "2020", "x"), ("b", None, "2021", "2021", "x"),
    ], schema)
    assert rows(fact_periods(facts)) == [("a", "gap", "2021-04-01", "2021-04-30"), ("a", "period", "2020-01-01", "2021-03-31"), ("a", "period", "2021-05-01", "2021-05-31")]
    assert fact_periods(facts.limit(0)).count() == 0
    day = lambda t, last: facts.limit(1).select(day_bound(F.lit(t), last)).first()[0]
    assert day("2024-02", True) - day("2024-02", False) == 28 and day("x", True) is None


STATEMENTS = [
    ("2024-03-31", "Europe/Berlin", "DMY", "2024-03-30T23:00:00Z", "2024-03-31T21:59:59Z"),
    ("2018-11-04", "America/New_York", "MDY", "2018-11-04T04:00:00Z", "2018-11-05T04:59:59Z"),
    ("03/04/2020", "UTC", "DMY", "2020-04-03T00:00:00Z", "2020-04-03T23:59:59Z"), ("03/04/2020", "UTC", "MDY", "2020-03-04T00:00:00Z", "2020-03-04T23:59:59Z"),
    ("21-MAR-11", "Asia/Tokyo", "DMY", "2011-03-20T15:00:00Z", "2011-03-21T14:59:59Z"), ("1240841543895", "Asia/Tokyo", "DMY", "2009-04-27T14:12:23Z", "2009-04-27T14:12:23Z"),
    ("1234065972", "Asia/Tokyo", "DMY", "2009-02-08T04:06:12Z", "2009-02-08T04:06:12Z"), ("17:34+0200, 7 July 2010", "UTC", "DMY", "2010-07-07T15:34:00Z", "2010-07-07T15:34:59Z"),
    ("8 PM on 2 May 2018", "Asia/Kolkata", "DMY", "2018-05-02T14:30:00Z", "2018-05-02T15:29:59Z"), ("12.08 am (UTC), 02/28/2022", "Asia/Kolkata", "MDY", "2022-02-28T00:08:00Z", "2022-02-28T00:08:59Z"),
    ("0508 hrs on 03/02/2011", "UTC", "DMY", "2011-02-03T05:08:00Z", "2011-02-03T05:08:59Z"), ("2009-W53-7", "UTC", "DMY", "2010-01-03T00:00:00Z", "2010-01-03T23:59:59Z"),
    ("20090301T041219Z", "Asia/Tokyo", "DMY", "2009-03-01T04:12:19Z", "2009-03-01T04:12:19Z"), ("2009-12-16T15:14:46.407976Z", "UTC", "DMY", "2009-12-16T15:14:46Z", "2009-12-16T15:14:46Z"),
    ("१२ सितंबर २०२२", "Asia/Kolkata", "DMY", "2022-09-11T18:30:00Z", "2022-09-12T18:29:59Z"), ("3 मई 2016", "UTC", "DMY", "2016-05-03T00:00:00Z", "2016-05-03T23:59:59Z"),
    ("1er mars 2009 05h15 EST", "UTC", "DMY", "2009-03-01T10:15:00Z", "2009-03-01T10:15:59Z"), ("23 de abril de 2011 01h56", "UTC", "DMY", "2011-04-23T01:56:00Z", "2011-04-23T01:56:59Z"),
    ("Sun, 01 Nov 2015 01:33:13 -04:00", "America/New_York", "MDY", "2015-11-01T05:33:13Z", "2015-11-01T05:33:13Z"),
    ("2013-11-03 03:28 America/New_York", "UTC", "MDY", "2013-11-03T08:28:00Z", "2013-11-03T08:28:59Z"), ("as of Sep. 7th 2012, 4:00:15 PM", "UTC", "DMY", "2012-09-07T16:00:15Z", "2012-09-07T16:00:15Z"),
    ("between 25/12/2017 and 2018-01-02 3am JST", "UTC", "DMY", "2017-12-25T00:00:00Z", "2018-01-01T18:59:59Z"), ("2012-06-05 — 2012-06-08", "UTC", "DMY", "2012-06-05T00:00:00Z", "2012-06-08T23:59:59Z"),
    ("from 20. Mai 2020 to 1 June 2020 9 PM GMT+5:45", "UTC", "DMY", "2020-05-20T00:00:00Z", "2020-06-01T16:14:59Z"),
    # policy: a time that occurs twice is its first occurrence, a skipped one moves forward
    ("2019-10-27 02:30", "Europe/Berlin", "DMY", "2019-10-27T00:30:00Z", "2019-10-27T00:30:59Z"), ("2019-03-31 02:30", "Europe/Berlin", "DMY", "2019-03-31T01:30:00Z", "2019-03-31T01:30:59Z"),
]


def test_instants(spark):
    docs = [(f"d{i}", zone, order, "clash") for i, (_, zone, order, _, _) in enumerate(STATEMENTS)]
    docs = spark.createDataFrame(docs, "doc_hash string, time_zone string, date_order string, fact_id string")
    schema = "fact_id string, doc_hash string, temporal_raw string, start_date string, end_date string, granularity string"
    facts = []
    for i, (text, *_) in enumerate(STATEMENTS):
        facts += [(f"t{i}", f"d{i}", text, None, None, "exact_date"), (f"b{i}", f"d{i}", "recently", text, text, None), (f"t{i}", f"d{i}", text, None, None, "UNKNOWN")]
    got = fact_instants(spark.createDataFrame(facts, schema), docs)
    assert rows(got) == sorted([(f"{k}{i}", first, last) for i, (*_, first, last) in enumerate(STATEMENTS) for k in "tb"], key=repr)


def test_instants_without_a_day(spark):
    docs = spark.createDataFrame([("d", "UTC", "DMY")], "doc_hash string, time_zone string, date_order string")
    schema = "fact_id string, doc_hash string, temporal_raw string, start_date string, end_date string, granularity string"
    texts = [None, "", "FY22", "2020", "April 2019", "31/02/2020", "2016-00-11", "25:10 on 2020-01-01", "H1 2013", "x" * 100_000, "2020-01-01 10:00 Nowhere/Land"]
    facts = spark.createDataFrame([(str(i), "d", t, t, None, "UNKNOWN") for i, t in enumerate(texts)] + [("m", "d", "2020-01-01", None, None, "YEAR")], schema)
    assert rows(fact_instants(facts, docs)) == []
    one = spark.createDataFrame([("a", "zz", None, "2020-01-01", None, None), ("b", "d", None, "2020", "2020-01-02", None)], schema)
    assert rows(fact_instants(one, docs)) == [("a", "2020-01-01T00:00:00Z", "2020-01-01T23:59:59Z"), ("b", "2020-01-02T00:00:00Z", "2020-01-02T23:59:59Z")]
    assert fact_instants(facts.limit(0), docs).isEmpty()


@pytest.mark.parametrize("text, number", [
    ("1,355", 1355), ("5,9", 5.9), ("0,123", 0.123), ("23,42,177.0", 2342177.0), ("2.994.237,7", 2994237.7), ("1'182.8", 1182.8), ("29 191 599", 29191599), ("(425.2)", -425.2),
    ("- 156", -156), ("−0.4", -0.4), ("४,२६,८०५.१", 426805.1), ("about 130,70", 130.7), ("10 403 984", 10403984), ("2 437 hours", 2437), ("NM", None), ("", None), ("[●]", None),
])
def test_parse_number(text, number):
    got = parse_number(text)
    assert (got and got[0] / 10 ** got[1]) == number


@pytest.mark.parametrize("raw, unit, quote, dimension, common, expected", [
    ("5,9", "RAW", "Unit: Rs. crores. During 2020", "money", "OWN_CURRENCY", ("INR", 59_000_000_000)), ("₹29,355.2 '000", "INR", "", "money", "OWN_CURRENCY", ("INR", 29_355_200_000)),
    ("Rs.666.46", "INR_MILLION", "", "money", "OWN_CURRENCY", ("INR", 666_460_000_000)), ("53 Mn", "EUR", "", "money", "OWN_CURRENCY", ("EUR", 53_000_000_000)), ("5", "COUNT", "", "money", "OWN_CURRENCY", None),
    ("1,391.4 lakh sq. ft.", "COUNT", "", "area", "SQ_M", ("SQ_M", 12_926_528_986)), ("3", "MN_SQ_FT", "", "area", "SQ_M", ("SQ_M", 278_709_120)), ("38.04 km²", "INR", "", "area", "SQ_M", ("SQ_M", 38_040_000_000)),
    ("(21.8) deg C", "COUNT", "", "temperature", "CELSIUS", ("CELSIUS", -21_800)), ("14K", "COUNT", "", "temperature", "CELSIUS", ("CELSIUS", -259_150)), ("4 k", "COUNT", "", "count", "COUNT", ("COUNT", 4_000_000)),
    ("869,6 gallons (US)", "COUNT", "", "volume", "LITRE", ("LITRE", 3_291_794)), ("3 MU", "COUNT", "", "energy", "KWH", ("KWH", 3_000_000_000)), ("3 ‰", "PERCENT", "", "share", "PERCENT", ("PERCENT", 300)),
    ("0.9", "RAW", "(All figures in lakh units) During", "energy", "KWH", ("KWH", 90_000_000)), ("7", None, None, "mass", "TONNE", ("TONNE", 7000)), (None, "KG", "", "mass", "TONNE", None), ("12 pounds", "INR", "", "mass", "TONNE", ("TONNE", 5)),
    ("12 pounds", "RAW", "", "money", "OWN_CURRENCY", ("GBP", 12000)), ("6 parcels per day", "COUNT", "", "count", "COUNT", ("COUNT", 6000)),
])
def test_to_common(raw, unit, quote, dimension, common, expected):
    assert to_common(raw, unit, quote, dimension, common) == expected


@pytest.mark.parametrize("raw, value", [
    ("٣٥ km", 35_000), ("१२.५ km", 12_500), ("12½ km", 12_500), ("½ km", 500), ("1 1/2 km", 1_500), ("(2½) km", -2_500), ("1.2e6 km", 1_200_000_000), ("1.2 x 10^3 km", 1_200_000),
    ("1.2×10⁻² km", 12), ("two crore km", 20_000_000_000), ("minus twenty-five km", -25_000), ("several km", None), ("n.a.", None), ("", None),
])
def test_stated_numbers(raw, value):
    assert to_common(raw, "COUNT", "", "distance", "KM") == (value if value is None else ("KM", value))


@pytest.mark.parametrize("quote, value", [
    ("(Values are expressed in thousand km) Route 7", 7_000_000), ("Amounts shown in miles; Route 7", 11_265), ("[in lakh km] Route 7", 700_000_000), ("(km, except where noted) Route 7", 7_000),
    ("Units = m. Route 7", 7), ("[in 2019] (All figures in m) Route 7", 7), ("Route 7 in the period", 7_000), (None, 7_000), ("x" * 200_000, 7_000),
])
def test_declared_units(quote, value):
    assert to_common("7", "RAW", quote, "distance", "KM") == ("KM", value)


def test_many_unit_words_in_linear_time():
    start = time.perf_counter()
    assert parse_unit("km m ft square mi k lakh rs " * 2500, "distance")[2] is not None
    assert time.perf_counter() - start < 10


def test_unit_exponents():
    assert parse_unit("m^2", "area")[2] == (1, 0) and parse_unit("cubic ft", "volume")[2][0] > 0
    assert parse_unit("kg", "distance") == (None, None, None)


def test_convert_quantities(spark):
    facts = spark.createDataFrame([
        ("a", "x", "5 km", "COUNT", "q", 1), ("a", "x", "5 km", "COUNT", "q", 1), ("b", "x", None, None, None, 1), ("c", "none", "5 km", "KM", "q", 1), ("d", None, "5", "KM", None, 1), ("e", "x", "9" * 60, "KM", None, 1), ("f", "x", "y" * 200_000 + " 1", None, None, 1),
    ], "fact_id string, attribute_canonical string, raw_value string, canonical_unit string, verbatim_quote string, dimension int")
    catalog = spark.createDataFrame([("x", "distance", "KM", "double"), ("none", None, None, "string")], "attribute_canonical string, dimension string, common_unit string, value_type string")
    assert rows(convert_quantities(facts, catalog)) == [("a", "KM", 5000), ("f", "KM", 1000)]
    assert convert_quantities(facts.limit(0), catalog).isEmpty() and convert_quantities(facts, catalog.limit(0)).isEmpty()


def test_widen(spark):
    facts = spark.createDataFrame([
        ("e", "n", 2.0, 1), ("e", "n", 2.5, 3), ("e", "n", None, 9), ("e", "flag", 1.0, 1), ("e", "d", 7.25, 1), ("e", "s", 1.5, 1), ("e", "zz", 1.0, 1), ("f", "flag", 3.0, 1), ("f", "n", 4.0, 1), (None, "n", 1.0, 1), ("g", "n", None, 1),
    ], "entity_canonical string, attribute_canonical string, canonical_value_num double, ingest_seq long")
    catalog = [("n", "bigint"), ("flag", "boolean"), ("d", "double"), ("s", "string"), ("cells", "double")]
    wide = widen(facts.withColumn("cells", F.lit(1)), catalog)
    got = {r["entity_canonical"]: r for r in wide.collect()}
    assert set(got) == {"e", "f"}
    e, f = got["e"], got["f"]
    assert (e["n"], e["flag"], e["d"], e["s"], e["cells_"], e["cast_failures"]) == (None, True, 7.25, "1.5", None, {"n": 2.5})
    assert (f["n"], f["flag"], f["cast_failures"]) == (4, None, {"flag": 3.0})
    assert len(rows(cells_of(wide))) == 6
    assert widen(facts.limit(0), catalog).isEmpty() and widen(facts, []).isEmpty()


def test_instants_of_random_days(spark):
    rnd = random.Random(3)
    docs = spark.createDataFrame([("d", "UTC", "DMY")], "doc_hash string, time_zone string, date_order string")
    days = [dt.date(2000, 1, 1) + dt.timedelta(rnd.randrange(9000)) for _ in range(60)]
    forms = ["%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%Y%m%d", "%d %B %Y", "%B %d, %Y", "%d-%b-%y", "%G-W%V-%u", "%A, %d %B %Y", "%Y/%m/%d"]
    table = [(str(i), "d", d.strftime(f), None, None, None) for i, d in enumerate(days) for f in [rnd.choice(forms)]]
    facts = spark.createDataFrame(table, "fact_id string, doc_hash string, temporal_raw string, start_date string, end_date string, granularity string")
    got = {r["fact_id"]: r["start_utc"][:10] for r in fact_instants(facts, docs).collect()}
    assert got == {str(i): d.isoformat() for i, d in enumerate(days)}
