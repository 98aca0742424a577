import pytest
from pyspark.sql import functions as F

from quern.functions import periods, similarity, text, values


def one(spark, column, **inputs):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], kinds).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw, n", [(None, 1), ("", 1), ("  \n ", 1), ("a b c", 3), ("a b", 2), ("x " * 1576, 2048), ("x " * 1577, 2050)])
def test_estimate_tokens(spark, raw, n):
    assert one(spark, text.estimate_tokens(F.col("t")), t=raw) == n


def test_clean_page_text(spark):
    assert one(spark, text.clean_page_text(F.col("t")), t=" a \r\nb\rc d  \n\n\n\n\n\ne\n") == "a\nb\nc d\n\n\ne"


@pytest.mark.parametrize("name, key", [
    ("Freight Grid Ltd.", "freight_grid"), ("grid FREIGHT pvt ltd", "freight_grid"), ("Limited", "entity"), (None, "unknown_entity"), ("", "unknown_entity"),
    ("Élan b-c ₹5", "5_b_c_élan"), ("a a a", "a"),
])
def test_entity_key(spark, name, key):
    assert one(spark, text.entity_key(F.col("t")), t=name) == key


@pytest.mark.parametrize("raw, unit, value, kind", [
    ("₹7,241 Crores", None, 7.241e10, "INR"), ("72.41 Billion INR", None, 7.241e10, "INR"), ("120.5 Lakhs", None, 12050000.0, "COUNT"),
    ("93,000 personnel", None, 93000.0, "INR"), ("2.8Bn", None, 2.8, "COUNT"), ("Rs.7,241", None, 0.7241, "INR"), ("(500)", None, 500.0, "COUNT"),
    ("86-90", None, 86.0, "COUNT"), ("5", "ratio", 5.0, "PERCENT"), ("", "INR", None, "RAW"), (None, None, None, "RAW"), ("n.a.", "USD", None, "USD"),
])
def test_value_and_unit(spark, raw, unit, value, kind):
    got = one(spark, values.value_and_unit(F.col("r"), F.col("u")), r=raw, u=unit)
    assert got["unit"] == kind and (got["value"] == pytest.approx(value) if value is not None else got["value"] is None)


@pytest.mark.parametrize("raw, value", [("₹ 40,000 million", 4e10), ("18,793", 18793.0), ("12.5%", 12.5), ("2.8Bn", None), (">5 crore", 5e7), ("abc", None), ("", None), ("3 L", 3e5)])
def test_extracted_number(spark, raw, value):
    assert one(spark, values.extracted_number(F.col("r")), r=raw) == value


@pytest.mark.parametrize("expr, start, end, grain", [
    ("FY22", "2021-04-01", "2022-03-31", "YEAR"), ("FY 2023-24", "2023-04-01", "2024-03-31", "YEAR"), ("Fiscal 2024", "2023-04-01", "2024-03-31", "YEAR"),
    ("2022", "2022-01-01", "2022-12-31", "YEAR"), ("CY22", "2022-01-01", "2022-12-31", "YEAR"), ("Q3 FY24", "2023-10-01", "2023-12-31", "QUARTER"),
    ("Q4 FY24", "2024-01-01", "2024-03-31", "QUARTER"), ("2022-03-31", "2022-04-01", "2003-03-31", "YEAR"), ("FY1999-00", "1999-04-01", "1900-03-31", "YEAR"),
    ("June 22, 2011", "2011-06-22", "2011-06-22", "EXACT_DATE"), ("22nd June 2011", "2011-06-22", "2011-06-22", "EXACT_DATE"), ("unknown", None, None, "PERPETUAL"),
    (None, None, None, "PERPETUAL"), ("soon", None, None, "UNKNOWN"),
])
def test_stated_period(spark, expr, start, end, grain):
    got = one(spark, periods.stated_period(F.col("t")), t=expr)
    assert (got["start_date"], got["end_date"], got["granularity"]) == (start, end, grain)


@pytest.mark.parametrize("quote, page, raw, grain", [
    ("5 since inception", "", "since inception", "PERPETUAL"), ("5", "x dated May 14, 2022", "dated May 14, 2022", "EXACT_DATE"), ("up in FY24 Q4", "", "FY24", "YEAR"),
    ("Q3 2023 was", "", "Q3 2023", "QUARTER"), ("in 2023", "", "2023", "YEAR"), ("5", "Fiscal 2021", "Fiscal 2021 (page context)", "YEAR"), ("5", "x", None, None),
])
def test_temporal_hint(spark, quote, page, raw, grain):
    got = one(spark, periods.temporal_hint(F.col("q"), F.col("p")), q=quote, p=page)
    assert (got and got["raw"], got and got["granularity"]) == (raw, grain)


@pytest.mark.parametrize("a, b, relation", [
    (("2021", "2022"), ("2021", "2022"), "EQUAL"), (("2021", "2022"), ("2023", "2024"), "DISJOINT"), (("2021", "2021"), ("2020", "2022"), "SUBSET"),
    (("2020", "2022"), ("2021", "2021"), "SUPERSET"), (("2020", "2022"), ("2022", "2024"), "OVERLAPPING"), (("2020", None), ("2022", "2024"), "PERPETUAL"), (("", "2020"), ("2022", "2024"), "PERPETUAL"),
])
def test_interval_relation(spark, a, b, relation):
    c = F.col
    got = one(spark, periods.interval_relation(c("s1"), c("e1"), F.lit("YEAR"), c("s2"), c("e2"), F.lit("YEAR")), s1=a[0], e1=a[1], s2=b[0], e2=b[1])
    assert got == relation
    mirror = {"SUBSET": "SUPERSET", "SUPERSET": "SUBSET"}.get(relation, relation)
    assert one(spark, periods.interval_relation(c("s2"), c("e2"), F.lit("YEAR"), c("s1"), c("e1"), F.lit("YEAR")), s1=a[0], e1=a[1], s2=b[0], e2=b[1]) == mirror


@pytest.mark.parametrize("a, b, s", [("Grid Freight Limited", "Grid Freight Ltd", 1.0), ("Government of India", "Indian Government", 0.6), ("", "x", 0.0), ("x", None, 0.0), ("Same", "same ", 1.0)])
def test_similarity(spark, a, b, s):
    assert one(spark, similarity.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(s, abs=1e-6)


def test_near_quote_equals_plain_search():
    import random
    from difflib import SequenceMatcher

    def plain(q, p):
        n, w = len(q.split()), p.split()
        if not n or not w:
            return False
        return any(SequenceMatcher(None, q, " ".join(w[i : i + n])).ratio() >= 0.85 for i in range(max(1, len(w) - n + 1)))

    rnd = random.Random(1)
    words = ["revenue", "rose", "to", "fell", "5", "crore", "in", "the", "year", "yeer", "revenve"]
    for _ in range(300):
        page = " ".join(rnd.choices(words, k=rnd.randint(0, 25)))
        quote = " ".join(rnd.choices(words, k=rnd.randint(0, 6)))
        if rnd.random() < 0.6 and page:
            w = page.split()
            i = rnd.randrange(len(w))
            quote = " ".join(w[i : i + 5]).replace("e", "", rnd.randint(0, 2))
        assert similarity.near_quote(quote, page) == plain(quote, page)


def test_pack_paragraphs(spark):
    t = "\n\n".join("w " * n for n in (5, 5, 50, 3))
    got = one(spark, text.pack_paragraphs(F.col("t"), 15), t=t)
    assert [len(p.split()) for p in got] == [10, 50, 3]
    assert "\n\n".join(got) == t
    assert one(spark, text.pack_paragraphs(F.col("t"), 1500), t=t) == [t]
