import shutil

import pytest
from pyspark.sql import functions as F

from quern.functions.values import typed_values_match
from quern.operators import extract, gate, reconcile, report
from quern.sources import pages
from quern.sources.schemas import FACTS, PAGE_CHUNKS, conform, dimensions_json, nested, violations
from quern.sources.store import FactStore
from quern.streaming.ingest import event_windows, first_deliveries, ingest_stream, sessions, stream_facts
from tests.conftest import rows

BASE = dict(
    entity_raw="Grid Freight Limited", attribute_raw="Revenue", raw_value="5", canonical_value_num=None, canonical_value_str=None, start_date=None, end_date=None,
    granularity=None, temporal_raw="FY22", scope="CONSOLIDATED", canonical_unit="INR", doc_hash="h1", source_doc_name="a.pdf", page_number=1,
    verbatim_quote="q", provenance_modality=None, confidence_score=1.0, is_quarantined=False, quarantine_reason=None, ingest_seq=1, fact_id=None,
)


def facts(spark, *changes):
    out = []
    for n, c in enumerate(changes, 1):
        row = BASE | {"ingest_seq": n, "fact_id": f"f{n}"} | c
        out.append(tuple(row.get(f.name) for f in FACTS.fields))
    return spark.createDataFrame(out, FACTS)


KEYED = dict(entity_canonical="grid", attribute_canonical="revenue", granularity="YEAR", start_date="2021-04-01", end_date="2022-03-31")


@pytest.mark.parametrize("a, b, case, dim", [
    (dict(canonical_value_num=100.0), dict(canonical_value_num=100.4), "CASE_1_CORROBORATION", None),
    (dict(canonical_value_num=66000.0), dict(canonical_value_num=93000.0), "CASE_2_GENUINE_CONTRADICTION", "Value Conflict"),
    (dict(canonical_value_num=5.0), dict(canonical_value_num=5.0, start_date="2023-04-01", end_date="2024-03-31", temporal_raw="FY24"), "CASE_3_CONTEXT_RECONCILED", "Temporal Progression/Evolution (FY22 vs FY24)"),
    (dict(canonical_value_num=5.0), dict(canonical_value_num=5.0, scope="India"), "CASE_3_CONTEXT_RECONCILED", "Organizational Scope (CONSOLIDATED vs India)"),
    (dict(canonical_value_num=5.0), dict(canonical_value_num=5.0, canonical_unit="USD"), "CASE_3_CONTEXT_RECONCILED", "Unit/Measurement Scale (INR vs USD)"),
    (dict(canonical_value_num=5.0), dict(canonical_value_num=5.0, start_date="2021-04-01", end_date="2021-06-30"), "CASE_3_CONTEXT_RECONCILED", reconcile.AGGREGATION),
    (dict(canonical_value_str="Yes "), dict(canonical_value_str="yes"), "CASE_1_CORROBORATION", None),
    (dict(), dict(), "CASE_2_GENUINE_CONTRADICTION", "Value Conflict"),
    (dict(canonical_value_num=0.0, end_date=None), dict(canonical_value_num=0.0, start_date="1999"), "CASE_1_CORROBORATION", None),
])
def test_cases(spark, a, b, case, dim):
    both = facts(spark, KEYED | a, KEYED | b | {"doc_hash": "h2"})
    got = reconcile.classify(reconcile.candidates(both)).collect()
    assert [(r["case_type"], list(r["differing_dimensions"])) for r in got] == [(case, [dim] if dim else [])]
    assert got[0]["rationale"]


def test_no_pair_within_document_or_quarantine(spark):
    assert reconcile.candidates(facts(spark, KEYED, KEYED)).isEmpty()
    assert reconcile.candidates(facts(spark, KEYED, KEYED | {"doc_hash": "h2", "is_quarantined": True})).isEmpty()
    assert reconcile.candidates(facts(spark)).isEmpty()


def test_fuzzy_candidates(spark):
    a = KEYED | {"entity_canonical": "freight_grid", "entity_raw": "Meridian Freight Grid"}
    b = KEYED | {"entity_canonical": "freigt_grid", "entity_raw": "Meridian Freight Gridd", "doc_hash": "h2"}
    c = KEYED | {"entity_canonical": "other", "entity_raw": "Something Else", "doc_hash": "h3"}
    got = reconcile.fuzzy_candidates(facts(spark, a, b, c)).select("a_fact_id", "b_fact_id")
    assert rows(got) == [("f1", "f2")]


@pytest.mark.parametrize("change, page, reason", [
    (dict(raw_value="86", canonical_value_num=86.0, temporal_raw="", granularity="UNKNOWN", verbatim_quote="operating 86 active gateways"), "Operating 86 active gateways.", gate.NO_HORIZON),
    (dict(raw_value="8000 Cr", granularity="YEAR", verbatim_quote="this string does not exist on page"), "Revenue reached eight thousand crores.", gate.UNVERIFIED),
    (dict(raw_value="June 22, 2011", granularity="PERPETUAL", temporal_raw="PERPETUAL", verbatim_quote="Incorporated on June 22, 2011."), "Incorporated on June 22, 2011.", None),
    (dict(raw_value="5", granularity="YEAR", verbatim_quote="Revenue roze to five crore"), "The Revenue rose to five crore in May", None),
    (dict(raw_value="5", temporal_raw=None, verbatim_quote="[Visual Chart]: x"), "nothing", gate.NO_AXIS),
    (dict(raw_value="x", granularity="YEAR", verbatim_quote=" "), "page", gate.UNVERIFIED),
    (dict(raw_value="x", granularity="YEAR", verbatim_quote="!!"), "page", None),
    (dict(raw_value="x", attribute_raw="Name", granularity=None, temporal_raw=None, verbatim_quote="page", quarantine_reason="OLD"), "page", "OLD"),
])
def test_gate(spark, change, page, reason):
    got = gate.gate(facts(spark, change), spark.createDataFrame([("h1", 1, page)], "doc_hash string, page_number int, page_text string")).first()
    assert (got["quarantine_reason"], got["is_quarantined"]) == (reason, reason is not None)


def test_extract(spark):
    text = (
        "Grid Freight Limited. Gross margin: 24% in FY24. Total income was ₹ 12.5 crore in FY24.\n120 Active customers\n"
        "Figure: Yearly volume reached 500 million. Gross margin: 24% in FY24."
    )
    chunk = spark.createDataFrame([(1, "01-doc.pdf", "h", 2, text), (2, "d.pdf", "h", 3, ""), (3, "d.pdf", "h", 4, None)], "chunk_id long, doc_name string, doc_hash string, page_number int, clean_text string")
    # of the two amounts, the one in rupees
    got = {r["rule"]: r for r in extract.extract_facts(chunk).collect() if (r["rule"], r["raw_value"]) != (2, "500 million")}
    assert set(got) == {1, 2, 3, 4}
    # the scales are tried in order whatever their letter case, so "crore" is read as far as "cr"
    assert got[2]["raw_value"] == "₹ 12.5 cr" and got[2]["canonical_value_num"] == 12.5e7 and got[2]["canonical_unit"] == "INR"
    assert got[3]["raw_value"] == "24%" and got[1]["attribute"] == "Active Customers" and got[4]["provenance_modality"] == "VISUAL_CHART"
    assert {r["entity"] for r in got.values()} == {"Grid Freight Limited"}


def test_store_is_incremental(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    one = facts(spark, dict(raw_value="June 22, 2011", attribute_raw="Incorporation", temporal_raw="PERPETUAL"), dict(raw_value="Rs. 7,241 Crores"))
    two = facts(spark, dict(raw_value="22 June 2011", attribute_raw="Incorporation", temporal_raw="PERPETUAL", doc_hash="h2", fact_id="g1", ingest_seq=3),
                dict(raw_value="Rs. 8,142 Crores", temporal_raw="FY24", doc_hash="h2", fact_id="g2", ingest_seq=4, entity_raw="Grid Freight Ltd"))
    assert store.ingest(one).count() == 0
    assert sorted(r["case_type"] for r in store.ingest(two).collect()) == ["CASE_1_CORROBORATION", "CASE_3_CONTEXT_RECONCILED"]
    assert store.ingest(one).count() == 0 and store.facts().count() == 4 and store.relationships().count() == 2
    assert store.has_document("h2") and not store.has_document("h9") and store.quarantined().count() == 0
    # the same pairs as from one bulk comparison
    bulk = reconcile.relationships(reconcile.fuzzy_candidates(store.facts())).select("fact_id_a", "fact_id_b", "case_type")
    assert rows(bulk) == rows(store.relationships().select("fact_id_a", "fact_id_b", "case_type"))
    store.reset()
    assert store.facts().isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    facts(spark, dict(raw_value="5 crore")).write.mode("append").parquet(source)
    facts(spark, dict(raw_value="5 crore", doc_hash="h2", fact_id="g1", ingest_seq=2)).write.mode("append").parquet(source)
    store = FactStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(stream_facts(spark, source, 1), store, str(tmp_path / "cp")).awaitTermination()
    assert store.facts().count() == 2 and [r["case_type"] for r in store.relationships().collect()] == ["CASE_1_CORROBORATION"]


def test_event_stream_equals_table(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    total = lambda df: df.agg(F.sum("n"), F.count("*")).first()
    assert tuple(total(spark.table("w"))) == tuple(total(event_windows(events)))
    assert sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_first_deliveries(spark, data):
    f = spark.read.parquet(f"{data}/facts.parquet")
    assert first_deliveries(f).count() == f.select("fact_id").distinct().count()


def test_pages_and_schemas(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("one\ftwo words\f", encoding="utf-8")
    got = pages.chunk_pages(pages.text_pages(pages.read_files(spark, str(tmp_path / "docs"), "*.txt")))
    assert [(r["page_number"], r["clean_text"], r["token_estimate"]) for r in got.orderBy("page_number").collect()] == [(1, "one", 1), (2, "two words", 2)]
    seen = pages.html_pages(spark.createDataFrame([(1, "<p>a</p><IMG src=x>"), (2, "<table></table>"), (3, None)], "k int, h string"), "k", "h")
    assert rows(seen.select("k", "has_tables", "has_images"))[:2] == [(1, False, True), (2, True, False)]
    empty = pages.chunk_pages(spark.createDataFrame([("d", "h", 1, "", False, True), ("d", "h", 2, None, False, False)], "doc_name string, doc_hash string, page_number int, raw_text string, has_tables boolean, has_images boolean"))
    assert [(r["clean_text"], r["token_estimate"], r["provenance_modality"]) for r in empty.collect()] == [("[Visual Page]", 50, "VISUAL_CHART")]
    f = facts(spark, {}, dict(page_number=0, confidence_score=2.0, doc_hash=None))
    assert [list(r[0]) for r in f.orderBy("ingest_seq").select(violations()).collect()] == [[], ["page_number", "confidence_score", "doc_hash"]]
    assert nested(f).first()["context"]["temporal"]["granularity"] == "UNKNOWN"
    assert conform(f.select("fact_id"), PAGE_CHUNKS).columns == PAGE_CHUNKS.names


def test_pdf_source_says_what_it_needs(spark):
    try:
        import pymupdf  # noqa: F401
    except ImportError:
        files = spark.createDataFrame([("a.pdf", "h", bytearray(b"%PDF"))], "doc_name string, doc_hash string, content binary")
        with pytest.raises(Exception, match="pymupdf"):
            pages.pdf_pages(files).collect()


def test_reports(spark):
    f = facts(spark, dict(attribute_canonical="revenue_2nd o'neil"), dict(is_quarantined=True, quarantine_reason="X", source_doc_name="a-excerpt.pdf"))
    assert report.fact_directory(f).first()["heading"] == "Revenue 2Nd O'Neil"
    assert report.quarantine_report(f).first()["document"] == "a"
    assert tuple(report.store_stats(f).first())[:4] == (1, 1, 1, 1)
    assert report.chosen(f, "doc_hash", []).count() == 2 and report.chosen(f, "doc_hash", ["zz"]).count() == 0
    labelled = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    scores = {r["label"]: r for r in report.classification_scores(labelled, "t", "p").collect()}
    assert scores["a"]["precision"] == 0.5 and scores["a"]["recall"] == 0.5 and scores["c"]["f1"] == 0.0
    assert report.macro_scores(report.classification_scores(labelled, "t", "t")).first()["f1"] == 1.0
    card = spark.range(1).select(report.scorecard(F.array(F.lit(12.0), F.lit(8.0), F.lit(-1.0))).alias("s"), report.relative_scale_error(F.lit(7.241e10), F.lit(7.241e10)).alias("e"), report.bounds_differ(F.lit("1"), F.lit(None), F.lit("1"), F.lit("2")).alias("d")).first()
    assert card["s"]["score"] == 6.0 and not card["s"]["passed"] and card["e"] == 0.0 and card["d"]


def test_store_survives_a_failure_between_its_writes(spark, tmp_path):
    folder = tmp_path / "store"
    one = facts(spark, dict(raw_value="5 crore"))
    two = facts(spark, dict(raw_value="5 crore", doc_hash="h2", fact_id="g1", ingest_seq=2), dict(raw_value="6 crore", doc_hash="h3", fact_id="g2", ingest_seq=3))
    for batch_id in (None, "s7"):
        store = FactStore(spark, str(folder / str(batch_id)))
        store.ingest(one)
        parts = lambda: {p for p in (folder / str(batch_id) / "facts").iterdir() if p.is_dir()}
        before = parts()
        whole = rows(store.ingest(two, batch_id=batch_id))
        assert len(whole) == 3 and rows(store.relationships()) == whole
        # as if the job had died after the relationships and before the facts
        for part in parts() - before:
            shutil.rmtree(part)
        store = FactStore(spark, str(folder / str(batch_id)))
        assert store.has_document("h2") is False and store.relationships().isEmpty()
        assert rows(store.ingest(two, batch_id=batch_id)) == whole
        assert rows(store.relationships()) == whole and store.deliveries().count() == 3
        # a replay after success
        store.ingest(two, batch_id=batch_id)
        assert rows(store.relationships()) == whole and store.deliveries().count() == 3


def test_model_facts(spark):
    chunks = spark.createDataFrame(
        [(1, "a.pdf", "h", 1, "Revenue 5", False), (2, "a.pdf", "h", 2, "Gross margin: 24% in FY24.", False), (3, "a.pdf", "h", 3, "", False), (4, "a.pdf", "h", 4, "", True)],
        "chunk_id long, doc_name string, doc_hash string, page_number int, clean_text string, has_images boolean",
    )

    def model(chunk):
        if chunk["chunk_id"] == 2:
            raise RuntimeError("no answer")
        return [{"entity": "E", "attribute": "A", "raw_value": "5", "verbatim_quote": chunk["clean_text"], "doc_hash": "made up", "page_number": 99}]

    got = {r["chunk_id"]: r for r in extract.model_facts(chunks, model).collect()}
    assert set(got) == {1, 2, 4} and {(r["doc_hash"], r["page_number"]) for r in got.values()} == {("h", 1), ("h", 2), ("h", 4)}
    assert (got[1]["provenance_modality"], got[4]["provenance_modality"], got[2]["raw_value"], got[2]["temporal_raw"]) == ("TEXT", "VISUAL_CHART", "24%", "FY24 (page context)")


def test_buffers_and_pages(spark):
    files = pages.read_buffers(spark, [("a.txt", b"one\ftwo"), (None, memoryview(b"three"))])
    chunks = pages.chunk_pages(pages.text_pages(files))
    got = pages.page_records(chunks)
    assert len(got.columns) == 7 and {r["source_doc_name"] for r in got.collect()} == {"a.txt", "document.pdf"}
    assert rows(pages.first_pages(chunks, 1).select("clean_text")) == [("one",), ("three",)]


def test_dimensions_as_json(spark):
    import json

    texts = [["a", "b"], [], ['q"\\', "₹ 5\n\t", "🚚\x7f\x01"], None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d array<string>")
    got = [r[0] for r in df.orderBy("i").select(dimensions_json(F.col("d"))).collect()]
    assert got[3] is None and [json.loads(g) for g in got[:3]] == texts[:3]
    assert got[0] == json.dumps(texts[0]) and got[2] == json.dumps(texts[2])


def test_cards_and_totals(spark):
    assert spark.range(1).select(report.card_title(F.lit("d-mart o'neil"), F.lit("net_sales"))).first()[0] == "D-Mart O'Neil — Net Sales"
    assert spark.range(1).select(report.card_title(F.lit(""), F.lit(None).cast("string"))).first()[0] == "Entity — Attribute"
    assert rows(report.document_names(facts(spark, {}, {}))) == rows(facts(spark, {}).select("source_doc_name"))


def test_typed_values(spark):
    c = F.col
    cases = [((1.0, None, None), (None, None, True), True), ((0.0, None, None), (None, None, True), False), ((None, None, True), (None, None, False), False), ((None, "x", None), (None, None, True), True),
             ((None, "", None), (None, None, False), True), ((None, "A ", None), (None, "a", None), True), ((None, None, None), (None, None, True), False)]
    df = spark.createDataFrame([(*a, *b, w) for a, b, w in cases], "na double, sa string, ba boolean, nb double, sb string, bb boolean, want boolean")
    got = df.select(typed_values_match(c("na"), c("sa"), c("ba"), c("nb"), c("sb"), c("bb")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
