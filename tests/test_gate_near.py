"""The registered gate grounds near quotes too."""

from quern.operators import gate
from quern.plans import registry
from tests.test_reconcile import facts


def test_gate_takes_near_quotes(spark, tmp_path):
    quotes = ("Revenue rose to five crore", "Revenue roze to five crore", "profit fell to nine crore")
    facts(spark, *(dict(granularity="YEAR", verbatim_quote=q) for q in quotes)).write.parquet(str(tmp_path / "facts.parquet"))
    page = "doc_hash string, page_number int, chunk_index int, clean_text string"
    spark.createDataFrame([("h1", 1, 0, "The Revenue rose to five crore in May")], page).write.parquet(str(tmp_path / "page_chunks.parquet"))
    got = {r["ingest_seq"]: r["quarantine_reason"] for r in registry.QUERIES["q48_gate_near"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: None, 3: gate.UNVERIFIED}
