"""The store's relationships, which are kept in slices, against rows of pairs."""

from pyspark.sql import functions as F

from quern.operators import reconcile
from quern.sources import store
from quern.sources.store import FactStore
from tests.conftest import rows
from tests.test_reconcile import facts
from tests.test_similar import table


def digest(relations):
    each = F.xxhash64("fact_id_a", "fact_id_b", "case_type", "rationale", F.to_json("differing_dimensions")).cast("decimal(38,0)")
    return rows(relations.groupBy("case_type").agg(F.count("*"), F.sum(each)))


def counts(relations):
    return rows(relations.groupBy("case_type").agg(F.count("*").alias("pairs")))


def test_many_facts_of_one_thing(spark, tmp_path):
    """A relationship takes a byte at most on disk, and all of them are there."""
    n = F.col("ingest_seq")
    many = facts(spark, {}).drop("ingest_seq").crossJoin(spark.range(1600).select(F.col("id").alias("ingest_seq"))).withColumns({
        "fact_id": F.format_string("%016x", n * 1_000_003), "doc_hash": F.concat(F.lit("h"), F.floor(n / 10).cast("string")), "scope": F.when(n % 7 == 0, " consolidated").when(n % 11 > 0, F.lit("Consolidated")),
        "raw_value": F.concat(F.lit("Rs. "), (n % 5).cast("string"), F.lit(" crore")), "temporal_raw": F.when(n % 13 == 0, "PERPETUAL").otherwise(F.concat(F.lit("FY"), (10 + n % 4).cast("string"))),
        "canonical_value_num": F.lit(None).cast("double"), "entity_raw": F.when(n % 40 == 0, "Grid Freight Ltd").when(n % 41 == 0, "Gridd Freight Limited").otherwise(F.col("entity_raw")),
    }).cache()
    kept = FactStore(spark, str(tmp_path / "store"))
    returned = [counts(kept.ingest(b)) for b in (many.where(n < 900), many.where(n >= 900))]
    want = reconcile.relationships(reconcile.fuzzy_candidates(kept.facts()))
    pairs = want.count()
    assert pairs > 1_000_000 and sum(x[1] for r in returned for x in r) == pairs
    assert sum(f.stat().st_size for f in (tmp_path / "store" / "relationships").rglob("*.parquet")) < pairs
    assert digest(kept.relationships()) == digest(want)
    assert rows(kept.cases()) == counts(want)
    assert not list((tmp_path / "store" / "staged").glob("batch=*"))


def test_similar_spellings_and_strange_ids(spark, tmp_path):
    df = table(spark)
    ids = F.when(F.col("ingest_seq") % 3 == 0, F.col("fact_id")).when(F.col("ingest_seq") % 3 == 1, F.sha2("fact_id", 256)).otherwise(F.concat(F.upper(F.hex("fact_id")), F.lit("₹\n")))
    df = df.withColumn("fact_id", ids)
    for fuzzy, pick in ((True, reconcile.fuzzy_candidates), (False, reconcile.candidates)):
        kept = FactStore(spark, str(tmp_path / f"store{fuzzy}"))
        first = df.where("doc_hash IN ('h0', 'h3', 'h5')")
        late = df.where("doc_hash NOT IN ('h0', 'h3', 'h5')").withColumn("ingest_seq", F.col("ingest_seq") + 1000)
        kept.ingest(first, fuzzy)
        kept.ingest(late, fuzzy)
        want = reconcile.relationships(pick(store.canonicalize(first.unionByName(late))))
        assert rows(kept.relationships()) == rows(want) and rows(want)
        assert rows(kept.cases()) == counts(want)
