"""Counts of cases against the classified pairs themselves."""

from collections import Counter
from difflib import SequenceMatcher
from random import Random

import pytest
from pyspark.sql import functions as F

from quern.functions.similarity import match_ratios
from quern.operators import reconcile, tally
from quern.plans import registry
from quern.session import checkpointed
from tests.test_reconcile import KEYED, facts
from tests.test_similar import NAMES, alike

PERIODS = (("2021-04-01", "2022-03-31"), ("2021-04-01", "2021-06-30"), ("2021-05-01", "2022-05-31"), ("2020-01-01", "2023-01-01"), ("2022-05-01", "2021-01-01"), (None, "2021-01-01"), ("", ""))
NUMBERS = (None, 0.0, -0.0, 100.0, 100.4, 101.1, -100.0, float("nan"), float("inf"), float("-inf"))
TEXTS = (None, None, None, " Yes", "yes", "100.0", "")


def table(spark, n=500):
    """A hot entity and small ones, with every kind of value, open and inverted periods, missing keys and equal numbers of arrival."""
    r, changes = Random(7), []
    for i in range(n):
        start, end = r.choice(PERIODS)
        changes.append(KEYED | {
            "entity_canonical": r.choice(("hot", "hot", "hot", None, f"e{i % 29}")), "attribute_canonical": r.choice(("revenue", "revenue", "debt", None)), "doc_hash": r.choice((None, *(f"h{k}" for k in range(23)))),
            "start_date": start, "end_date": end, "granularity": r.choice(("YEAR", "YEAR", "PERPETUAL", None, "QUARTER")), "scope": r.choice(("India", " india ", "GLOBAL", None)),
            "canonical_unit": r.choice(("INR", "INR", "USD", None)), "canonical_value_num": r.choice(NUMBERS), "canonical_value_str": r.choice(TEXTS),
            "is_quarantined": r.choice((False, None, False, False, True)), "ingest_seq": r.randrange(n // 2),
        })
    return checkpointed(facts(spark, *changes))


def counts(df, *by):
    return Counter({tuple(r[c] for c in by): r["pairs"] for r in df.collect()})


def classified(pairs, *by):
    named = reconcile.classify(pairs).withColumn("attribute", F.col("a_attribute_canonical"))
    return counts(named.groupBy(*by).agg(F.count("*").alias("pairs")), *by)


@pytest.mark.parametrize("rows, small, cells", [(100_000, 48, 1 << 19), (60, 2, 512), (7, 1_000, 2_000)])
def test_candidate_cases_equal_the_classified_pairs(spark, monkeypatch, rows, small, cells):
    by = ("attribute", "case_type", "relation")
    df = table(spark)
    want = classified(reconcile.candidates(df), *by)
    assert len(want) == 20 and want.total() > 5_000
    # whatever the sizes of slices, tried here as the workers have their own copy of the module
    keys = ("attribute", "entity")
    monkeypatch.setattr(tally, "_ROWS", rows)
    monkeypatch.setattr(tally, "_SMALL", small)
    monkeypatch.setattr(tally, "_CELLS", cells)
    meeting = reconcile._meeting(df, None, F.col("f_attribute_canonical").alias("attribute"), F.col("f_entity_canonical").alias("entity"))
    placed = meeting.where("attribute IS NOT NULL AND entity IS NOT NULL AND doc IS NOT NULL").sort(*keys, "seq").toArrow()
    found = Counter()
    for whole in tally._whole_groups(placed.to_batches(max_chunksize=11), keys):
        found.update(tally._compare(whole, keys))
    cases = (reconcile.CORROBORATION, reconcile.CONTRADICTION, reconcile.RECONCILED)
    assert {(a, cases[c], r): n for (a, r, c), n in found.items() if n} == want
    assert counts(reconcile.candidate_cases(df), *by) == want


def test_reconcile_writes_no_pairs_out(spark, tmp_path):
    df = table(spark)
    df.write.parquet(str(tmp_path / "facts.parquet"))
    found = registry.QUERIES["q30_reconcile"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert counts(found, "attribute", "case_type", "relation") == classified(reconcile.candidates(df), "attribute", "case_type", "relation")


def test_incremental_counts_write_no_pairs_out(spark, tmp_path):
    df = table(spark)
    late = F.col("ingest_seq") > 120
    older, newer = df.where(~late), df.where(late)
    by = ("attribute", "case_type", "relation")
    assert counts(reconcile.candidate_cases(df, newer), *by) == classified(reconcile.candidates(df, newer), *by)
    assert counts(reconcile.candidate_cases(older), *by) + counts(reconcile.candidate_cases(df, newer), *by) == classified(reconcile.candidates(df), *by)
    df.write.parquet(str(tmp_path / "facts.parquet"))
    late = F.pmod(F.xxhash64("doc_hash"), F.lit(2)) == 1
    ordered = df.withColumn("ingest_seq", F.col("ingest_seq") + F.when(late, F.lit(10**15)).otherwise(F.lit(0)))
    found = registry.QUERIES["q32_incremental_equals_bulk"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert counts(found, "case_type") == classified(reconcile.candidates(ordered), "case_type")


def test_match_ratios_equal_the_matcher():
    r = Random(3)
    text = lambda: "".join(r.choice("abc d" if r.random() < 0.9 else "xé𝄞") for _ in range(r.choice((0, 1, 3, 9, 30, 30, 60, 199, 230))))
    pairs = [(x := text(), "".join(c for c in x if r.random() < 0.8) if r.random() < 0.5 else text()) for _ in range(600)]
    a, b = map(list, zip(*pairs))
    assert match_ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert match_ratios([], []).tolist() == []


def named(spark):
    r = Random(11)
    spelt = {x["fact_id"]: r.choice((*NAMES, None)) for x in table(spark).collect()}
    names = spark.createDataFrame(list(spelt.items()), "fact_id string, spelt string")
    return checkpointed(table(spark).join(names, "fact_id").withColumn("entity_raw", F.col("spelt")).drop("spelt"))


def test_similar_names_write_no_pairs_out(spark, tmp_path):
    df = named(spark)
    by = ("attribute", "case_type", "relation")
    want = classified(reconcile.fuzzy_candidates(df), *by)
    assert want.total() > classified(reconcile.candidates(df), *by).total() > 0
    df.write.parquet(str(tmp_path / "facts.parquet"))
    found = registry.QUERIES["q46_reconcile_similar"](spark, str(tmp_path))
    assert "b_" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert counts(found, *by) == want


def test_names_are_matched_where_they_meet(spark):
    df = spark.createDataFrame([(n,) for n in (*NAMES, None)], "entity_raw string")
    found = reconcile.similar_names(df)
    want = {(a, b) for a in NAMES for b in NAMES if a != b and alike(a, b)}
    assert {(r["name_a"], r["name_b"]) for r in found.collect() if r["name_a"].strip() != "***"} == {(a, b) for a, b in want if a.strip() != "***"}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_incremental_similar_names_write_no_pairs_out(spark, tmp_path):
    df = named(spark)
    by = ("attribute", "case_type", "relation")
    late = F.col("ingest_seq") > 120
    newer = checkpointed(df.where(late))
    assert counts(reconcile.fuzzy_candidate_cases(df, newer), *by) == classified(reconcile.fuzzy_candidates(df, newer), *by)
    df.write.parquet(str(tmp_path / "facts.parquet"))
    late = F.pmod(F.xxhash64("doc_hash"), F.lit(2)) == 1
    ordered = checkpointed(df.withColumn("ingest_seq", F.col("ingest_seq") + F.when(late, F.lit(10**15)).otherwise(F.lit(0))))
    found = registry.QUERIES["q47_incremental_similar"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert counts(found, "case_type") == classified(reconcile.fuzzy_candidates(ordered), "case_type")
