"""Reconciliation by similar spellings against brute force."""

import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quern.operators import reconcile
from quern.plans import registry
from quern.session import checkpointed
from tests.conftest import rows
from tests.test_reconcile import KEYED, facts

NOISE = {"limited", "ltd", "inc", "corp", "corporation", "llp", "pvt", "private", "co", "company"}
NAMES = (
    "Meridian Freight Grid", "Meridian Freight Gridd Ltd", "Grid Freight Meridian", "meridian frieght grid", "Lakshmi Textile Mills Co", "Lakshmi Textile Mills", "LAKSHMI TEXTILE MILL",
    "Department of Ports, Samapikavi", "Department of Ports, Somapikavi", "Department of Mines", "Abhishek Rao", "Abhishek Roa", "Rao Abhishek", "Company Ltd", "Co. Limited", "***", " *** ", "", "A B", "A C",
)


def alike(a, b):
    x, y = a.lower().strip(), b.lower().strip()
    if not x or not y or x == y:
        return x == y != ""
    every = [re.findall(r"\w+", s) for s in (x, y)]
    kept = [[w for w in e if w not in NOISE] for e in every]
    stems = [{w[:4] for w in k or e} for k, e in zip(kept, every)]
    texts = [" ".join(k) if k else s for k, s in zip(kept, (x, y))]
    jaccard = len(stems[0] & stems[1]) / len(stems[0] | stems[1]) if stems[0] | stems[1] else 0.0
    return 0.4 * jaccard + 0.6 * SequenceMatcher(None, *texts).ratio() >= 0.7


def table(spark):
    """Each name in several documents and attributes, under its own key, a shared one or none; every ninth fact is quarantined."""
    changes = []
    for n in range(3 * len(NAMES)):
        i = n * 7 % len(NAMES)
        key = None if n % 5 == 0 else "shared" if n % 11 == 0 else f"k{i}"
        changes.append(KEYED | {
            "entity_raw": NAMES[i], "entity_canonical": key, "attribute_canonical": "revenue" if n % 4 else "debt", "doc_hash": f"h{n % 6}", "is_quarantined": n % 9 == 8,
            "canonical_value_num": float(100 + n % 3), "scope": "CONSOLIDATED" if n % 2 else "India",
        })
    return checkpointed(facts(spark, *changes))


def brute(df):
    got = sorted(df.where("NOT is_quarantined").collect(), key=lambda r: r["ingest_seq"])
    return sorted(
        (x["fact_id"], y["fact_id"]) for i, y in enumerate(got) for x in got[:i]
        if x["attribute_canonical"] == y["attribute_canonical"] and x["doc_hash"] != y["doc_hash"]
        and (x["entity_canonical"] == y["entity_canonical"] is not None or alike(x["entity_raw"], y["entity_raw"]))
    )


def test_fuzzy_candidates_against_brute_force(spark):
    df = table(spark)
    want = brute(df)
    assert len(want) > len(rows(reconcile.candidates(df).select("a_fact_id", "b_fact_id"))) > 0
    assert rows(reconcile.fuzzy_candidates(df).select("a_fact_id", "b_fact_id")) == want
    first, second = df.where("ingest_seq <= 30"), df.where("ingest_seq > 30")
    both = reconcile.fuzzy_candidates(first).unionByName(reconcile.fuzzy_candidates(df, second))
    assert rows(both.select("a_fact_id", "b_fact_id")) == want


def test_queries_take_similar_spellings(spark, tmp_path):
    df = table(spark)
    df.write.parquet(str(tmp_path / "facts.parquet"))
    by_id = df.withColumns({f"{p}_{c}": F.col(c) for p in "ab" for c in reconcile.FACT_COLUMNS})
    a, b = (by_id.select(*(f"{p}_{c}" for c in reconcile.FACT_COLUMNS)) for p in "ab")
    pairs = spark.createDataFrame(brute(df), "a_fact_id string, b_fact_id string").join(a, "a_fact_id").join(b, "b_fact_id")
    want = Counter((r["a_attribute_canonical"], r["case_type"], r["relation"]) for r in reconcile.classify(pairs).collect())
    got = registry.QUERIES["q46_reconcile_similar"](spark, str(tmp_path)).collect()
    assert {(r["attribute"], r["case_type"], r["relation"]): r["pairs"] for r in got} == want
    # the batches change which fact is the older one, and with it the order of comparison, but not that a pair is compared
    late = F.pmod(F.xxhash64("doc_hash"), F.lit(2)) == 1
    ordered = df.withColumn("ingest_seq", F.col("ingest_seq") + F.when(late, F.lit(10**15)).otherwise(F.lit(0)))
    assert sum(r["pairs"] for r in registry.QUERIES["q47_incremental_similar"](spark, str(tmp_path)).collect()) == len(brute(ordered))
