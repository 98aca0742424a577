import random

import pytest
from pyspark.sql import functions as F

from quern.llm import groups
from tests.conftest import rows


def plain(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted(((x, find(x)) for x in parent), key=repr)


def random_pairs(seed):
    rnd = random.Random(seed)
    names = [f"{rnd.choice('abZé')}{i}" for i in range(400)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(250)]
    pairs += [("hub", n) for n in names[:150]]  # a star of a third of all pairs
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)]  # a long chain
    pairs += [(n, n) for n in names[:5]] + [(None, "a"), ("a", None), (None, None)] + pairs[:20] + [(b, a) for a, b in pairs[:20]]
    rnd.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("seed, bound", [(1, 1_000_000), (2, 120), (3, 60)])
def test_groups_against_brute_force(spark, seed, bound):
    pairs = random_pairs(seed)
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("root", F.lit(1)).withColumn("node", F.lit(2))
    assert rows(groups.linked_groups(df.repartition(3), "a", "b", bound)) == plain(pairs)


def test_no_pairs(spark):
    assert groups.linked_groups(spark.createDataFrame([], "a string, b string"), "a", "b").isEmpty()


def test_case_types(spark):
    kinds = ["CASE_1_CORROBORATION", "case 1 corroboration\n", "Case-1 Corroboration", "CASE_2_GENUINE_CONTRADICTION", None, ""]
    df = spark.createDataFrame([(f"a{i}", f"b{i}", k) for i, k in enumerate(kinds)], "fact_id_a string, fact_id_b string, case_type string")
    assert rows(groups.corroborated_groups(df)) == sorted((f"{x}{i}", f"a{i}") for i in range(3) for x in "ab")


def test_many_levels(spark):
    """A monotone chain, a giant star and small groups through several levels of tiny partitions."""
    rnd = random.Random(5)
    pairs = [(f"c{i:05}", f"c{i + 1:05}") for i in range(1500)] + [("hub", f"h{i}") for i in range(1500)]
    pairs += [(f"s{i}", f"s{i + 1}") for i in range(0, 1500, 3)]
    rnd.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string").repartition(6)
    assert rows(groups.linked_groups(df, "a", "b", 200)) == plain(pairs)
