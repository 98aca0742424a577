"""Groups of records that pairs link directly or through others.

Union-find runs inside partitions of edges, of which only a spanning forest is
kept: at most one edge per record and partition, whatever the number of pairs.
The forests are merged level by level:

* A level hashes the forest by record, into partitions of bounded size, so that
  all roots of a record meet. A record has at most one edge per partition of the
  level before, so no hash value is hot, not even the centre of a star of a third
  of all pairs. Union-find in each partition gives every record that lives there
  one root, and the links between roots become the edges of the next level, which
  has roots only. Which of two linked records is the root is decided by a hash
  that changes with the level, so that chains shrink too, however they are named.
* The top level is the one that fits one partition: its forest is final.
* Down again, each level's records take over the roots of their roots. That is
  looked up once per root and salt, as a giant group's root is a hot key.

The number of levels follows the number of edges; there is no other case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpointed

#: Most forest edges that one partition of a level should hold, and the parts that a root's records are looked up in.
EDGES_PER_PARTITION, SALTS = 100_000, 32


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Root of each of ``n`` numbers under the links ``a[i]``-``b[i]``; roots are the smallest members."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def forest_of(root: np.ndarray, node: np.ndarray, level: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Star forest (root, node) of the links between two arrays of ids; every id is a node once.

    Roots are the smallest ids or, with ``level``, those of the smallest hash.
    """
    codes, names = pd.factorize(np.concatenate([root, node]).astype(object))
    if level is None:
        order = np.argsort(names, kind="stable")
    else:
        order = np.argsort(pd.util.hash_array(names, hash_key=f"{level:016d}", categorize=False), kind="stable")
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    names, codes = names[order], rank[codes]
    half = len(root)
    found = union_find(codes[:half], codes[half:], len(names))
    return names[found], names


def _local_forest(batches: Iterator[pd.DataFrame], level: int | None = None) -> Iterator[pd.DataFrame]:
    """Spanning forest of one partition, compressed as its batches arrive."""
    root = node = np.array([], dtype=object)
    waiting: list[pd.DataFrame] = []
    size = 0

    def fold(root, node):
        a = np.concatenate([root, *(w["root"].to_numpy(dtype=object) for w in waiting)])
        b = np.concatenate([node, *(w["node"].to_numpy(dtype=object) for w in waiting)])
        return forest_of(a, b, level)

    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= max(100_000, len(node)):
            root, node = fold(root, node)
            waiting, size = [], 0
    if waiting:
        root, node = fold(root, node)
    yield pd.DataFrame({"root": root, "node": node}, dtype=object)


def _meet(batches: Iterator[pd.DataFrame], level: int) -> Iterator[pd.DataFrame]:
    """One partition of a level, hashed by record: the root of each record of it (``up`` false) and the links between roots (``up`` true)."""
    whole = pd.concat(list(batches), ignore_index=True)
    root, node = forest_of(whole["root"].to_numpy(dtype=object), whole["node"].to_numpy(dtype=object), level)
    found = pd.DataFrame({"root": root, "node": node})
    here = found[found["node"].isin(whole["node"])]
    links = found[(found["root"] != found["node"]) & found["node"].isin(whole["root"])]
    yield pd.concat([here.assign(up=False), links.assign(up=True)], ignore_index=True)


def local_forests(edges: DataFrame, level: int | None = None) -> DataFrame:
    return edges.mapInPandas(partial(_local_forest, level=level), "root string, node string")


def _looked_up(records: DataFrame, found: DataFrame) -> DataFrame:
    """``records`` (node, root) with each root replaced by the one that ``found`` (node, root) has for it, if any."""
    salted = records.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    tops = found.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("top"))
    wanted = salted.select("root", "salt").distinct().join(tops, "root")
    return salted.join(wanted, ["root", "salt"], "left").select("node", F.coalesce("top", "root").alias("root"))


def linked_groups(pairs: DataFrame, a: str, b: str, edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """(node, root): every id in ``a`` or ``b`` once, with the smallest id of its group.

    Ids are strings, ordered by code point. A pair with a null id is dropped; a
    pair of an id with itself makes the id a member of its own group; repeated
    and reversed pairs change nothing; no pairs give no rows.
    """
    edges = pairs.select(F.col(a).alias("root"), F.col(b).alias("node")).where("root IS NOT NULL AND node IS NOT NULL")
    levels: list[DataFrame] = []
    while True:
        forest = checkpointed(local_forests(edges, len(levels)))
        parts = -(-forest.count() // edges_per_partition)
        if parts <= 1:
            break
        met = checkpointed(forest.repartition(parts, "node").mapInPandas(partial(_meet, level=len(levels)), "root string, node string, up boolean"))
        levels.append(met.where("NOT up").select("node", "root"))
        edges = met.where("up").select("root", "node")
    found = local_forests(forest.repartition(1)).select("node", "root")
    if not levels:
        return found
    for records in reversed(levels):
        found = checkpointed(_looked_up(records, found))
    return _looked_up(found, found.groupBy(F.col("root").alias("node")).agg(F.min("node").alias("root")))


def is_case(case_type, wanted: str):
    """Whether ``case_type`` names ``wanted`` in whatever case, spacing or separators."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return plain(case_type) == plain(F.lit(wanted))


def corroborated_groups(relationships: DataFrame) -> DataFrame:
    """(fact_id, group_id) of all facts in corroboration pairs."""
    pairs = relationships.where(is_case(F.col("case_type"), "CASE_1_CORROBORATION"))
    return linked_groups(pairs, "fact_id_a", "fact_id_b").select(F.col("node").alias("fact_id"), F.col("root").alias("group_id"))
