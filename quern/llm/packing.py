"""Texts into containers of fixed capacity, by pattern packing on the histogram of sizes.

Only the histogram of sizes (at most ``capacity`` numbers) reaches the driver,
never the items. There

1. patterns of one to three sizes that fill a container exactly are enumerated,
2. repeat counts of the patterns are fitted to the histogram by non-negative
   least squares, with sizes that are easy to place later weighing less, and
   fitted again for the strongest patterns alone, as many as there are sizes: the
   fit spreads itself thin over all, and thin counts round to nothing,
3. the counts are rounded, never using more items than there are; 2 and 3 are
   repeated on what is left until no count rounds to one, and
4. the residual items are packed, largest first, into the container that they
   leave least space in, many equal containers at a time.

The plan is a list of slot ranges: of the items of size ``l``, numbers
``from``..``to`` go to consecutive containers. Its length follows the number of
different sizes, not of items. Items get their number within their size in two
steps, by hash bucket and within the bucket, so that one size that a third of
all items have isn't sorted in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import collect_bounded

CAPACITY = 2048
#: Rounds of a fit.
FIT_ROUNDS = 60
#: Hash buckets in which items of one size are numbered.
BUCKETS = 64


def patterns(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three sizes (0: none) that add up to ``capacity``, larger first, sizes from ``sizes``."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[sizes] = True
    rows = [[capacity, 0, 0]] if have[capacity] else []
    big = sizes[(sizes < capacity)]
    two = big[(2 * big >= capacity) & have[capacity - big]]
    rows += [[int(a), int(capacity - a), 0] for a in two]
    out = [np.array(rows, dtype=np.int64).reshape(-1, 3)]
    for a in big[3 * big >= capacity]:
        rest = capacity - a
        b = big[(big <= a) & (2 * big >= rest) & (big < rest)]
        b = b[have[rest - b] & (rest - b > 0)]
        if len(b):
            out.append(np.column_stack([np.full(len(b), a), b, rest - b]))
    return np.concatenate(out)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeat counts x of patterns so that their sizes match the histogram.

    Projected gradient with momentum on ||W (A x - h)||; the column sums of A'A
    bound its largest eigenvalue. Column i of A counts the sizes of pattern i,
    so A x and A' r are a bincount and a gather.
    """
    capacity = len(histogram) - 1
    # a size that is left over costs the more the harder it is to place
    weight = (np.arange(capacity + 1) / capacity) + 0.05
    weight[0] = 0.0
    w2 = weight**2
    h = histogram.astype(float)
    apply = lambda x: sum(np.bincount(rows[:, k], weights=x, minlength=capacity + 1) for k in range(3))
    transpose = lambda r: w2[rows[:, 0]] * r[rows[:, 0]] + w2[rows[:, 1]] * r[rows[:, 1]] + w2[rows[:, 2]] * r[rows[:, 2]]
    bound = transpose(apply(np.ones(len(rows)))).max()
    # start from equal shares of each size among the patterns that use it
    uses = apply(np.ones(len(rows)))
    share = np.where(uses > 0, h / np.maximum(uses, 1), 0.0)
    share[0] = np.inf
    x = share[rows].min(axis=1)
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        r = apply(y) - h
        r[0] = 0.0
        new = np.maximum(0.0, y - transpose(r) / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def fill_patterns(left: np.ndarray, capacity: int, rounds: int) -> list[tuple[list[int], int]]:
    """Containers by fitted patterns, wave by wave; takes their items from ``left``."""
    groups: list[tuple[list[int], int]] = []
    sizes = np.flatnonzero(left)
    rows = patterns(sizes, capacity) if len(sizes) else np.empty((0, 3), dtype=np.int64)
    while len(rows):
        strongest = np.argsort(-fit_counts(rows, left, rounds), kind="stable")[: np.count_nonzero(left)]
        few = rows[strongest]
        count = np.rint(fit_counts(few, left, rounds)).astype(np.int64)
        before = len(groups)
        for i in np.argsort(-count, kind="stable"):
            own, n = [int(s) for s in few[i] if s], int(count[i])
            if n == 0:
                break
            n = min(n, *(int(left[s]) // own.count(s) for s in own))
            if n > 0:
                for s in own:
                    left[s] -= n
                groups.append((own, n))
        if len(groups) == before:
            break
        rows = rows[((rows == 0) | (left[rows] > 0)).all(axis=1)]
    return groups


@dataclass
class Plan:
    """Slot ranges: of the items of ``size``, numbers from ``first`` on go to containers from ``container`` on."""

    capacity: int
    size: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    containers: int = 0


def make_plan(histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> Plan:
    """Packs ``histogram[l]`` items of each size ``l`` >= 1; deterministic."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    groups = fill_patterns(left, capacity, rounds)  # (sizes in a container, number of such containers)
    groups += pack_residual(left, capacity)
    plan, taken = Plan(capacity), np.zeros(capacity + 1, dtype=np.int64)
    for own, n in groups:
        at = 0
        for s in own:
            plan.size.append(s)
            plan.first.append(int(taken[s]))
            plan.container.append(plan.containers)
            plan.offset.append(at)
            taken[s] += n
            at += s
        plan.containers += n
    return plan


def pack_residual(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Largest size first, each into the open containers with the least space that holds it; many at a time."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # space left -> [(sizes, number)]
    spaces: list[int] = []  # sorted keys of open_
    closed: list[tuple[list[int], int]] = []

    def put(space: int, own: tuple[int, ...], n: int) -> None:
        if space == 0:
            closed.append((list(own), n))
            return
        if space not in open_:
            open_[space] = []
            bisect.insort(spaces, space)
        open_[space].append((own, n))

    for size in range(capacity, 0, -1):
        need = int(left[size])
        while need:
            i = bisect.bisect_left(spaces, size)
            if i < len(spaces):
                space = spaces[i]
                own, n = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[i]
                per = min(space // size, need)
                # as many copies as fit, in as many of these containers as there are items for
                use = min(n, need // per)
                put(space - per * size, own + (size,) * per, use)
                if n > use:
                    put(space, own, n - use)
                need -= use * per
            else:
                per = min(capacity // size, need)
                use = need // per
                put(capacity - per * size, (size,) * per, use)
                need -= use * per
    for space in spaces:
        closed += [(list(own), n) for own, n in open_[space]]
    return closed


def split_sizes(items: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """Items as pieces (key, piece, token_start, size): cut into capacities only where an item exceeds one."""
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")
    last = F.greatest(F.lit(0), F.floor((n - 1) / capacity)).cast("int")
    pieces = items.select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return pieces.select(key, "piece", start.alias("token_start"), F.least(F.lit(capacity), F.col("_n") - start).cast("int").alias("size"))


def numbered(pieces: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... within their size, the same in every run."""
    by = pieces.withColumn("_b", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    counts = by.groupBy("size", "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("size", "_b", F.coalesce(before, F.lit(0)).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("size", "_b").orderBy(key, "piece")) - 1
    return by.withColumn("_r", rank).join(starts, ["size", "_b"]).select(*pieces.columns, (F.col("_s") + F.col("_r")).alias("number"))


def pack(items: DataFrame, key: str, tokens: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, token_start, size, container_id, container_offset) of every item.

    ``tokens`` holds the sizes; null counts as 0. An item that exceeds the
    capacity is cut into pieces of exactly the capacity and one rest. Items of
    size 0 take no space and are spread evenly over the containers (container
    0 if there are none). ``key`` must be unique. Deterministic.
    """
    pieces = split_sizes(items, key, tokens, capacity)
    counted = collect_bounded(pieces.groupBy("size").count(), capacity + 1, "histogram of sizes")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counted:
        histogram[size] = n
    plan = make_plan(histogram)
    lanes = {}
    order = np.lexsort((plan.first, plan.size))
    size, first, container, offset = (np.array(x, dtype=np.int64)[order] for x in (plan.size, plan.first, plan.container, plan.offset))
    # one sorted key for (size, first number), searched by the workers; its length is bounded by the plan's
    lane_key = size << 44 | first
    total = plan.containers
    ranked = numbered(pieces.where("size > 0"), key)
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("container_id", T.LongType()), T.StructField("container_offset", T.IntegerType())])
    lanes = items.sparkSession.sparkContext.broadcast((lane_key, first, container, offset))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, begin, base, shift = lanes.value
        for batch in batches:
            number = batch["number"].to_numpy(dtype=np.int64)
            at = np.searchsorted(keys, batch["size"].to_numpy(dtype=np.int64) << 44 | number, side="right") - 1
            yield batch.drop(columns="number").assign(container_id=base[at] + number - begin[at], container_offset=shift[at].astype("int32"))

    placed = ranked.mapInPandas(place, schema)
    empty = pieces.where("size = 0").select(
        *pieces.columns, F.pmod(F.xxhash64(key), F.lit(max(1, total))).alias("container_id"), F.lit(0).alias("container_offset")
    )
    return placed.unionByName(empty)
