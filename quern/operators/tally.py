"""Classified pairs, counted or kept in slices, without a row for each.

The pairs of an entity grow with the square of its facts, their counts by case
don't. Facts that may meet are brought together; there each pair is compared as
``reconcile.classify`` does, in numpy.

A slice has facts and a byte for each of their pairs, which says relation and
case; ``slice_pairs`` spells them out again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.periods import DISJOINT, EQUAL, OVERLAPPING, PERPETUAL, SUBSET, SUPERSET
from quern.functions.similarity import JACCARD_SHARE, RATIO_SHARE, match_ratios
from quern.functions.text import strip
from quern.functions.values import TOLERANCE, value_text

CORROBORATION, CONTRADICTION, RECONCILED = 0, 1, 2
#: Rows that are compared at once, if they are whole groups; a larger group is taken whole.
_ROWS = 100_000
#: Groups up to this size are compared together, pair by pair; larger ones row by row against all others.
_SMALL = 48
_CELLS = 1 << 19
# what is known of a pair, in bits
_FROM_LATE, _FROM_EARLY, _TO_LATE, _TO_EARLY, _DISJOINT, _OPEN, _COUNTS, _SAME = (1 << n for n in range(8))


def shown(prefix: str = "") -> list[Column]:
    """What a relationship tells of a fact besides its unit."""
    return [_short(F.col(f"{prefix}fact_id")).alias("id"), F.col(f"{prefix}temporal_raw").alias("said"), F.col(f"{prefix}scope").alias("place")]


def compared(prefix: str = "") -> list[Column]:
    """What a fact is compared by (``classify``'s tests), from its columns under ``prefix``."""
    c = lambda n: F.col(prefix + n)
    missing = lambda n: c(n).isNull() | (c(n) == "")
    open_ = F.coalesce(c("granularity") == PERPETUAL, F.lit(False)) | missing("start_date") | missing("end_date")
    return [
        c("ingest_seq").alias("seq"), _short(c("doc_hash")).alias("doc"), F.when(~open_, c("start_date")).alias("start"), F.when(~open_, c("end_date")).alias("end"),
        F.lower(strip(c("scope"))).alias("scope"), c("canonical_unit").alias("unit"), c("canonical_value_num").alias("num"),
        value_text(c("canonical_value_num"), c("canonical_value_str")).alias("text"),
    ]


def _short(digest: Column) -> Column:
    """Another name for each text, half as long for digests, as most of what is shuffled would be those."""
    return F.when(digest.rlike(r"\A([0-9a-f]{2})+\z"), F.concat(F.lit(b"\x00"), F.unhex(digest))).otherwise(F.concat(F.lit(b"\x01"), F.encode(digest, "UTF-8")))


def _long(name: Column) -> Column:
    """The text that ``_short`` made ``name`` of."""
    rest = F.substring(name, 2, 1 << 30)
    return F.when(F.substring(name, 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers in the order of the texts, -1 for null; columns given together share them."""
    every = pa.chunked_array([x for c in columns for x in c.chunks], columns[0].type)
    known = pc.drop_null(pc.unique(every))
    known = known.take(pc.array_sort_indices(known))
    return [pc.fill_null(pc.index_in(c, value_set=known), -1).to_numpy().astype(np.int32) for c in columns]


def _starts(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        (x,) = _codes(rows[k])
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The sorted batches as tables of whole groups."""
    held, n, enough = [], 0, _ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(_starts(rows, keys)[-1])
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
            n -= cut
            enough = max(_ROWS, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class _Facts:
    """A table's columns as numbers."""

    def __init__(self, rows: pa.Table):
        self.start, self.end = _codes(rows["start"], rows["end"])
        self.open = self.start < 0
        (self.doc,), (scope,), (unit,), (self.text,) = (_codes(rows[n]) for n in ("doc", "scope", "unit", "text"))
        # a scope or unit that is null differs from everything
        self.kind = np.where((scope < 0) | (unit < 0), -1, scope.astype(np.int64) * (unit.max(initial=0) + 1) + unit)
        self.seq = rows["seq"].to_numpy()
        self.known = ~pc.is_null(rows["num"]).to_numpy()
        self.num = pc.fill_null(rows["num"], 0.0).to_numpy()
        self.older, self.newer = (rows[n].to_numpy() for n in ("older", "newer"))

    def seen(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The bits of the pairs (i, j); only those with ``_COUNTS`` are pairs that are asked for."""
        a_from, b_from, a_to, b_to = self.start[i], self.start[j], self.end[i], self.end[j]
        kind = self.kind[i]
        bits = (
            (a_from >= b_from, _FROM_LATE), (a_from <= b_from, _FROM_EARLY), (a_to >= b_to, _TO_LATE), (a_to <= b_to, _TO_EARLY),
            ((a_to < b_from) | (b_to < a_from), _DISJOINT), (self.open[i] | self.open[j], _OPEN),
            ((self.doc[i] != self.doc[j]) & (self.seq[i] < self.seq[j]) & self.older[i] & self.newer[j], _COUNTS),
            ((kind == self.kind[j]) & (kind >= 0), _SAME),
        )
        out = np.zeros(np.broadcast_shapes(i.shape, j.shape), dtype=np.uint8)
        for is_set, bit in bits:
            out |= is_set.view(np.uint8) * np.uint8(bit)
        return out

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``values_match``; Spark orders NaN above all numbers, and as equal to itself."""
        a, b = self.num[i], self.num[j]
        with np.errstate(invalid="ignore", over="ignore"):
            most = np.maximum(np.abs(a), np.abs(b))
            close = ((a == 0) & (b == 0)) | (np.abs(a - b) <= most * TOLERANCE) | np.isnan(most)
        return np.where(self.known[i] & self.known[j], close, (self.text[i] == self.text[j]) & (self.text[i] >= 0))


def _relation(bits: int) -> str:
    """``interval_relation``'s, in its order."""
    has = lambda *xs: all(bits & x for x in xs)
    if has(_OPEN):
        return PERPETUAL
    if has(_FROM_LATE, _FROM_EARLY, _TO_LATE, _TO_EARLY):
        return EQUAL
    if has(_DISJOINT):
        return DISJOINT
    if has(_FROM_LATE, _TO_EARLY):
        return SUBSET
    return SUPERSET if has(_FROM_EARLY, _TO_LATE) else OVERLAPPING


_SETTLED = np.array([bool(n & _COUNTS and n & _SAME) and _relation(n) in (EQUAL, PERPETUAL) for n in range(256)])
_RELATIONS = (EQUAL, PERPETUAL, DISJOINT, SUBSET, SUPERSET, OVERLAPPING)
#: A pair's byte in a slice: 0 for none that is asked for, else 1 and up by relation and case; as if the values differed.
_BYTE = np.array([1 + 3 * _RELATIONS.index(_relation(n)) + (CONTRADICTION if _SETTLED[n] else RECONCILED) if n & _COUNTS else 0 for n in range(256)], dtype=np.uint8)
_KINDS = 3 * len(_RELATIONS)


def _count(facts: _Facts, i: np.ndarray, j: np.ndarray, labels: np.ndarray, found: np.ndarray) -> None:
    """Adds the pairs to ``found``: by label, bits and whether the values agree."""
    bits = facts.seen(i, j)
    settled = np.flatnonzero(_SETTLED[bits].ravel())
    label = labels[i] if i.ndim == 1 else int(labels[i[0, 0]])
    if i.ndim == 1:
        cell = label.astype(np.int64) * 256 + bits
        x, y, cell_settled = i[settled], j[settled], cell[settled]
        found[:, :, 0] += np.bincount(cell, minlength=found[:, :, 0].size).reshape(found.shape[:2])
    else:
        row, column = np.divmod(settled, bits.shape[1])
        x, y, cell_settled = i[row, 0], j[0, column], label * 256 + bits.ravel()[settled].astype(np.int64)
        found[label, :, 0] += np.bincount(bits.ravel(), minlength=256)
    agreed = cell_settled[facts.agree(x, y)]
    found[:, :, 1] += np.bincount(agreed, minlength=found[:, :, 1].size).reshape(found.shape[:2])


def _crossed(rows: np.ndarray, last: np.ndarray, first: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``rows`` with those from ``first`` (else the next one) up to ``last`` of it, in slices of bounded size."""
    begin = rows + 1 if first is None else first
    sizes = (last[rows] if first is None else last) - begin
    rows, begin, sizes = rows[sizes > 0], begin[sizes > 0], sizes[sizes > 0]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, "right")))
        n = sizes[at:to]
        yield np.repeat(rows[at:to], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[at:to], n)
        at = to


class _Names:
    """What the names of a table are bounded by: lengths, word beginnings, counts of letters (the rare ones together)."""

    def __init__(self, texts: list[str], stems: list[str]):
        self.texts, self.stems = texts, [frozenset(x.split(" ")) if x else frozenset() for x in stems]
        self.n = np.array([len(x) for x in texts], dtype=np.int64)
        self.k = np.array([len(x) for x in self.stems], dtype=np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        known, which, often = np.unique(codes, return_inverse=True, return_counts=True)
        column = np.empty(len(known), dtype=np.int64)
        column[np.argsort(-often, kind="stable")] = np.minimum(np.arange(len(known)), 39)
        flat = np.repeat(np.arange(len(texts)), self.n) * 40 + column[which]
        self.letters = np.bincount(flat, minlength=40 * len(texts)).reshape(-1, 40).astype(np.int32)
        number = {s: n for n, s in enumerate(sorted(set().union(*self.stems)))}
        self.bits = np.array([sum({1 << number[s] % 64 for s in x}) for x in self.stems], dtype=np.uint64)
        self.hidden = self.k - np.bitwise_count(self.bits)

    def near(self, x: np.ndarray, y: np.ndarray, stem: np.ndarray, at: np.ndarray, least: float, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which pairs, blend of x with y, blend of y with x) of the pairs of names that may reach ``least`` either way.

        ``stem[at]`` is what the two were brought together by; a pair counts
        only under the first that they share. ``wanted`` tells which of some
        pairs are asked for. Bounds go from cheap to dear.
        """
        bound = lambda shared, letters, x, y: JACCARD_SHARE * (shared / np.maximum(self.k[x] + self.k[y] - shared, 1)) + RATIO_SHARE * (2 * letters / (self.n[x] + self.n[y]))
        shared = np.bitwise_count(self.bits[x] & self.bits[y]) + np.minimum(self.hidden[x], self.hidden[y])
        equal = x == y
        kept = np.flatnonzero(equal | (bound(shared, np.minimum(self.n[x], self.n[y]), x, y) >= least - 1e-9))
        if wanted:
            kept = kept[wanted(kept)]
        u, v = x[kept], y[kept]
        letters = np.minimum(self.letters[u], self.letters[v]).sum(axis=1)
        some = equal[kept] | (bound(shared[kept], letters, u, v) >= least - 1e-9)
        kept, letters = kept[some], letters[some]
        u, v = x[kept], y[kept]
        common = [self.stems[i] & self.stems[j] for i, j in zip(u.tolist(), v.tolist())]
        shared = np.array([len(c) for c in common], dtype=np.int64)
        here = np.array([(min(c) if c else self.texts[i]) == s for c, i, s in zip(common, u.tolist(), stem[at[kept]])], dtype=bool)
        here &= equal[kept] | (bound(shared, letters, u, v) >= least - 1e-9)
        kept, shared = kept[here], shared[here]
        u, v = x[kept].tolist(), y[kept].tolist()
        overlap = JACCARD_SHARE * (shared / np.maximum(self.k[u] + self.k[v] - shared, 1))
        a, b = [self.texts[i] for i in u], [self.texts[i] for i in v]
        return kept, overlap + RATIO_SHARE * match_ratios(a, b), overlap + RATIO_SHARE * match_ratios(b, a)


def _near_nodes(rows: pa.Table, starts: np.ndarray, group: tuple[str, ...], least: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, blend, blend the other way) of names of one group that may reach ``least``, as numbers of ``starts``; equal ones are above it.

    Only those that ``wanted`` says yes to, if it is given.
    """
    nodes = rows.select(["name", "stems", "stem", *(k for k in group if k != "stem")]).take(starts)
    texts = pc.unique(nodes["name"])
    name = pc.index_in(nodes["name"], value_set=texts).to_numpy()
    _, one = np.unique(name, return_index=True)
    names = _Names(texts.to_pylist(), nodes["stems"].take(one).to_pylist())
    begins = _starts(nodes, group)
    sizes = np.diff(np.r_[begins, len(starts)])
    stem = np.array(nodes["stem"].to_pylist(), dtype=object)
    for x, y in _crossed(np.arange(len(starts)), np.repeat(begins + sizes, sizes)):
        kept, there, back = names.near(name[x], name[y], stem, x, least, wanted and (lambda some, x=x, y=y: wanted(x[some], y[some])))
        x, y = x[kept], y[kept]
        equal = name[x] == name[y]
        yield x, y, np.where(equal, 1.0, there), np.where(equal, 1.0, back)


def _near_pairs(rows: pa.Table, facts: _Facts, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What may be pairs of facts of one attribute and stem whose keys differ and whose names reach ``least``."""
    starts = _starts(rows, ("attribute", "stem", "name", "entity"))
    ends = np.r_[starts[1:], rows.num_rows]
    key = _codes(rows["entity"])[0][starts]
    older, newer = (np.logical_or.reduceat(x, starts) for x in (facts.older, facts.newer))

    def wanted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # a key that is null equals none
        differ = (key[x] != key[y]) | (key[x] < 0)
        return differ & ((older[x] & newer[y]) | (older[y] & newer[x]))

    for x, y, there, back in _near_nodes(rows, starts, ("attribute", "stem"), least, wanted):
        for a, b, blend in ((x, y, there), (y, x, back)):
            a, b = a[blend >= least], b[blend >= least]
            n = ends[a] - starts[a]
            first = np.repeat(starts[a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield from _crossed(first, np.repeat(ends[b], n), np.repeat(starts[b], n))
    # names that are one, without a key
    alone = np.flatnonzero(key < 0)
    last = np.repeat(ends, ends - starts)
    first_stem = np.array([s == (min(t.split(" ")) if t else n) for s, t, n in zip(*(rows[c].take(starts[alone]).to_pylist() for c in ("stem", "stems", "name")))], dtype=bool)
    alone = alone[first_stem]
    n = ends[alone] - starts[alone]
    yield from _crossed(np.repeat(starts[alone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), last)


def _equal_pairs(rows: pa.Table, facts: _Facts, keys: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What may be pairs inside whole groups, sorted by ``seq`` inside: two lists, or a column and a row to cross."""
    starts = _starts(rows, keys)
    sizes = np.diff(np.r_[starts, rows.num_rows])
    small = np.repeat(sizes <= _SMALL, sizes)
    yield from _crossed(np.flatnonzero(small & facts.older), np.repeat(starts + sizes, sizes))
    side = int(_CELLS**0.5)
    for at, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL]):
        a, b = (at + np.flatnonzero(x[at : at + n]) for x in (facts.older, facts.newer))
        done = 0
        while done < len(a):
            meets = b[np.searchsorted(facts.seq[b], facts.seq[a[done]], "right") :]
            if not len(meets):
                break
            block = a[done : done + max(side, _CELLS // len(meets))]
            # nearly square, so that a slice has few facts for its pairs
            width = max(side, _CELLS // len(block))
            for to in range(0, len(meets), width):
                yield block[:, None], meets[None, to : to + width]
            done += len(block)


def _compare(rows: pa.Table, facts: _Facts, pairs: Iterable[tuple[np.ndarray, np.ndarray]], label: str) -> Counter:
    """(label, relation, case) -> pairs."""
    names = pc.unique(rows[label])
    labels = pc.index_in(rows[label], value_set=names).to_numpy()
    found = np.zeros((len(names), 256, 2), dtype=np.int64)
    for i, j in pairs:
        _count(facts, i, j, labels, found)
    return _by_case(names, found)


def _bytes(facts: _Facts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The pairs' bytes."""
    bits = facts.seen(i, j)
    out = _BYTE[bits]
    settled = np.flatnonzero(_SETTLED[bits].ravel())
    if i.ndim == 1:
        x, y = i[settled], j[settled]
    else:
        row, column = np.divmod(settled, bits.shape[1])
        x, y = i[row, 0], j[0, column]
    out.reshape(-1)[settled[facts.agree(x, y)]] -= np.uint8(CONTRADICTION - CORROBORATION)
    return out


SLICE = "ids array<binary>, said array<string>, places array<string>, units array<string>, older binary, newer binary, crossed boolean, kinds binary, counts array<bigint>"


def _slice(rows: pa.Table, i: np.ndarray, j: np.ndarray, kinds: np.ndarray, crossed: bool) -> pa.RecordBatch:
    at, place = np.unique(np.r_[i, j], return_inverse=True)
    place = place.astype("<i4")
    facts = rows.select(["id", "said", "place", "unit"]).take(at).combine_chunks()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.concat_arrays(c.chunks)) for c in facts.columns]
    counts = np.bincount(kinds, minlength=_KINDS + 1)[1:]
    rest = [place[: len(i)].tobytes(), place[len(i) :].tobytes(), crossed, kinds.tobytes(), counts.tolist()]
    kept = [pa.array([x], kind) for x, kind in zip(rest, (pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.list_(pa.int64())))]
    return pa.RecordBatch.from_arrays([*lists, *kept], [f.split()[0] for f in SLICE.split(", ")])


def _slices(rows: pa.Table, facts: _Facts, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """All of ``pairs`` that are asked for, as slices: crossed ones as they come, the others together."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for i, j in pairs:
        kinds = _bytes(facts, i, j)
        if i.ndim == 2:
            if kinds.any():
                yield _slice(rows, i[:, 0], j[0], kinds.ravel(), True)
            continue
        kept = np.flatnonzero(kinds)
        held.append((i[kept], j[kept], kinds[kept]))
        n += len(kept)
        if n >= _CELLS:
            yield _slice(rows, *map(np.concatenate, zip(*held)), False)
            held, n = [], 0
    if n:
        yield _slice(rows, *map(np.concatenate, zip(*held)), False)


def _by_case(names: pa.Array, found: np.ndarray) -> Counter:
    out: Counter = Counter()
    for k, bits in zip(*np.nonzero(found[:, :, 0])):
        if bits & _COUNTS:
            name, relation, (n, agreed) = names[int(k)].as_py(), _relation(int(bits)), found[k, bits]
            if _SETTLED[bits]:
                out[name, relation, CORROBORATION] += int(agreed)
                out[name, relation, CONTRADICTION] += int(n - agreed)
            else:
                out[name, relation, RECONCILED] += int(n)
    return out


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(label, relation, case, pairs) of the pairs inside the groups of ``keys``; the first key is the label.

    ``rows`` has ``compared``'s columns, the keys, and whether a fact may be a
    pair's older side (``older``) or its newer one (``newer``). A pair has a
    smaller and a larger ``seq`` and two documents.
    """
    return _summed(_by_keys(rows, keys), keys, lambda whole, facts: _equal_pairs(whole, facts, keys), keys[0])


def counted_near(rows: DataFrame, least: float) -> DataFrame:
    """``counted`` for facts of one ``attribute`` whose ``entity`` keys differ and whose names are similar enough, older one first.

    ``rows`` has ``name`` (the compared text), ``stems`` (its word beginnings,
    parted by blanks) and, for each of those, a row with it as ``stem``. Names
    that share none can't reach 0.7.
    """
    return _summed(_by_stem(rows), ("attribute", "stem"), lambda whole, facts: _near_pairs(whole, facts, least), "attribute")


def listed(rows: DataFrame, *keys: str) -> DataFrame:
    """``SLICE`` rows of the pairs that ``counted`` counts; ``rows`` has ``shown``'s columns too."""
    return _cut(_by_keys(rows, keys), keys, lambda whole, facts: _equal_pairs(whole, facts, keys))


def listed_near(rows: DataFrame, least: float) -> DataFrame:
    """``SLICE`` rows of the pairs that ``counted_near`` counts; ``rows`` has ``shown``'s columns too."""
    return _cut(_by_stem(rows), ("attribute", "stem"), lambda whole, facts: _near_pairs(whole, facts, least))


def _by_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    asked = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, "seq", "doc")))
    return asked.repartition(*keys).sortWithinPartitions(*keys, "seq")


def _by_stem(rows: DataFrame) -> DataFrame:
    asked = rows.where("attribute IS NOT NULL AND name <> '' AND seq IS NOT NULL AND doc IS NOT NULL")
    return asked.repartition("attribute", "stem").sortWithinPartitions("attribute", "stem", "name", "entity", "seq")


def _cut(placed: DataFrame, keys: tuple[str, ...], pairs: Callable[[pa.Table, _Facts], Iterable[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, keys):
            facts = _Facts(whole)
            yield from _slices(whole, facts, pairs(whole, facts))

    return placed.mapInArrow(cut, SLICE)


def slice_counts(slices: DataFrame) -> DataFrame:
    """(relation, case, pairs) of all slices, by what each has of every kind."""
    relation = F.array(*map(F.lit, _RELATIONS))[F.floor(F.col("kind") / 3).cast("int")]
    each = slices.select(F.posexplode("counts").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("pairs")).where("pairs > 0")
    return each.select(relation.alias("relation"), (F.col("kind") % 3).alias("case"), "pairs")


_PAIR = "id_a binary, id_b binary, relation int, case int, a_temporal_raw string, b_temporal_raw string, a_scope string, b_scope string, a_canonical_unit string, b_canonical_unit string"


def slice_pairs(slices: DataFrame) -> DataFrame:
    """(a_fact_id, b_fact_id, relation, case, and a_ and b_ temporal_raw, scope, canonical_unit): a row for each pair of the slices."""

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = {c: batch.column(c)[n] for c in batch.schema.names}
                lists = [one[c].values for c in ("ids", "said", "places", "units")]
                older, newer = (np.frombuffer(one[c].as_py(), dtype="<i4") for c in ("older", "newer"))
                kinds = np.frombuffer(one["kinds"].as_py(), dtype=np.uint8)
                there = np.flatnonzero(kinds)
                for at in range(0, len(there), _ROWS):
                    some = there[at : at + _ROWS]
                    i, j = divmod(some, len(newer)) if one["crossed"].as_py() else (some, some)
                    relation, case = np.divmod(kinds[some].astype(np.int32) - 1, 3)
                    sides = [(x.take(pa.array(older[i])), x.take(pa.array(newer[j]))) for x in lists]
                    columns = [*sides[0], pa.array(relation), pa.array(case), *(x for s in sides[1:] for x in s)]
                    yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _PAIR.split(", ")])

    pairs = slices.drop("counts").mapInArrow(spell, _PAIR)
    relation = F.array(*map(F.lit, _RELATIONS))[F.col("relation")]
    return pairs.withColumns({"a_fact_id": _long(F.col("id_a")), "b_fact_id": _long(F.col("id_b")), "relation": relation}).drop("id_a", "id_b")


def near_texts(names: DataFrame, least: float) -> DataFrame:
    """(a_name, b_name, similarity) of different names that reach ``least``, both ways round; ``names`` as in ``counted_near``."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, ("stem",)):
            name = whole["name"].combine_chunks()
            for x, y, there, back in _near_nodes(whole, np.arange(whole.num_rows), ("stem",), least):
                for a, b, blend in ((x, y, there), (y, x, back)):
                    a, b, blend = (v[blend >= least] for v in (a, b, blend))
                    yield pa.RecordBatch.from_arrays([name.take(pa.array(a)), name.take(pa.array(b)), pa.array(blend)], ["a_name", "b_name", "similarity"])

    return names.repartition("stem").sortWithinPartitions("stem", "name").mapInArrow(find, "a_name string, b_name string, similarity double")


def _summed(placed: DataFrame, keys: tuple[str, ...], pairs: Callable[[pa.Table, _Facts], Iterable[tuple[np.ndarray, np.ndarray]]], label: str) -> DataFrame:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for whole in _whole_groups(batches, keys):
            facts = _Facts(whole)
            found.update(_compare(whole, facts, pairs(whole, facts), label))
        cells = [(*k, n) for k, n in found.items() if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[n] for x in cells], kind) for n, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], ["label", "relation", "case", "pairs"]
        )

    parts = placed.mapInArrow(count, "label string, relation string, case int, pairs bigint")
    return parts.groupBy("label", "relation", "case").agg(F.sum("pairs").alias("pairs"))
