"""Similarity of names: token overlap in the JVM, character matching in an Arrow UDF."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import LEGAL_NOISE, let, strip, words

NAME_NOISE = (*LEGAL_NOISE, "co", "company")
JACCARD_SHARE, RATIO_SHARE, SAME_NAME = 0.4, 0.6, 0.70
QUOTE_RATIO = 0.85


def name_words(name: Column) -> Column:
    """Words of a name in order, in lower case, without legal forms unless nothing else is left."""
    every = words(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    return let(every, lambda e: let(_kept(e), lambda k: F.when(F.size(k) > 0, k).otherwise(e)))


def _kept(every: Column) -> Column:
    return F.filter(every, lambda w: ~w.isin(*NAME_NOISE))


def prefix_jaccard(a: Column, b: Column) -> Column:
    """Jaccard overlap of the words' first four letters; 0 if there are none."""
    stems = lambda c: F.array_distinct(F.transform(name_words(c), lambda w: F.substring(w, 1, 4)))
    x, y = stems(a), stems(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def compared_text(name: Column) -> Column:
    """The text whose characters are compared: kept words, or the whole name if it has only legal forms."""
    plain = F.lower(strip(F.coalesce(name, F.lit(""))))
    kept = lambda p: _kept(words(F.regexp_replace(p, r"[^\p{L}\p{N}_]+", " ")))
    return let(plain, lambda p: let(kept(p), lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(p)))


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _longest_matches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, start in x, start in y) of each column pair's longest common piece, the first in x, then in y."""
    run = np.zeros((len(y) + 1, x.shape[1]), dtype=np.uint16)
    back = (255 - np.arange(len(y), dtype=np.uint16))[:, None]
    size, at, to = (np.zeros(x.shape[1], dtype=np.int64) for _ in range(3))
    for i in range(len(x)):
        run[1:] = (run[:-1] + np.uint16(1)) * (x[i] == y)
        most = ((run[1:] << np.uint16(8)) | back).max(axis=0)
        better = (most >> 8) > size
        size[better], at[better], to[better] = most[better] >> 8, i, 255 - (most[better] & 255)
    return size, at - size + 1, to - size + 1


def match_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``match_ratio`` of many pairs at once: each round looks for the longest common piece of all pieces that are left."""
    length = np.array([[len(x), len(y)] for x, y in zip(a, b)], dtype=np.int64).reshape(-1, 2)
    out = np.ones(len(a))
    # from 200 characters on, the matcher passes over frequent ones
    for i in np.flatnonzero(length.max(axis=1, initial=0) >= 200):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    short = np.flatnonzero((length.max(axis=1, initial=0) < 200) & (length.sum(axis=1) > 0))
    codes = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = [np.r_[codes([t[i] for i in short]), np.zeros(200, dtype=np.uint32)] for t in (a, b)]
    offset = np.cumsum(length[short], axis=0) - length[short]
    matched = np.zeros(len(short), dtype=np.int64)
    left = np.c_[np.arange(len(short)), np.zeros_like(short), length[short, 0], np.zeros_like(short), length[short, 1]]
    while len(left := left[(left[:, 1] < left[:, 2]) & (left[:, 3] < left[:, 4])]):
        left = left[np.lexsort((left[:, 2] - left[:, 1], left[:, 4] - left[:, 3]))]
        after = []
        for at in range(0, len(left), 2048):
            pair, a_from, a_to, b_from, b_to = left[at : at + 2048].T
            sides = []
            for text, start, end, side, blank in ((letters[0], a_from, a_to, 0, 0xFFFFFFFE), (letters[1], b_from, b_to, 1, 0xFFFFFFFF)):
                step = np.arange((end - start).max())[:, None]
                sides.append(np.where(step < end - start, text[np.minimum(offset[pair, side] + start + step, len(text) - 1)], np.uint32(blank)))
            size, x, y = _longest_matches(*sides)
            np.add.at(matched, pair, size)
            x, y = x + a_from, y + b_from
            after += [np.c_[pair, a_from, x, b_from, y][size > 0], np.c_[pair, x + size, a_to, y + size, b_to][size > 0]]
        left = np.concatenate(after)
    out[short] = 2.0 * matched / length[short].sum(axis=1)
    return out


def similarity(a: Column, b: Column) -> Column:
    """0.4 prefix Jaccard + 0.6 character ratio; 1 for equal names, 0 if either is blank."""
    x, y = F.lower(strip(F.coalesce(a, F.lit("")))), F.lower(strip(F.coalesce(b, F.lit(""))))
    mixed = F.lit(JACCARD_SHARE) * prefix_jaccard(a, b) + F.lit(RATIO_SHARE) * match_ratio(compared_text(a), compared_text(b))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(mixed)


def similarity_bound(a: Column, b: Column) -> Column:
    """What ``similarity`` can't exceed, from word overlap and lengths alone."""
    la, lb = F.length(compared_text(a)), F.length(compared_text(b))
    ratio = F.coalesce(F.try_divide(2 * F.least(la, lb), la + lb), F.lit(0.0))
    return F.lit(JACCARD_SHARE) * prefix_jaccard(a, b) + F.lit(RATIO_SHARE) * ratio


def name_stems(name: Column) -> Column:
    """The words' different first four letters, in order."""
    return F.array_sort(F.array_distinct(F.transform(name_words(name), lambda w: F.substring(w, 1, 4))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def letter_marks(text: pd.Series) -> pd.Series:
    """256 bits in four numbers; each letter's n-th occurrence sets one of them.

    Two texts match in no more letters than their common bits and the
    occurrences that share a bit with another in one of them.
    """

    def marks(x: str) -> list[int]:
        bits, seen = bytearray(32), Counter()
        for c in x:
            at = crc32(f"{c}{seen[c]}".encode()) % 256
            bits[at // 8] |= 1 << at % 8
            seen[c] += 1
        return np.frombuffer(bytes(bits), dtype="<i8").tolist()

    return text.map(marks)


class _Page:
    """A page's words with running counts of their letters, made once for all its quotes."""

    def __init__(self, page: str):
        self.words = page.split()
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.r_[0, np.cumsum(lengths)]
        self.letters, which = np.unique(np.array(list("".join(self.words)), dtype="<U1"), return_inverse=True)
        have = np.zeros((len(self.words) + 1, len(self.letters)), dtype=np.int32)
        np.add.at(have, (np.repeat(np.arange(len(self.words)), lengths) + 1, which), 1)
        self.have = have.cumsum(axis=0)


_prepared = lru_cache(maxsize=64)(_Page)


def near_quote(quote: str, page: str, least: float = QUOTE_RATIO) -> bool:
    """Whether a window of as many words as ``quote`` has is at least ``least`` similar to it.

    Both texts are in grounding form. Windows whose letters overlap too little
    for the ratio are passed over by counts, which changes no answer: the ratio
    never exceeds twice the common letters over the total length.
    """
    size = len(quote.split())
    if not size or not page.strip():
        return False
    # long pages aren't kept
    p = _prepared(page) if len(page) < 100_000 else _Page(page)
    letters = Counter(quote.replace(" ", ""))
    known = np.isin(p.letters, list(letters))
    want = np.array([letters[c] for c in p.letters[known]])
    starts = np.arange(max(1, len(p.words) - size + 1))
    ends = np.minimum(starts + size, len(p.words))
    have = p.have[:, known]
    common = np.minimum(have[ends] - have[starts], want).sum(axis=1) + np.minimum(ends - starts, size) - 1
    total = len(quote) + p.ends[ends] - p.ends[starts] + (ends - starts - 1)
    for i in starts[2.0 * common >= least * total - 1e-9]:
        if SequenceMatcher(None, quote, " ".join(p.words[i : i + size])).ratio() >= least:
            return True
    return False


@F.pandas_udf(T.BooleanType())
def quote_is_near(quote: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([near_quote(q, p) for q, p in zip(quote, page)], dtype="bool")
