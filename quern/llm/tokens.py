"""Byte-level BPE over a whole corpus, in batched numpy merge rounds.

Each worker process loads the ranks once and turns them into two sorted arrays:
the key of every pair of tokens that merges (left * size + right) and the token
that it becomes. The words of a batch that are not in the worker's cache are
laid out as symbols in one flat array. A round looks all neighbouring pairs up
by binary search in the keys, takes the pair of lowest rank in each word,
merges all its occurrences from the left, and closes the gaps; words without a
mergeable pair leave. A batch takes as many rounds as its longest chain of
merges, each a handful of numpy calls over all words at once.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the public word pattern of this family of vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = np.int64(1) << 60
#: Characters of text that a worker breaks into words at a time, and words it remembers.
CHARS_AT_ONCE = 500_000
WORDS_KEPT = 300_000


class ByteBPE:
    """One vocabulary: token bytes with ranks, which are also the ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.size = np.int64(max(ranks.values()) + 1)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (left, right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        ]
        table = np.array(pairs, dtype=np.int64)
        keys = table[:, 0] * self.size + table[:, 1]
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], table[order, 2]
        self.words = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NEVER)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one array, number of ids of each word)."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = np.full(len(symbol), _NEVER)
            inside = word[1:] == word[:-1]
            pair[:-1][inside] = self._rank(symbol[:-1][inside], symbol[1:][inside])
            first = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(pair, first)
            sizes = np.diff(np.r_[first, len(symbol)])
            open_ = np.repeat(lowest < _NEVER, sizes)
            if not open_.all():
                done.append((word[~open_], symbol[~open_]))
                symbol, word, pair = symbol[open_], word[open_], pair[open_]
                lowest, sizes = lowest[lowest < _NEVER], sizes[lowest < _NEVER]
                if not len(symbol):
                    break
            hit = np.flatnonzero(pair == np.repeat(lowest, sizes))
            # in a run of overlapping hits (a a a) only every second one merges
            run = np.cumsum(np.r_[True, (np.diff(hit) != 1)]) - 1
            place = np.arange(len(hit)) - np.flatnonzero(np.r_[True, np.diff(hit) != 1])[run]
            hit = hit[place % 2 == 0]
            symbol = symbol.copy()
            symbol[hit] = pair[hit]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done:
            return np.empty(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, number of ids of each text); a null text has none."""
        if len(self.index) > WORDS_KEPT:
            self.forget()
        found = [self.words.findall(t) if t else [] for t in texts]
        new = dict.fromkeys(w for ws in found for w in ws if w not in self.index)
        if new:
            # a surrogate can't be UTF-8; it becomes the replacement character
            ids, count = self.encode_words([w.encode("utf-8", "replace") for w in new])
            base = len(self.start) - 1
            self.index.update(zip(new, range(base, base + len(new))))
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(count)])
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(found)), dtype=np.int64, count=int(n.sum()))
        begin, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) - np.repeat(ends - size, size) + np.repeat(begin, size)] if total else np.empty(0, dtype=np.int32)
        per_text = np.zeros(len(texts), dtype=np.int64)
        np.add.at(per_text, np.repeat(np.arange(len(texts)), n), size)
        return flat, per_text


_LOADED: dict[str, ByteBPE] = {}


def vocabulary(path: str) -> ByteBPE:
    """The vocabulary of this worker process, read once."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def text_slices(texts: list[str | None], chars: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of about ``chars`` characters (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """(key, ids): token ids of each text, without special tokens.

    Null and empty texts have an empty list; blank texts are encoded like any
    other. Rows are mapped one to one, without a shuffle. ``path`` is the
    vocabulary file, by default byte_bpe_50k in ``TOKENIZERS``.
    """
    file = path or os.path.join(TOKENIZERS, BYTE_BPE_50K)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(file)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                ids, count = bpe.encode_texts(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=[key, out])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """(key, n_tokens): number of tokens of each text; 0 for null and empty texts."""
    file = path or os.path.join(TOKENIZERS, BYTE_BPE_50K)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(file)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_slices(texts):
                _, count = bpe.encode_texts(texts[a:b])
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(count)], names=[key, out])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)
