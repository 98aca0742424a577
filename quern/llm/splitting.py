"""Oversized texts cut into overlapping pieces at natural boundaries, by ranges.

No task holds a whole text. A text (or file) is a row of ranges of fixed size:

1. each range finds the words that *start* in it and the natural boundaries among
   them, looking back a halo of ``HALO`` characters over its left edge,
2. word counts per range are stitched to prefix sums in two steps, over blocks of
   ``BLOCK`` ranges and within them, which gives every range the number of its
   first word and every text its length,
3. cuts are planned on word numbers, block by block, from the boundary tables, so
   that a giant text is planned in bounded parts; a block begins at a natural
   boundary near its left edge,
4. pieces are emitted by offset: each meets only the ranges that it covers.

Range and block sizes move cuts among equally good boundaries, nothing else.
A piece reaches from the start of its first word to the start of the word after
its last one; the first piece also has leading blanks and the last one trailing
blanks, so the pieces without their overlaps give the text back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import BLANK
from quern.session import checkpointed

RANGE, HALO, BLOCK = 32_768, 64, 64
LIMIT, OVERLAP = 2048, 128
_WORD = re.compile(r"\S+")
# Marks that end a sentence or a clause, and what may close after them.
_SENTENCE = re.compile(r"[.!?…।。！？][\"'”’»)\]]*$")
_CLAUSE = re.compile(r"[,;:،、][\"'”’»)\]]*$")
_PARAGRAPH = re.compile(r"\n\s*\n|\r\s*\r(?!\n)|\f|\u2029")
_LINE = re.compile(r"[\n\r\u2028\x85\v]")


def words_within(tokens: int) -> int:
    """Most words whose estimate (1.3 a word, rounded down) is at most ``tokens``."""
    n = (tokens * 10 + 9) // 13
    return n


def estimate(words):
    """Estimated tokens of a number of words, at least 1."""
    return F.greatest(F.lit(1), F.floor(words * F.lit(13) / F.lit(10)))


def boundary_class(gap: str) -> int:
    """How natural a cut after ``gap`` is: 4 paragraph, 3 line, 2 sentence, 1 clause, 0 word.

    ``gap`` is what precedes a word, up to ``HALO`` characters.
    """
    text = gap.rstrip()
    blank = gap[len(text) :]
    if _PARAGRAPH.search(blank):
        return 4
    if _LINE.search(blank):
        return 3
    if _SENTENCE.search(text):
        return 2
    return 1 if _CLAUSE.search(text) else 0


def word_starts(before: str, text: str) -> list[int]:
    """Offsets in ``text`` of the words that start in it."""
    starts = [m.start() for m in _WORD.finditer(text)]
    if starts and starts[0] == 0 and before and not before[-1].isspace():
        del starts[0]
    return starts


def boundary_classes(joined: str, starts: list[int]) -> list[int]:
    """``boundary_class`` of the words that start at ``starts``; a letter and one space before a word make it 0 at a glance."""
    return [0 if joined[s - 1 : s] == " " and joined[s - 2 : s - 1].isalnum() else boundary_class(joined[max(0, s - HALO) : s]) for s in starts]


def text_ranges(df: DataFrame, key: str, text: str, size: int = RANGE) -> DataFrame:
    """(key, range_no, before, text): the ranges of each text, sliced in one pass; null and empty texts have none."""
    parts = df.where(F.char_length(text) > 0).select(F.col(key).alias("key"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("parts"))
    # of the range before only the halo goes along
    halo = F.concat(F.array(F.lit("")), F.transform("parts", lambda x: F.right(x, F.lit(HALO))))
    rows = parts.select("key", F.posexplode(F.arrays_zip(F.col("parts").alias("text"), F.slice(halo, 1, F.size("parts")).alias("before"))).alias("range_no", "r"))
    return rows.select("key", "range_no", "r.before", "r.text")


def counted_words(ranges: DataFrame) -> DataFrame:
    """(key, range_no, n): the words that start in each range, without leaving the JVM."""
    continued = F.rlike("before", F.lit(f"[^{BLANK}]\\z")) & F.rlike("text", F.lit(f"^[^{BLANK}]"))
    return ranges.select("key", "range_no", (F.regexp_count("text", F.lit(f"[^{BLANK}]+")) - continued.cast("int")).alias("n"))


def file_ranges(spark: SparkSession, files: DataFrame, size: int = RANGE) -> DataFrame:
    """Ranges of UTF-8 files: ``files`` has (path, length in bytes) of files that all workers can open.

    A range of bytes holds the characters whose first byte lies in it, so each
    worker reads its own bytes and a halo, never the file.
    """
    plan = files.select("path", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size).cast("int") - 1)).alias("range_no")).where("length > 0")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, n in zip(batch["path"], batch["range_no"]):
                start = int(n) * size
                back = min(start, 4 * HALO + 4)
                with open(path, "rb") as f:
                    f.seek(start - back)
                    data = f.read(back + size + 4)
                cont = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
                a, b = back, min(len(data), back + size)
                while cont(a):
                    a += 1
                while cont(b):
                    b += 1
                rows.append((path, n, data[:a].decode("utf-8", "ignore")[-HALO:], data[a:b].decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["key", "range_no", "before", "text"])

    return plan.repartition("path", "range_no").mapInPandas(read, "key string, range_no int, before string, text string")


def _boundaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, no, before, text in zip(batch["key"], batch["range_no"], batch["before"], batch["text"]):
            before = before or ""
            starts = word_starts(before, text)
            cls = boundary_classes(before + text, [s + len(before) for s in starts])
            at = [w for w, c in enumerate(cls) if c]
            rows.append((key, no, len(starts), at, [cls[w] for w in at]))
        yield pd.DataFrame(rows, columns=["key", "range_no", "n", "word", "cls"])


def boundary_tables(ranges: DataFrame) -> DataFrame:
    """(key, range_no, n, word, cls): the words of each range, and those of them that a natural boundary precedes; counted once."""
    kind = ranges.schema["key"].dataType.simpleString()
    return checkpointed(ranges.mapInPandas(_boundaries, f"key {kind}, range_no int, n int, word array<int>, cls array<int>"))


def stitched(tables: DataFrame, limit: int, shared: int = 0, block: int = BLOCK) -> DataFrame:
    """``tables`` of the texts over ``limit`` with ``first``, the number of the range's first word, and what planning needs.

    ``total`` words and ``last_range`` are the text's, ``b`` is the planning
    block and ``edge`` tells whether the range begins one.
    """
    at = F.floor(F.col("range_no") / block).cast("int")
    # the block's first range begins a planning block if it holds more words than the overlap
    opens = F.max(F.when(F.col("range_no") % block == 0, F.col("n"))) > shared
    sums = tables.groupBy("key", at.alias("block")).agg(F.sum("n").alias("words"), F.max("range_no").alias("last"), opens.alias("opens"))
    order, whole = Window.partitionBy("key").orderBy("block"), Window.partitionBy("key")
    edge = F.coalesce("opens", F.lit(False)) & (F.col("block") > 0)
    blocks = sums.select(
        "key", "block", (F.sum("words").over(order) - F.col("words")).alias("words_before"), F.sum("words").over(whole).alias("total"),
        F.max("last").over(whole).alias("last_range"), edge.alias("opens"), F.sum(edge.cast("int")).over(order).cast("int").alias("b"),
    ).where(estimate(F.col("total")) > limit)
    within = Window.partitionBy("key", "block").orderBy("range_no")
    numbered = tables.withColumn("block", at).join(blocks, ["key", "block"])
    return numbered.select(
        *tables.columns, "total", "last_range", "b", (F.col("opens") & (F.col("range_no") % block == 0)).alias("edge"),
        (F.col("words_before") + F.sum("n").over(within) - F.col("n")).alias("first"),
    )


def cut_points(first: int, end: int, words: np.ndarray, classes: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Word numbers at which the words ``first``..``end`` are cut, so that no piece with its overlap exceeds ``limit``."""
    cuts, start = [], first
    room = limit if first == 0 else limit - overlap
    while end - start > room:
        lo, hi = np.searchsorted(words, [start + max(1, room // 2), start + room + 1])
        if hi > lo:
            best = classes[lo:hi].max()
            cut = int(words[lo:hi][classes[lo:hi] == best][-1]) if best > 0 else start + room
        else:
            cut = start + room
        cuts.append(cut)
        start, room = cut, limit - overlap
    return cuts


def plan_pieces(ranges: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK, tables: DataFrame | None = None) -> DataFrame:
    """(key, piece, word_start, word_end, range_from, range_to) of the texts over the limit.

    ``limit`` and ``overlap`` are estimated tokens. ``range_to`` is the range in
    which the word after the piece starts, or the text's last range. ``tables``
    are the ranges' ``boundary_tables``, if at hand.
    """
    most, shared = words_within(limit), words_within(overlap)
    if shared >= most:
        raise ValueError("the overlap must be smaller than the limit")
    rows = stitched(boundary_tables(ranges) if tables is None else tables, limit, shared, block).where("n > 0")
    b = F.col("b")
    # the range that begins a block also ends the one before
    blocks = rows.withColumn("b", F.explode(F.when(F.col("edge"), F.array(b - 1, b)).otherwise(F.array(b))))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("range_no")
        b, total, last = int(pdf["b"].iloc[0]), int(pdf["total"].iloc[0]), int(pdf["last_range"].iloc[0])
        no, first = pdf["range_no"].to_numpy(), pdf["first"].to_numpy(dtype=np.int64)
        words = np.concatenate([np.asarray(w, dtype=np.int64) + f for w, f in zip(pdf["word"], first)])
        classes = np.concatenate([np.asarray(c, dtype=np.int64) for c in pdf["cls"]])

        def edge_word(n: int) -> int:
            """Where the block that begins with range ``n`` begins: its best early boundary that leaves room for an overlap."""
            row = pdf[pdf["range_no"] == n].iloc[0]
            w, c = np.asarray(row["word"], dtype=np.int64), np.asarray(row["cls"])
            early = (w >= shared) & (w < shared + 512)
            if not early.any():
                return int(row["first"]) + max(0, min(int(row["n"]) - 1, shared))
            return int(row["first"]) + int(w[early][np.argmax(c[early])])

        edges = no[pdf["edge"].to_numpy()]
        start = edge_word(edges[0]) if b else 0
        end = edge_word(edges[-1]) if len(edges) > (b > 0) else total
        inside = (words > start) & (words < end)
        cuts = [start, *cut_points(start, end, words[inside], classes[inside], most, shared), end]
        rows = []
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                a = max(0, a - shared)
                # the ranges in which the first word and the one after the last start
                at = no[max(0, np.searchsorted(first, a, side="right") - 1)] if a else 0
                to = last if z == total else no[np.searchsorted(first, z, side="right") - 1]
                rows.append((pdf["key"].iloc[0], b, len(rows), a, z, int(at), int(to)))
        return pd.DataFrame(rows, columns=["key", "b", "i", "word_start", "word_end", "range_from", "range_to"])

    schema = T.StructType([T.StructField("key", ranges.schema["key"].dataType)] + [T.StructField(n, t) for n, t in (
        ("b", T.IntegerType()), ("i", T.IntegerType()), ("word_start", T.LongType()), ("word_end", T.LongType()), ("range_from", T.IntegerType()),
        ("range_to", T.IntegerType()))])
    pieces = checkpointed(blocks.groupBy("key", "b").applyInPandas(plan, schema))
    # numbered in two steps too: within the block, and by the pieces of the blocks before
    counts = pieces.groupBy("key", "b").agg(F.count("*").alias("n"))
    before = counts.select("key", "b", (F.sum("n").over(Window.partitionBy("key").orderBy("b")) - F.col("n")).alias("before"))
    number = (F.col("before") + F.col("i")).cast("int")
    return pieces.join(before, ["key", "b"]).select("key", number.alias("piece"), "word_start", "word_end", "range_from", "range_to")


def cut_pieces(ranges: DataFrame, plan: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(key, piece, word_start, word_end, text): the planned pieces with their texts.

    ``tables`` are the ranges' ``boundary_tables``, if at hand.
    """
    kind = ranges.schema["key"].dataType.simpleString()
    firsts = stitched((boundary_tables(ranges) if tables is None else tables).select("key", "range_no", "n"), 0).select("key", "range_no", "n", "first")
    wanted = plan.select("key", "piece", "word_start", "word_end", F.explode(F.sequence("range_from", "range_to")).alias("range_no"))
    parts = wanted.join(firsts, ["key", "range_no"]).join(ranges, ["key", "range_no"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                starts = word_starts(row.before or "", row.text)
                a, z = row.word_start - row.first, row.word_end - row.first
                begin = 0 if row.word_start == 0 or a < 0 else (starts[a] if a < row.n else len(row.text))
                end = starts[z] if 0 <= z < row.n else (0 if z < 0 else len(row.text))
                out.append(row.text[begin:end])
            yield batch[["key", "piece", "word_start", "word_end", "range_no"]].assign(part=out)

    schema = f"key {kind}, piece int, word_start long, word_end long, range_no int, part string"
    cuts = parts.select("key", "piece", "word_start", "word_end", "range_no", "n", "first", "before", "text").mapInPandas(cut, schema)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "part"))), lambda x: x["part"]), "")
    return cuts.groupBy("key", "piece", "word_start", "word_end").agg(joined.alias("text"))


def long_texts(df: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    """Texts that are long enough in characters to exceed ``limit`` at all (words have one character and a blank at least)."""
    return df.where(F.char_length(text) >= 2 * words_within(limit))


def over_limit(df: DataFrame, key: str, text: str, limit: int = LIMIT) -> DataFrame:
    """(key): the texts over ``limit``, by the stitched word counts of their ranges; null and empty texts are none."""
    counts = counted_words(text_ranges(long_texts(df, text, limit), key, text))
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where(estimate(F.col("n")) > limit).select("key")


def split_plan(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (without texts) of every text over ``limit``; texts within it, null and empty texts have none."""
    return plan_pieces(text_ranges(long_texts(df, text, limit), key, text), limit, overlap)


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, word_start, word_end, text) of every text over ``limit``. ``key`` must be unique."""
    ranges = text_ranges(long_texts(df, text, limit), key, text)
    tables = boundary_tables(ranges)
    return cut_pieces(ranges, plan_pieces(ranges, limit, overlap, tables=tables), tables).withColumnRenamed("key", key)
