import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import splitting


def check(pieces, texts, limit=2048, overlap=128):
    """Every piece within the limit and the texts given back; the keys found."""
    by = {}
    for p in pieces:
        by.setdefault(p["key"], []).append(p)
    for key, own in by.items():
        own.sort(key=lambda p: p["piece"])
        text, out, end = texts[key], "", 0
        starts = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
        for p in own:
            n = len(p["text"].split())
            assert n == p["word_end"] - p["word_start"] and n * 13 // 10 <= limit
            shared = end - p["word_start"]
            assert (shared * 13 // 10 <= overlap and shared >= 0) if p["piece"] else p["word_start"] == 0
            out += p["text"][starts[end] - starts[p["word_start"]] :] if p["piece"] else p["text"]
            end = p["word_end"]
        assert out == text
    return set(by)


def texts(seed):
    rnd = random.Random(seed)
    out = {}
    for i in range(12):
        size, parts, n = rnd.choice([500, 1700, 4000]), [], 0
        while n < size:
            giant = rnd.random() < 0.003
            parts.append(("w" * 3000 if giant else "ab" * rnd.randint(1, 4)) + rnd.choice([" ", "  ", "\n", ". ", "\n\n", ", ", "\r\n", " " * 90, "। "]))
            n += 1
        out[i] = rnd.choice(["", "  ", "\n"]) + "".join(parts)
    return out | {100: "", 101: None, 102: "x" * 50_000, 103: " " * 50_000, 104: "a " * 1576, 105: "a " * 1577}


@pytest.mark.parametrize("size, block", [(32_768, 64), (500, 4), (97, 3)])
def test_round_trip(spark, size, block):
    t = texts(size)
    df = spark.createDataFrame(list(t.items()), "id long, body string").withColumn("key", F.lit("clash")).withColumn("text", F.lit("clash"))
    ranges = splitting.text_ranges(splitting.long_texts(df, "body"), "id", "body", size)
    pieces = splitting.cut_pieces(ranges, splitting.plan_pieces(ranges, block=block)).collect()
    assert check(pieces, t) == {k for k, v in t.items() if v and len(v.split()) >= 1577}


def test_natural_boundaries_and_overlap(spark):
    t = {1: "\n\n".join("w " * 99 + "end." for _ in range(40))}
    df = spark.createDataFrame(list(t.items()), "id long, body string")
    plan = sorted(splitting.split_plan(df, "id", "body").collect(), key=lambda r: r["piece"])
    assert len(plan) > 2 and all(r["word_end"] % 100 == 0 for r in plan)
    assert all(a["word_end"] - b["word_start"] == 99 for a, b in zip(plan, plan[1:]))
    assert check([r.asDict() | {"key": r["id"]} for r in splitting.split_texts(df, "id", "body").collect()], t) == {1}


def test_empty(spark):
    assert splitting.split_texts(spark.createDataFrame([], "id long, body string"), "id", "body").isEmpty()


def test_boundary_class():
    assert [splitting.boundary_class(g) for g in ("a.\n\n", "a\n", "a. ", "a.” ", "a, ", "a ", "", "क। ")] == [4, 3, 2, 2, 1, 0, 0, 2]


def test_files_are_read_by_ranges(spark, tmp_path):
    body = "".join(f"wörd{i} é₹🚚 " + ("\n\n" if i % 37 == 0 else "") for i in range(3000))
    path = tmp_path / "a.txt"
    path.write_bytes(body.encode())
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, length long")
    ranges = splitting.file_ranges(spark, files, 1000)
    assert "".join(r["text"] for r in ranges.orderBy("range_no").collect()) == body
    pieces = splitting.cut_pieces(ranges, splitting.plan_pieces(ranges, block=16)).collect()
    assert check(pieces, {str(path): body}) == {str(path)}


def test_counts_agree_with_the_boundary_tables(spark):
    odd = "a b c\x1cd\x85e　f​g " * 40 + "w" * 500 + "\n\n  " + "🚚 x" * 60
    df = spark.createDataFrame([(i, odd[i:]) for i in range(6)], "id long, body string")
    for size in (1, 7, 50, 4000):
        ranges = splitting.text_ranges(df, "id", "body", size)
        ours = {(r["key"], r["range_no"]): r["n"] for r in splitting.counted_words(ranges).collect()}
        assert ours == {(r["key"], r["range_no"]): r["n"] for r in splitting.boundary_tables(ranges).collect()}
        for i in range(6):
            assert sum(n for (k, _), n in ours.items() if k == i) == len(odd[i:].split())


def test_over_limit(spark):
    t = texts(7)
    df = spark.createDataFrame(list(t.items()), "id long, body string")
    assert {r["key"] for r in splitting.over_limit(df, "id", "body").collect()} == {k for k, v in t.items() if v and len(v.split()) >= 1577}
