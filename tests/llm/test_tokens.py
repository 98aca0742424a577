import base64
import os
import random

import pytest

from quern.llm import packing, tokens

FILE = os.path.join(tokens.TOKENIZERS, tokens.BYTE_BPE_50K)
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(public):
    rnd = random.Random(1)
    texts = ["a" * n for n in range(1, 40)] + ["x" * 3000, " " * 2000, "é" * 900, "<|endoftext|> it's", "", None, "\n\t  \n"]
    texts += ["".join(rnd.choice("aab é₹न्🚚\n\t  0'.") for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    bpe = tokens.ByteBPE(FILE)
    got = []
    for a, b in tokens.text_slices(texts, 2000):
        ids, count = bpe.encode_texts(texts[a:b])
        at = 0
        for n in count:
            got.append(ids[at : at + n].tolist())
            at += n
    assert got == [public.encode_ordinary(t) if t else [] for t in texts]


def test_encode_and_count(spark, public, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, None), (-3, "   "), (-4, "z" * 300_000)], "doc_id long, text string")
    every = docs.unionByName(extra).withColumnRenamed("text", "body").selectExpr("*", "'clash' AS ids", "1 AS n_tokens")
    texts = {r["doc_id"]: r["body"] for r in every.collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(every, "doc_id", "body").collect()}
    assert got.keys() == texts.keys() and all(got[k] == (public.encode_ordinary(t) if t else []) for k, t in texts.items() if k != -4)
    assert public.decode(got[-4]) == texts[-4]
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(every, "doc_id", "body").collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode(every.limit(0), "doc_id", "body").isEmpty()


def check_packing(items, placed, capacity):
    pieces, used = {}, {}
    for r in placed:
        pieces.setdefault(r["id"], []).append((r["piece"], r["token_start"], r["size"]))
        if r["size"]:
            used.setdefault(r["container_id"], []).append((r["container_offset"], r["size"]))
    assert pieces.keys() == items.keys()
    for k, n in items.items():
        own, at = sorted(pieces[k]), 0
        assert len(own) == max(1, -(-(n or 0) // capacity))
        for i, (piece, start, size) in enumerate(own):
            assert (piece, start) == (i, at)
            at += size
        assert at == (n or 0)
    for slots in used.values():
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
        assert at <= capacity
    assert set(used) == set(range(len(used)))
    return len(used)


@pytest.mark.parametrize("capacity, sizes", [
    (2048, lambda r: int(r.lognormvariate(5.3, 1.2))), (64, lambda r: r.choice([0, 33, 33, 31, 200, 1])), (100, lambda r: 60), (10, lambda r: r.choice([None, 0])),
])
def test_packing(spark, capacity, sizes):
    rnd = random.Random(5)
    items = {i: sizes(rnd) for i in range(3000)}
    df = spark.createDataFrame(list(items.items()), "id long, n long").selectExpr("*", "1 AS size", "2 AS piece", "3 AS container_id")
    placed = packing.pack(df, "id", "n", capacity).collect()
    used = check_packing(items, placed, capacity)
    total = sum(n or 0 for n in items.values())
    if capacity == 2048:
        assert used <= 1.002 * -(-total // capacity) + 1
    again = packing.pack(df.repartition(7), "id", "n", capacity).collect()
    assert sorted(map(tuple, placed)) == sorted(map(tuple, again))


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "id long, n long"), "id", "n").isEmpty()
