"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strideflow.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=4):
    """The smallest id reachable, for each row."""
    known, of = np.unique(np.array(prints, np.uint64), return_inverse=True)
    label = np.arange(len(known))
    for k in range(len(known)):
        near = label[np.bitwise_count(known ^ known[k]) <= radius]
        label[np.isin(label, near)] = near.min()
    least = {}
    for k, i in zip(of, ids, strict=True):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return [least.get(label[k]) for k in of]


def check(rows, got):
    prints = [brute_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components(prints, [i for i, _ in rows]), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op12_simhash(spark, folder).collect())


def test_odd_rows_and_empty_table(spark):
    base = " ".join(f"w{k}" for k in range(200))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three"), (None, base), (7, base), (7, base), (8, base + " and more"), (None, "alone with no id"),
            (9, "Ünï — 中文 😀 x"), (10, "x" * 100_000), (3, "again under one id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, print int, node int")
    check(rows, simhash.simhash(docs).collect())
    assert simhash.simhash(docs.where("false")).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "Bc", "déf", " ", "\n", "  ", "\t"]) for _ in range(5000))
    want = brute_print(text)
    for size in (1, 7, 100, 10_000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == want


def near(rng, prints, n):
    for k in range(n):
        q = int(prints[k])
        for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            q ^= 1 << int(b)
        prints[n + k] = q
    return np.unique(prints)


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    prints = near(rng, rng.integers(0, 1 << 64, 1000, dtype=np.uint64), 200)
    query, word, bits = simhash.within(prints[:150], simhash.planes_of(prints), radius)
    got = {(int(q), int(w) * 64 + i) for q, w, b in zip(query, word, bits, strict=True) for i in range(64) if int(b) >> i & 1 and w * 64 + i < len(prints)}
    want = np.nonzero(np.bitwise_count(prints[:150, None] ^ prints[None, :]) <= radius)
    assert got == set(zip(want[0].tolist(), want[1].tolist(), strict=True))


@pytest.mark.parametrize("node,block", [(2, 4), (8, 16), (64, 10_000)])
def test_nodes_and_blocks_lose_no_link(spark, monkeypatch, node, block):
    monkeypatch.setattr(simhash, "NODE", node)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(node)
    spread = near(rng, rng.integers(0, 1 << 64, 500, dtype=np.uint64), 200)
    dense = np.uint64(12345) ^ np.array([sum(1 << int(b) for b in rng.choice(40, 3, replace=False)) for _ in range(200)], np.uint64)
    prints = np.unique(np.concatenate([spread, dense]))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    got = {(r.a, r.b) for r in simhash.links(table, len(prints)).collect()}
    signed = prints.view(np.int64).tolist()
    place = {p: k for k, p in enumerate(signed)}
    label = np.arange(len(prints))
    for a, b in got:
        assert int(np.bitwise_count(prints[place[a]] ^ prints[place[b]])) <= 4
        one, two = label[place[a]], label[place[b]]
        label[label == one] = two
    want = brute_components(prints.tolist(), list(range(len(prints))))
    assert len(set(label)) == len(set(want)) and all(len({want[k] for k in np.flatnonzero(label == x)}) == 1 for x in set(label))


def test_repeated_rows_without_ids_are_spread(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words again").alias("text"))
    got = simhash.simhash(docs.unionByName(spark.createDataFrame([(5, "the same few words again")], "doc_id long, text string")))
    assert {(r.component_id, r["count"]) for r in got.groupBy("component_id").count().collect()} == {(5, 3001)}
