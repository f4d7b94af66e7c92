"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strideflow.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_near(counts):
    """Words that share a form with one letter wiped out or taken away are candidates; each is then checked."""
    by, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :]].add(w)
        by[w].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def brute(rows):
    counts = brute_counts(rows)
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def check(rows, got):
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == brute(rows)


@pytest.mark.parametrize("sizes", [None, (64, 32, 96, 8)])
def test_whole_small_table(spark, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("LEAF", "POINTS", "ASKING", "TWIG"), sizes, strict=True):
            monkeypatch.setattr(spelling, name, value)
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op11_spelling(spark, folder).collect())


def test_odd_rows_chains_and_empty_table(spark):
    rng = random.Random(4)
    words = ["aaaaaa", "aaaaab", "abcdef", "abcdeg", "abcde", "Étranger", "étranger", "b" * 5000, "b" * 5001, "abcdef×", "straße", "ABCDEF"]
    rows = [(1, None), (2, ""), (None, "abcdef " * 7), (3, "12 ,, !"), (3, "abcdef,abcdef")]
    for w, n in zip(words, (5, 30, 200, 40, 900, 5, 26, 6, 31, 8, 5, 5), strict=True):
        rows.append((100 + rng.randrange(100), f" {w}" * n))
    for k, n in enumerate((5, 25, 125, 625, 3125)):  # a chain of forms
        rows.append((50 + k, f"{'chain' + 'xyzvw'[: k + 1]}\n" * n))
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    check(rows, spelling.variants(docs).collect())
    assert spelling.variants(docs.where("false")).count() == 0
    assert spelling.variants(docs.where("doc_id = 2")).count() == 0


def test_every_occurrence_may_lose_a_letter(spark):
    run = "abcdefgh"
    ids = [i for i in range(60_000) if zlib.crc32(f"{i}:{run}".encode()) % 199 == 0][:40]
    rows = [(i, run.upper()) for i in ids for _ in range(5)]
    check(rows, spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(brute_counts(rows)) > 2


def test_boxes_lose_no_pair():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.choice([6, 7]))) for _ in range(700)})
    code, bounds = spelling.letters(pa.array(words))
    counts, lengths = spelling.letter_counts(code, bounds), np.diff(bounds)
    for length, longer, up in ((6, 0, 1), (6, 1, 0), (7, 0, 1)):
        p, q = np.flatnonzero(lengths == length), np.flatnonzero(lengths == length + longer)
        change = counts[q][:, None, :] - counts[p][None, :, :]
        want = set(zip(*map(np.ndarray.tolist, np.nonzero((np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= up))), strict=True))
        for twig in (1, 5, 10_000):
            a, b = spelling.within_boxes(counts[p], counts[q], up, twig)
            assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)
