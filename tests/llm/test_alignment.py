"""Alignment of two tokenizers against the definition, text by text."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from strideflow.llm import alignment, queries

A, B = (queries.public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, coders):
    a, b = coders
    shown = alignment.byte_level_bytes()
    made, total = [], Counter()
    for doc_id, text in rows:
        groups, links, n_a, n_b = [], [], 0, 0
        if text:
            one = a.encode(" " + text, add_special_tokens=False)
            two, ids = b.encode(text), one.ids
            raw_a = [bytes(shown[c] for c in t) for t in one.tokens]
            raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                n_a, n_b, i, j, p, q, at_i, at_j = len(ids), len(two), 0, 0, 0, 0, 0, 0
                while i < n_a or j < n_b:
                    if at_i <= at_j:
                        at_i += len(raw_a[i])
                        i += 1
                    else:
                        at_j += len(raw_b[j])
                        j += 1
                    if at_i == at_j:
                        groups.append(",".join(map(str, ids[p:i])) + "|" + ",".join(map(str, two[q:j])))
                        links.append((ids[i - 1], two[j - 1]))
                        p, q = i, j
        total.update(links)
        made.append((doc_id, n_a, n_b, groups, links))
    most = defaultdict(int)
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    return sorted(((d, x, y, len(g), len(ls), sum(total[k] == most[k[1]] for k in ls), sum(total[k] for k in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, ls in made), key=str)


def check(got, rows, coders):
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == brute(rows, coders)


def test_whole_small_table(spark, coders):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op13_alignment(spark, folder).collect(), rows, coders)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    parts = ["word", "Étage", "été", "it's", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "▁", "中文字", "😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "12", "3.5", "...", "\x00", "́", "ﬁ", "é", "​", "﻿", "ك", "한국", "a", "I'll", "\x7f", "½", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += [f"{x} a {y}" for x in parts for y in parts[:20]] + [f"a{x}\n{y}b" for x in parts for y in parts[:20]]
    return [None, "", " ", "\n", "▁", "a", "a" * 20_000, "one two " * 20_000, *texts]


@pytest.mark.parametrize("sent", [1_000_000, 10])
def test_odd_texts(spark, coders, odd_texts, monkeypatch, sent):
    monkeypatch.setattr(alignment, "SENT", sent)
    rows = [(k, t) for k, t in enumerate(odd_texts)] + [(3, "one two three"), (3, "one two three"), (None, "one two three"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, first string")
    check(alignment.alignment(docs, A, B).collect(), rows, coders)
    assert alignment.alignment(docs.where("false"), A, B).count() == 0


def test_chunks_and_memory_change_nothing(odd_texts, monkeypatch):
    texts = [t.encode() for t in odd_texts if t]
    whole = alignment.Vocabularies.load(A, B)
    whole.at = b""
    want = [(a, b, g, x.tolist()) for a, b, g, x in alignment.Learner(whole).measures(texts)]
    for remembered, together in ((400_000, 1 << 17), (3, 10)):
        monkeypatch.setattr(alignment, "REMEMBERED", remembered)
        monkeypatch.setattr(alignment, "TOGETHER", together)
        learner = alignment.Learner(alignment.Vocabularies.load(A, B))
        assert learner.v.at == b" \n"
        got = [m for k in range(0, len(texts), 50) for m in learner.measures(texts[k : k + 50])]
        assert [(a, b, g, x.tolist()) for a, b, g, x in got] == want
