"""Queries against what their contracts say, in plain Python."""

import re

from strideflow.llm import queries

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(found)) if found[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_op3_takes_the_phrases_of_its_contract(spark, tmp_path):
    texts = ["Released under the MIT License.", "see the MIT license", "x\nUNDER-the_mit\x00license under the mit license", "under the mit license", "cc by nc, the Apache License, Version 2.0; CC BY-NC",
             "under", "license under the mit", "", None, " .. "]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_licenses(spark, str(tmp_path)).collect()
    order = lambda r: (r[0] is None, r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=order) == sorted([(k, *base(t)) for k, t in rows], key=order)
    assert [r.first_word for r in got if r.doc_id == 1] == [None]
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_op3_over_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op3_licenses(spark, f"{sf}/../sf0.01").collect()}
    assert got == {r.doc_id: base(r.text) for r in docs} and sum("mit" in x[4] for x in got.values()) > 3
