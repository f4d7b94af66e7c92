"""Small brute-force and edge-case tests of the numbered operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from strideflow.llm import decontaminate, jpeg, language_id, licenses, line_crf, mixing, near_dup, queries, sharding, token_files, warc
from strideflow.llm.common import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, size int, node int, tokens string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a long text, columns of clashing names."""
    base = " ".join(words(80, 1))
    near = base.replace(base.split()[40], "changed")
    rows = [
        (1, base, "en", "a", 1, 1, "x"), (2, base, None, None, 1, 1, "x"), (3, near, "en", "b", 1, 1, "x"), (3, near, "en", "b", 1, 1, "x"),
        (4, None, "en", "a", 1, 1, None), (5, "", None, None, None, None, None), (None, "no id here at all really", "en", "a", 1, 1, "x"),
        (6, "two words", "en", "c", 1, 1, "x"), (7, "Two WORDS", "en", "c", 1, 1, "x"), (8, "\n\n \t", "en", "é", 1, 1, "x"),
        (9, " ".join(words(30_000, 2)), "en", "a", 1, 1, "x"), (10, "Ünï — 中文 \U0001f600 the MIT License!", "zz", "\U0001f600", 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_every_operator_takes_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (9, None), (1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "the mit license"), (None, "x y z a b c"), (2, None)], "item_id long, text string")
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    for run in (jpeg.media_round_trip, near_dup.near_duplicates, licenses.licenses, mixing.mix, mixing.mixed_documents, language_id.language, sharding.shard,
                lambda d: line_crf.quality(d, labels), lambda d: decontaminate.find_leaks(d, items), lambda d: token_files.token_files(d, path)):
        assert run(none).count() == 0
        assert run(odd).count() >= 0
    for run in (jpeg.media_round_trip, near_dup.near_duplicates, licenses.licenses, mixing.mix, language_id.language, sharding.shard):
        assert run(odd).count() == odd.count()


def test_media_round_trip(spark, odd):
    got = {(r.doc_id, r.payload_sha256) for r in jpeg.media_round_trip(odd).collect()}
    want = set()
    for r in odd.collect():
        raw = (r.text or "").encode()
        raw += b"\0" * (64 if not raw else -len(raw) % 64)
        want.add((r.doc_id, hashlib.sha256(raw).hexdigest()))
    assert got == want
    for r in jpeg.media_round_trip(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        padded = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        media = jpeg.encode_payloads(pa.array([raw], pa.binary()))[0]
        rgb = next(iter(jpeg.decode_files([media])))[3]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(padded), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.endswith(f"{zlib.crc32(rgb.tobytes()):08x}")
    pixels = jpeg.tensors(jpeg.store(odd.where("doc_id = 6"))).first()
    assert len(pixels.rgb) == pixels.height * pixels.width * 3


def test_jpeg_refuses_cut_files_and_keeps_hard_payloads():
    rng = random.Random(3)
    raw = [b"", b"\x80" * 700, bytes(rng.choice([127, 128, 129, 128, 128]) for _ in range(2000)), bytes(rng.randrange(256) for _ in range(3000))]
    files = jpeg.encode_payloads(pa.array(raw, pa.binary()))
    for k, frame, coef, rgb in jpeg.decode_files(files):
        n, payload = jpeg.payload_of(frame, coef)
        assert n == len(raw[k]) and payload[:n] == raw[k] and not any(payload[n:])
        assert rgb.shape == (frame.height, frame.width, 3)
    with pytest.raises(ValueError):
        list(jpeg.decode_files([files[2][:-200]]))
    with pytest.raises(ValueError):
        list(jpeg.decode_files([b"no image"]))


def test_inverse_transform_against_the_definition():
    rng = np.random.default_rng(5)
    coef = rng.integers(-60, 60, (64, 3))
    got = jpeg.samples(coef, np.full(64, 3))
    natural = np.zeros((3, 64))
    natural[:, jpeg.ZIGZAG] = coef.T * 3
    c = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    want = np.clip(np.einsum("ux,vy,nuv->nxy", c, c, natural.reshape(3, 8, 8)) + 128, 0, 255)
    assert np.abs(got - want).max() <= 1


def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= 75 * len(sets[a] | sets[b]) and i:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates_against_brute_force(spark, odd):
    rng, rows = random.Random(11), []
    for group in range(12):
        base = words(rng.randint(20, 120), group)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "yy", "zzz"])
            rows.append((len(rows) + 100, " ".join(copy)))
    rows += [(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_dense_blocks_find_what_full_sets_have(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_NODE", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base, rng = words(60, 7), random.Random(4)
    rows = []
    for k in range(30):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(60)] = f"edit{k}{rng.random()}"
        rows.append((k, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_a_doc_id_with_two_texts_links_by_each_of_them(spark):
    a, b = words(30, 21), words(30, 22)
    near = [*b[:15], "changed", *b[16:]]
    far = words(30, 23)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b[:29], "changed"])), (None, " ".join(far)), (None, " ".join(far)), (5, " ".join(far[:29] + ["q"])), (6, None), (6, None), (None, " ")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, check string, `group` long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).where("doc_id is not null").collect())
    assert got == [(1, 26, 1, True), (1, 26, 1, True), (2, 26, 1, False), (5, 26, 5, True), (6, 0, 6, True), (6, 0, 6, True)]
    assert near != b
    one = near_dup.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(((r.doc_id or 0), (r.text or "").strip()) for r in one.collect()) == sorted([(1, rows[0][1]), (1, rows[1][1]), (5, rows[5][1]), (6, ""), (0, "")])


def test_heavy_groups_are_spread_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HEAVY", 4)
    monkeypatch.setattr(near_dup, "SALTS", 3)
    rows = spark.createDataFrame([(k % 7 if k > 60 else 1, k) for k in range(100)], "node long, class long")
    nodes = rows.groupBy("node").agg(F.count("*").alias("n"))
    got = near_dup.spread_join(rows, nodes, ["node"], 100, "class")
    want = rows.join(nodes, "node")
    assert sorted(map(tuple, got.select("node", "class", "n").collect())) == sorted(map(tuple, want.select("node", "class", "n").collect()))
    with pytest.raises(ValueError):
        near_dup.trees_for(0.9999999)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in near_dup.connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_license_templates():
    scanner = licenses.Scanner({"a b": "ab"}, {"t": "begin <<beginOptional>>maybe <<var;match=.{0,2}>> so<<endOptional>> <<var;match=.{1,2}>> end"})
    texts = pa.array(["Begin x end", "begin maybe q so x y END a b a b", "begin end", "begin x y z end", "begin maybe p q r so x end", None])
    got = list(scanner.scan(texts))
    assert [g[2] for g in got] == [[(0, 3, "t")], [(0, 7, "t")], [], [], [], []]
    assert got[1][1] == [(7, "ab"), (9, "ab")] and got[5][0] == 0
    with pytest.raises(ValueError):
        licenses.Automaton("<<beginOptional>>x")


def ends_of(words, template, start):
    """Ends of all matches of a template from a place, by trying every way through it."""
    parts, stack = [], []
    here = parts
    for piece in re.split(r"(<<[^>]*>>)", template):
        if piece == "<<beginOptional>>":
            stack.append(here)
            here.append(["optional", []])
            here = here[-1][1]
        elif piece == "<<endOptional>>":
            here = stack.pop()
        elif piece.startswith("<<var"):
            low, high = map(int, re.search(r"\.\{(\d+),(\d+)\}", piece).groups())
            here.append(["any", low, high])
        else:
            here.extend(["word", w] for w in licenses.tokens(piece))

    def through(parts, places):
        for part in parts:
            if part[0] == "word":
                places = {p + 1 for p in places if p < len(words) and words[p] == part[1]}
            elif part[0] == "any":
                places = {p + k for p in places for k in range(part[1], part[2] + 1) if p + k <= len(words)}
            else:
                places = places | through(part[1], places)
        return places

    return through(parts, {start})


def test_license_digest_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet").select("doc_id", "text")
    planted = ["Copyright (c) 2020 A Person. Permission is hereby granted, free of charge, to any person obtaining a copy", "x " + re.sub(r"<<[^>]*>>", " ", licenses.TEMPLATES["mit-text"]).replace("Copyright c", "") + " y", None, "", "the mit license the mit license",
               "This program library is licensed under the GNU General Public License, version 3 or any later version. This a b c d is licensed under the GNU General Public License version 3"]
    docs = docs.unionByName(spark.createDataFrame([(-k, t) for k, t in enumerate(planted, 1)], "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.licenses(docs).collect()}
    firsts = {label: licenses.Automaton(t).first_words() for label, t in licenses.TEMPLATES.items()}
    some = 0
    for r in docs.collect():
        words, labels, covered, base = licenses.tokens(r.text or ""), set(), set(), []
        for phrase, label in licenses.PHRASES.items():
            own = licenses.tokens(phrase)
            for p in range(len(words) - len(own) + 1):
                if words[p : p + len(own)] == own:
                    base.append((p, label))
                    covered |= set(range(p, p + len(own)))
        for label, template in licenses.TEMPLATES.items():
            for p in [p for p, w in enumerate(words) if w in firsts[label]]:
                ends = ends_of(words, template, p) - {p}
                if ends:
                    labels.add(label)
                    covered |= set(range(p, max(ends)))
        g, bases = got[r.doc_id], {x for _, x in base}
        some += bool(labels)
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None))
        assert (g.base_labels, g.labels) == (",".join(sorted(bases)), ",".join(sorted(bases | labels))) and g.score == pytest.approx(len(covered) / len(words) if words else 0)
    assert some > 3


def test_license_digest(spark, odd):
    row = licenses.licenses(odd.where("doc_id = 10")).first()
    assert (row.n_base, row.first_word, row.last_word, row.base_labels) == (1, 4, 4, "mit") and 0 < row.score <= 1


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    weight, total = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True)), sum(size.values())
    target, free, left = {}, set(size), float(total)
    while True:  # share again until none is above its stop
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    source = {k: s for k, _, s in rows}
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 50 for s in size)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert mixing.mixed_documents(docs).count() == sum(r.taken // r.size if r.size else 1 for r in got)


def test_position_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5))
    for r in spark.range(0, 11).select(mixing.position(F.col("id") / 10.0, knots).alias("t"), (F.col("id") / 10.0).alias("f")).collect():
        times = np.linspace(0, r.t, 20001)
        assert np.trapezoid(np.interp(times, [0, 0.5, 1], [0.5, 0.5, 2.5]), times) == pytest.approx(r.f, abs=1e-6)


def test_crf_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=6), rng.normal(size=(2, 2))
    rows = np.array([0, 4, 4, 6])
    forward, back = line_crf.messages(unary, pair, rows)
    for a, b in ((0, 4), (4, 6)):
        total, good = 0.0, np.zeros(b - a)
        for bits in range(1 << (b - a)):
            y = [(bits >> k) & 1 for k in range(b - a)]
            p = np.exp(sum(unary[a + k] * y[k] for k in range(b - a)) + sum(pair[y[k], y[k + 1]] for k in range(b - a - 1)))
            total, good = total + p, good + p * np.array(y)
        assert 1 / (1 + np.exp(-(forward + back)[a:b])) == pytest.approx(good / total)


def test_crf_pairs_and_the_slope_of_the_documents_likelihood():
    rng = np.random.default_rng(2)
    unary, pair, rows = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 3, 5])
    inner = np.array([1, 2, 4])
    good, joint = line_crf._expected(unary, pair, rows, inner)
    for a, b in ((0, 3), (3, 5)):
        total, pairs = 0.0, np.zeros((2, 2, b - a - 1))
        for bits in range(1 << (b - a)):
            y = [(bits >> k) & 1 for k in range(b - a)]
            p = np.exp(sum(unary[a + k] * y[k] for k in range(b - a)) + sum(pair[y[k], y[k + 1]] for k in range(b - a - 1)))
            total += p
            for k in range(b - a - 1):
                pairs[y[k], y[k + 1], k] += p
        assert joint[:, (inner > a) & (inner < b)] == pytest.approx((pairs / total).reshape(4, -1))
    weight, step = np.array([0.5, 0.2, 0.3, 0.6, 0.4]), 1e-4  # the change under nudged weights is the slope of the mean marginal
    up, down = (line_crf._expected(unary + s * step * weight, pair, rows, inner)[0] for s in (1, -1))
    for k in range(5):
        moved = [weight @ line_crf._expected(unary + s * step * np.eye(5)[k], pair, rows, inner)[0] for s in (1, -1)]
        assert (up - down)[k] == pytest.approx(moved[0] - moved[1], rel=1e-4)


def test_mixed_documents_by_their_share_of_good_lines():
    """Only documents are labelled, by what most of their bytes are. Lines are told apart as far as that can: a line's features
    and its neighbours' explain a document's mean equally well."""
    rng = random.Random(12)

    def text(n):
        kinds = [rng.random() < 0.5 for _ in range(n)]
        lines = [" ".join(words(12, rng.random())).capitalize() + "." if good else "".join(rng.choice("$#%!@123 ") for _ in range(60)) for good in kinds]
        sizes = [len(x) * (1 if good else -1) for x, good in zip(lines, kinds, strict=True)]
        return "\n".join(lines), kinds, int(sum(sizes) > 0)

    learned, told = [text(6) for _ in range(300)], [text(7) for _ in range(60)]
    model = line_crf.fit(pa.array([t for t, _, _ in learned]), np.array([y for _, _, y in learned]))
    data, bounds = line_crf.buffer_of(pa.array([t for t, _, _ in told]))
    x, _, rows = line_crf.line_features(data, bounds)
    marginals, kinds = model.marginals(x, rows), np.array([k for _, kinds, _ in told for k in kinds])
    assert np.mean(marginals[kinds][:, None] > marginals[~kinds][None]) > 0.7
    assert np.mean((model.scores(data, bounds) > 0.5) == np.array([y for _, _, y in told])) > 0.8


def test_quality_on_held_out_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    rows = line_crf.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = language_id.language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert language_id.language(docs.withColumn("text", F.lit("12 34 !"))).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_kneser_ney_against_the_definition():
    corpora = {"aa": ["abracadabra abba cab", "a cab"], "bb": ["zebra razz", "bazaar"]}
    rows = []
    for x, texts in enumerate(corpora.values()):
        key, n = np.unique(language_id.grams(language_id.codes(texts)[0], language_id.ORDER)[0], return_counts=True)
        rows += [(x, k, c) for k, c in zip(key.tolist(), n.tolist(), strict=True)]
    lang, key, count = (np.array(c) for c in zip(*rows, strict=True))
    model = language_id.estimate(list(corpora), lang, np.full(len(lang), language_id.ORDER), key.astype(np.uint64), count)
    letters = set()
    counts = []  # per language: counts of n-grams by order, as tuples of characters
    for texts in corpora.values():
        own = {n: {} for n in range(1, 5)}
        for text in texts:
            line = [chr(language_id.START)] * 3 + list(text)
            for k in range(3, len(line)):
                gram = tuple(line[k - 3 : k + 1])
                own[4][gram] = own[4].get(gram, 0) + 1
        for n in (3, 2, 1):
            for gram in own[n + 1]:
                own[n][gram[1:]] = own[n].get(gram[1:], 0) + 1
        letters |= set(own[1])
        counts.append(own)

    def prob(own, gram):
        if not gram:
            return 1 / (len(letters) + 1)
        same = {g: c for g, c in own[len(gram)].items() if g[:-1] == gram[:-1]}
        if not same:
            return prob(own, gram[1:])
        whole = sum(same.values())
        return max(same.get(gram, 0) - language_id.DISCOUNT, 0) / whole + language_id.DISCOUNT * len(same) / whole * prob(own, gram[1:])

    for probe in ("abra", "zebr", "a ca", "qqqq", "abbz", "rz z"):
        packed = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(probe))], np.uint64)
        assert np.exp(model.log_prob(packed))[0] == pytest.approx([prob(own, tuple(probe)) for own in counts], rel=1e-4)
    for text in ("abba", "zebra", "cab razz"):
        line = chr(language_id.START) * 3 + text
        want = [-sum(np.log(prob(own, tuple(line[k - 3 : k + 1]))) for k in range(3, len(line))) / len(text) for own in counts]
        assert model.entropies([text])[0] == pytest.approx(want, rel=1e-4)


def test_kneser_ney_sums_to_one():
    text = "abracadabra abba cab"
    key, _ = language_id.grams(language_id.codes([text])[0], language_id.ORDER)
    key, n = np.unique(key, return_counts=True)
    model = language_id.estimate(["x"], np.zeros(len(key), int), np.full(len(key), language_id.ORDER), key, n)
    seen = sorted(set(text))
    for context in ("abr", "zzz", "a b"):
        probe = np.array([(ord(context[0]) << 48) | (ord(context[1]) << 32) | (ord(context[2]) << 16) | ord(c) for c in seen], np.uint64)
        total = np.exp(model.log_prob(probe)).sum()
        assert 0.85 < total < 1.0001  # the rest belongs to unseen characters


def test_warc_round_trip_and_checks(spark):
    long, other = "x" * 200, "é" * 120
    pages = [(3, "http://a/1", long), (1, "http://a/2", long), (2, None, long), (5, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", other), (None, "u", other), (1, "http://a/2", long)]
    got = warc.round_trip(spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string")).collect()
    want = {(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 1) if h == long and p != 1 else ("response", None))) for p, _, h in pages}
    assert {tuple(r) for r in got} == want and len(got) == len(pages)
    raw = warc.record("response", {"WARC-Record-ID": "<x>", "WARC-Date": warc.DATE}, b"body")
    assert warc.parse(raw)[1] == b"body"
    for bad in (raw[:-1], raw.replace(b"Content-Length: 4", b"Content-Length: 5"), raw.replace(b"WARC-Date", b"Other"), b"nothing"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_warc_reader_uses_a_compressed_dictionary(spark, tmp_path):
    samples = [f"<html>{k} common words in pages {k * 7}</html>".encode() * 4 for k in range(200)]
    dictionary = zstandard.train_dictionary(4096, samples)
    squeezed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    path = tmp_path / "a.warc.zst"
    path.write_bytes(warc.struct.pack("<II", warc.SKIPPABLE, len(squeezed)) + squeezed + packer.compress(samples[0]) + packer.compress(samples[1]))
    with path.open("rb") as file:
        assert list(warc.FrameReader(file, 16)) == samples[:2]
    path.write_bytes(path.read_bytes()[:-3])
    with path.open("rb") as file, pytest.raises(ValueError):
        list(warc.FrameReader(file))


def levenshtein(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64)
        edits, a, b = decontaminate.align(item, text)
        assert edits == levenshtein(item.tolist(), text.tolist())
        assert a <= b and edits >= abs(len(item) - (b - a))


def test_leaks_reach_the_target_recall(spark):
    rng = random.Random(8)
    items = [(k, " ".join(words(rng.randint(12, 60), 1000 + k))) for k in range(60)]
    rows, planted = [], set()
    for k in range(240):
        own = items[k % 60][1].split()
        for _ in range(max(1, len(own) // 15)):
            own[rng.randrange(len(own))] = rng.choice(["swapped", ""])
        rows.append((k, " ".join(words(40, k) + own + words(40, k + 5000))))
        planted.add((k, k % 60))
    rows += [(k, " ".join(words(200, 90_000 + k))) for k in range(300, 360)]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(pairs & planted) >= 0.95 * len(planted) and not {p for p in pairs if p[0] >= 300}


def edited(own, edits, kind, rng):
    """The words with this many edits at different places."""
    own = list(own)
    for k in sorted(rng.sample(range(len(own)), edits), reverse=True):
        own[k : k + 1] = {"swap": [f"other{k}"], "drop": [], "add": [f"more{k}", own[k]]}[kind]
    return own


def test_leaks_at_exactly_the_bound_by_length(spark):
    rng, items, rows = random.Random(3), {}, []
    for n in (5, 7, 8, 10, 16, 20, 30, 32, 40, 64):
        for k in range(20):
            items[n * 100 + k] = own = words(n, 3000 * n + k)
            for j, kind in enumerate(("swap", "drop", "add")):
                rows.append((10 * (n * 100 + k) + j, " ".join(words(30, 7 * k) + edited(own, n // 5, kind, rng) + words(30, 7 * k + 1))))
    benchmark = spark.createDataFrame([(i, " ".join(own)) for i, own in items.items()], "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {d for d, _ in rows} - {r.doc_id for r in got.collect() if r.item_id == r.doc_id // 10} == set()


def test_leaks_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        items = [[rng.choice("abcde") for _ in range(rng.randint(5, 24))] for _ in range(6)]
        texts = [[rng.choice("abcde") for _ in range(rng.randint(0, 60))] for _ in range(6)]
        for k, own in enumerate(items):
            texts[k][10:10] = edited(own, len(own) // 5, rng.choice(["swap", "drop", "add"]), rng)
        found = decontaminate.Items(list(range(6)), pa.array([" ".join(x) for x in items])).matches(pa.array([" ".join(x) for x in texts]))
        costs = {(r, k): levenshtein(own, t) for r, t in enumerate(texts) for k, own in enumerate(items)}
        assert {(row, item): edits for row, item, _, _, edits in found} == {p: c for p, c in costs.items() if c <= int(0.2 * len(items[p[1]]))}


def test_leaks_reach_the_target_recall_inside_the_whole_radius():
    rng, worst = random.Random(6), {}
    for n in (1, 2, 4, 5, 6, 8, 10, 15, 16, 20, 30, 32, 40, 48, 64):
        for share in (10, 20):
            own = [words(n, 70_000 + 100 * n + k + share) for k in range(25)]
            items = decontaminate.Items(list(range(25)), pa.array([" ".join(x) for x in own]))
            for kind in ("swap", "drop", "add", "mix", "spread"):
                texts = []
                for x in own:
                    k = n * share // 100
                    if kind == "spread":
                        copy = [f"other{j}" if j in {(e + 1) * n // (k + 1) for e in range(k)} else w for j, w in enumerate(x)]
                    else:
                        copy = edited(x, k, rng.choice(["swap", "drop", "add"]) if kind == "mix" else kind, rng)
                    texts += [" ".join(copy), " ".join(words(25, rng.random()) + copy + words(25, rng.random()))]
                found = {(row, item) for row, item, *_ in items.matches(pa.array(texts))}
                for j, place in enumerate(("alone", "in context")):
                    worst[n, share, kind, place] = sum((2 * k + j, k) in found for k in range(25)) / 25
    assert min(worst.values()) >= 0.92 and sum(worst.values()) / len(worst) >= 0.995, {k: v for k, v in worst.items() if v < 1}


def test_bands_need_a_reachable_recall():
    assert decontaminate.bands_for(16, 0.9) <= decontaminate.bands_for(16, 0.99) <= decontaminate.MOST_BANDS
    with pytest.raises(ValueError):
        decontaminate.bands_for(16, 0.9999, 0.8)


def test_short_items_and_scripts_without_spaces_leak(spark):
    poem = "床前明月光疑是地上霜举头望明月低头思故乡"
    items = spark.createDataFrame([(1, "Zebra"), (2, "blue zebra"), (3, "the mit license now"), (4, poem), (5, "ฉันรักแมวมาก"), (6, "。、 ?!")], "item_id long, text string")
    rows = [
        (1, "a blue\n ZEBRA ran"), (2, "zebras blue"), (3, "as the MIT license, now given"), (4, "the mit licence now"), (5, "他说：“" + poem[:10] + "，" + poem[10:] + "”。"),
        (6, "读" + poem.replace("上", "下") + "吧"), (7, "他们" + poem[:8]), (8, "วันนี้ฉันรักแมวมากจริง"), (9, "。"),
    ]
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, 0), (1, 2, 0), (3, 3, 0), (5, 4, 0), (6, 4, 1), (8, 5, 0)}


def test_cut_items_leak_at_both_ends_of_documents(spark):
    items = [(n, words(n, 500 + n)) for n in (5, 8, 16, 17, 32)]
    rows, planted = [], set()
    for n, own in items:
        for k, cut in enumerate((own[1:], own[:-1], own[: n // 2] + own[n // 2 + 1 :], own[n // 5 :], own[: n - n // 5])):
            for j, text in enumerate((cut, words(30, n + k) + cut, cut + words(30, n + k))):
                rows.append((n * 100 + k * 10 + j, " ".join(text)))
                planted.add((rows[-1][0], n))
    benchmark = spark.createDataFrame([(n, " ".join(own)) for n, own in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == planted


def test_leaks_in_blocks_equal_one_block(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(decontaminate.find_leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "blocks_of", lambda b, most=2000, f=decontaminate.blocks_of: f(b, most))
    assert sorted(decontaminate.find_leaks(docs, items).collect()) == whole


def test_shards_are_even_and_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    load, slots = [0] * 24, [[] for _ in range(24)]
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes"
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load) - min(load) <= max(r.size for r in rows) and {r.map_version for r in rows} == {2}
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_map_edits_move_little(spark, sf, tmp_path):
    rows = sharding.records(spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), 512)
    loads = sharding.slot_loads(rows, 512)
    old = sharding.slot_map(loads, 8)
    new = sharding.rebalance(old, loads, 9)
    folder = tmp_path.as_uri() + "/maps"
    sharding.save_map(old, folder)
    sharding.save_map(new, folder)
    before, after = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, folder, v).collect()} for v in (1, None))
    size = {r.virtual_slot: r.slot_bytes for r in loads.collect()}
    assert before.keys() == after.keys() == set(range(512)) and set(after.values()) == set(range(9))
    moved = sum(size[s] for s in size if before[s] != after[s])
    assert moved < 0.25 * sum(size.values())
    per = [sum(size[s] for s in size if after[s] == k) for k in range(9)]
    assert max(per) < 1.3 * min(per)


def test_perfect_hash_and_shards(tmp_path):
    keys = np.arange(1000, dtype=np.int64) ** 2
    h = token_files.hashes(keys, np.zeros(1000, np.int64))
    table = token_files.PerfectHash.from_bytes(token_files.PerfectHash.build(h).to_bytes())
    assert sorted(table.find(h).tolist()) == list(range(1000))
    uri, stream = token_files.open_new(tmp_path.as_uri(), ".ids")
    writer = token_files.ShardWriter(stream, 2)
    for k in (5, 5, 9):
        writer.add([k], np.arange(k + len(writer.keys), dtype=np.uint32), [k + len(writer.keys)])
    writer.close()
    with token_files.open_old(uri) as file:
        shard = token_files.Shard(file)
        offset, count, known = shard.locate(np.array([9, 5, 5, 77]), np.array([0, 0, 1, 0]))
        assert count[:3].tolist() == [11, 5, 6] and known.tolist() == [True, True, True, False]
        assert shard.ids(int(offset[0]), 11).tolist() == list(range(11))


def test_token_files_against_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    path = queries.public_tokenizers.path("word_bpe_49k.json")
    tokenizer, start = Tokenizer.from_file(path), 0
    got = sorted((r for r in token_files.token_files(odd, path).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10]
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_encoder_against_the_tokenizer_over_a_whole_table(sf, monkeypatch):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/../sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    texts = pa.concat_arrays([texts, pa.array([None, "", "\u00c9t\u00e9. \u0130STANBUL \u03a3\u03a3 a\u0301b! don't <|endoftext|> x1,y", "\u4e2d\u6587\uff0cb.", "ab." * 40, "A\u00a0b\u2003c\u0085d"])])
    encoder = token_files.Encoder(queries.public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.whole and encoder.direct
    want = [encoder._one(t or "") for t in texts.to_pylist()]
    for chunk, recent, most in ((1 << 20, 1 << 17, 1 << 20), (999, 50, 3000)):
        monkeypatch.setattr(token_files.Encoder, "CHUNK", chunk)
        monkeypatch.setattr(token_files.Encoder, "RECENT", recent)
        encoder.most = most
        encoder._forget()
        ids, counts = encoder.encode(texts)
        ends = np.cumsum(counts)
        assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == want
    monkeypatch.setattr(token_files, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))  # all collide
    ids, counts = encoder.encode(texts[:50])
    assert ids.tolist() == [i for x in want[:50] for i in x]


def test_stored_maps_are_edited_and_used(spark, sf, tmp_path):
    docs, folder = spark.read.parquet(f"{sf}/documents.parquet"), tmp_path.as_uri() + "/maps"
    sharding.save_map(sharding.first_map(spark, 6, 64), folder)
    one = {r.doc_id: r for r in sharding.shard(docs, 6, 64, folder).collect()}
    two = {r.doc_id: r for r in sharding.shard(docs, 8, 64, folder).collect()}
    assert {r.map_version for r in one.values()} == {2} and {r.map_version for r in two.values()} == {3}
    assert {r.shard for r in one.values()} == set(range(6)) and {r.shard for r in two.values()} == set(range(8))
    held = {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder, 3).collect()}
    assert all(held[r.virtual_slot] == r.shard and one[d].virtual_slot == r.virtual_slot for d, r in two.items())
    assert sum(one[d].size for d in one if one[d].shard != two[d].shard) < 0.5 * sum(r.size for r in one.values())


def test_every_stage_takes_odd_and_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline

    clash = "doc_id long, text string, lang string, source string, score double, _at int, check string, _row int, quality int, _id int"
    long, leak = " ".join(words(40, 5)) + ".", spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, long, "en", "a"), (1, long, "en", "a"), (None, long, None, None), (None, leak + " and more", "en", "a"), (4, None, None, None), (5, "", "en", ""), (None, None, None, None), (6, leak, "en", "b"),
            (7, long.replace(".", " more words."), "en", "b"), (8, " ".join(words(20_000, 9)), "en", "a")]
    docs = spark.createDataFrame([(*r, 0.5, 1, "c", 2, 1, 3) for r in rows], clash)
    for docs, some in ((docs, True), (docs.where("false"), False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "sharding" or out.columns == docs.columns
            got = [(r.doc_id, r.text) for r in out.collect()] if name != "sharding" else None
            if not some:
                assert out.count() == 0
            elif name == "near-duplicates":
                texts = [t for _, t in got]
                assert texts.count(long) == 1 and (1, long) in got and len(got) == 6  # 1; one of both leaks; 8; 4, 5 and None without words
            elif name == "decontamination":
                assert len(got) == 8 and not any(leak in (t or "") for _, t in got)
            elif name == "mixing":
                assert {t for _, t in got} <= {r[1] for r in rows}
            elif name == "sharding":
                assert out.count() == len(rows)


def test_pipeline_against_its_stages(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    parts = brute_components(rows)
    survivors = {d for d, (_, c) in parts.items() if c == d}
    leaked = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in out.collect()} <= survivors - leaked
    assert out.count() == mixing.mixed_documents(docs.where(docs.doc_id.isin(list(survivors - leaked)))).count()
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_copies_without_ids_belong_to_their_group(spark):
    text = " ".join(words(40, 21))
    rows = [(1, text), (None, text), (4, text), (None, "nothing like the others at all"), (None, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, True), (None, 1, False), (4, 1, False), (None, None, True), (None, None, True)], key=str)


def test_texts_without_a_letter_of_any_plane(spark):
    train = [(4 * k + 1, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 40)]
    odd = [(10_000, "\U0001f600\U0001f600 \U0001f680", None), (10_001, "\U0001d7d8\U0001d7d9", None), (10_002, "\U00010330\U00010331", None), (10_003, "12 !?", None), (10_004, "the \U0001f600 dog", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language(spark.createDataFrame(train + odd, "doc_id long, text string, lang string")).where("doc_id >= 10000").collect()}
    assert got[10_000] == got[10_001] == got[10_003] == ("und", 0.0)
    assert got[10_002][0] != "und" and got[10_004][0] == "en"


@pytest.mark.parametrize("few", [250_000, 0])
def test_archives_of_one_page_many_times(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_IDS", few)
    hot, long, rows = "<p>the same page " * 20, "<div>" + "long page " * 200_000, []
    rows += [(k, f"http://x/{k}", hot) for k in range(500)] + [(500 + k, None, t) for k, t in enumerate(["", None, "short", "short", long, long, "other " * 30])] + [(7, "again", hot), (None, "no id", hot), (501, "two", "other " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    first = {}
    for i, _, h in rows:
        if i is not None and len(h or "") >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        other = i is not None and len(raw) >= 100 and first[h] != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", first[h] if other else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0
