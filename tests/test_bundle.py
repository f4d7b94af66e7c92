"""Model bundles: kept whole, scored alike in batches and in stream state; parameter search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.functions import features as window
from strideflow.operators import boosting, bundle, decode, tuning
from strideflow.plans import catalog
from strideflow.sources.shared import new_path
from strideflow.streaming import live

P = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.4, "max_bins": 20, "min_child_weight": 0.1}
LABELS = ["walk", "run", "sit/lay", "stand"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for session in range(6):
        label = 0
        for seq in range(80):
            label = int(rng.integers(4)) if rng.random() < 0.2 else label
            out.append((session, seq, seq / 2.0, LABELS[label], float(label // 2 + rng.normal(0, 0.3)), float(label % 2 + rng.normal(0, 0.4)), None if seq % 9 == 0 else 1.0))
    return spark.createDataFrame(out, "session int, seq long, t double, activity string, a double, b double, c double")


@pytest.fixture(scope="module")
def fitted(rows):
    candidate = P | {"decoder_sticky_prior": 0.3, "decoder_cross_coarse_penalty": 0.5, "static_specialist_threshold": 0.3, "static_specialist_blend": 0.7}
    return tuning.fit_bundle(rows, ["a", "b", "c"], candidate, LABELS, ("sit/lay", "stand"))


def test_a_loaded_bundle_is_the_saved_one(spark, fitted):
    path = new_path(spark, "test")
    bundle.save(spark, fitted, path)
    back = bundle.load(spark, path, ["a", "b", "c"])
    x = np.random.default_rng(1).normal(size=(50, 3))
    assert np.array_equal(back.proba(x), fitted.proba(x)) and (back.labels, back.static.labels, back.decoder, back.init, back.trans) == (fitted.labels, fitted.static.labels, fitted.decoder, fitted.init, fitted.trans)


def test_broken_bundles_do_not_load(spark, fitted):
    path = new_path(spark, "test")
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, path)
    bundle.save(spark, fitted, path)
    with pytest.raises(ValueError, match="another order"):
        bundle.load(spark, path, ["b", "a", "c"])
    with pytest.raises(ValueError, match="other features"):
        bundle.load(spark, path, ["a", "b"])
    half = new_path(spark, "test")
    spark.read.parquet(f"{path}/trees").write.parquet(f"{half}/trees")
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, half)
    other = new_path(spark, "test")
    spark.read.parquet(f"{path}/about").write.parquet(f"{other}/about")
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, other)
    spark.read.parquet(f"{path}/trees").withColumn("tree", F.col("tree") + 1).write.parquet(f"{other}/trees")
    with pytest.raises(ValueError, match="not those"):
        bundle.load(spark, other)


def test_batch_inference_against_the_parts(spark, rows, fitted):
    got = {(r.session, r.seq): r for r in bundle.infer(fitted, rows.drop("activity")).collect()}
    base = boosting.predict(fitted.base, rows).withColumnRenamed("probs", "p").drop("predicted")
    both = boosting.predict(fitted.static, base).collect()
    assert len(got) == len(both) == 480
    columns = decode.refine_static({n: F.col("p")[k] for k, n in enumerate(LABELS)}, {n: F.col("probs")[k] for k, n in enumerate(fitted.static.labels)}, fitted.gate, fitted.blend)
    refined = {(r.session, r.seq): r.q for r in boosting.predict(fitted.static, base).select("session", "seq", F.array(*columns.values()).alias("q")).collect()}
    for session in range(6):
        prior = np.array(fitted.init)
        for seq in range(80):
            r = got[session, seq]
            assert np.allclose(r.probs, refined[session, seq], atol=1e-9) and r.raw == LABELS[int(np.argmax(r.probs))]
            new = prior * np.array(r.probs)
            new /= new.sum()
            assert r.decoded == LABELS[int(new.argmax())]
            prior = new @ np.array(fitted.trans)
    one = bundle.Bundle(fitted.base)
    assert bundle.infer(one, rows).where("raw <> decoded").isEmpty()
    with pytest.raises(ValueError):
        bundle.infer(bundle.Bundle(fitted.base, decoder="viterbi"), rows)


def test_stream_state_scores_what_batches_score(spark):
    rng = np.random.default_rng(3)
    t = np.arange(live.POINTS) * live.WINDOW_SECONDS / live.POINTS
    acc = np.stack([np.stack([np.sin(2 * np.pi * (0.5 + k % 3) * t + a) * (0.2 + k % 4) + (9.8 if a == 2 else 0) + rng.normal(0, 0.05, len(t)) for a in range(3)], axis=1) for k in range(60)])
    labels = [("walk", "run", "stand", "sit/lay")[k % 4] for k in range(60)]
    table = spark.createDataFrame([(k, labels[k], *[acc[k, :, a].tolist() for a in range(3)]) for k in range(60)], "window int, activity string, x array<double>, y array<double>, z array<double>")
    found = window.window_features(table, ("window", "activity"))
    fitted = bundle.Bundle(boosting.fit(found, window.NAMES, params=P | {"n_estimators": 2, "max_bins": 8}))
    batch = np.array([r.probs for r in boosting.predict(fitted, found).orderBy("window").collect()])
    emit = fitted.emission()
    assert np.array_equal(np.array(emit(window.compute(acc))), batch)
    assert np.allclose(np.concatenate([emit(window.compute(acc[k : k + 1])) for k in range(60)]), batch, atol=1e-12)
    scorer, state = live.Scorer(tuple(fitted.labels), emit, decoder="none"), live.Session()
    ns = (np.arange(6 * live.POINTS) * live.WINDOW_SECONDS / live.POINTS * 1e9).astype(np.int64)
    points = np.concatenate([acc[k] for k in (0, 4, 8, 12, 16, 20)])
    out = scorer.messages(state, "s", [(m, ns[m * 64 : m * 64 + 64], points[m * 64 : m * 64 + 64]) for m in range(len(ns) // 64)])
    scored = [r for r in out if r["status"] == "success"]
    assert scored and all(r["label"] in fitted.labels and abs(sum(r["posterior"]) - 1) < 1e-9 for r in scored)


def test_registered_queries(spark, sf):
    got = catalog.QUERIES["bundle_scores"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").count() and got.where("raw is null or decoded is null or not p between 0 and 1").isEmpty()
    cells = catalog.QUERIES["boosted_confusion"](spark, sf)
    assert cells.agg(F.sum("n")).first()[0] > 0


# --- parameter search --------------------------------------------------------------------------------------

SPACE = {"x": tuning.Span(-5, 5), "n": tuning.Span(10, 100, 10), "rate": tuning.Span(0.001, 1.0, log=True), "kind": tuning.Choice(("a", "b", "c"))}


def surface(p):
    return -((p["x"] - 2) ** 2) - abs(p["n"] - 70) / 20 - (math.log10(p["rate"]) + 2) ** 2 + {"a": 0, "b": 1, "c": -1}[p["kind"]]


def test_search_repeats_itself_and_beats_chance():
    once, again = (tuning.bayesian_search(SPACE, surface, 60, seed) for seed in (42, 42))
    assert once == again
    wins = 0
    for seed in range(12):
        rng = np.random.default_rng(1000 + seed)
        chance = max(surface({n: of.draw(rng) for n, of in SPACE.items()}) for _ in range(60))
        wins += tuning.best_trial(tuning.bayesian_search(SPACE, surface, 60, seed))[0] >= chance
    assert wins >= 10
    for _, p in once:
        assert -5 <= p["x"] <= 5 and p["n"] in range(10, 101, 10) and isinstance(p["n"], int) and 0.001 <= p["rate"] <= 1 and p["kind"] in "abc"


@pytest.mark.parametrize("name,values", [("x", [1.0, 1.5, -4.0]), ("rate", [0.01, 0.02]), ("n", [20, 20, 90]), ("kind", ["a", "a", "c"]), ("x", [])])
def test_densities_sum_to_one(name, values):
    of, d = SPACE[name], tuning.Parzen(SPACE[name], values)
    if isinstance(of, tuning.Choice):
        assert math.isclose(sum(math.exp(d.log(v)) for v in of.values), 1) and d.log("a") >= d.log("b")
    elif of.step:
        assert math.isclose(sum(math.exp(d.log(v)) for v in range(10, 101, 10)), 1, rel_tol=1e-6)
    else:
        low, high = of.ends()
        grid = np.linspace(low, high, 20_001)
        mass = np.array([math.exp(d.log(math.exp(g) if of.log else g)) for g in grid])
        assert math.isclose(float(np.trapezoid(mass, grid)), 1, rel_tol=1e-3)


def test_the_proposal_is_the_best_ratio_of_densities():
    trials = tuning.bayesian_search(SPACE, surface, 25)
    good, bad = tuning.good_trials(trials)
    assert len(good) == 3 and min(surface(p) for p in good) >= max(surface(p) for p in bad)
    got = tuning.propose(SPACE, trials, np.random.default_rng(7))
    rng = np.random.default_rng(7)
    for name, of in SPACE.items():
        one, two = (tuning.Parzen(of, [p[name] for p in part]) for part in (good, bad))
        drawn = [one.draw(rng) for _ in range(tuning.PROPOSALS)]
        assert got[name] == max(drawn, key=lambda v: one.log(v) - two.log(v))


def test_candidates_are_scored_as_they_are_used(rows):
    space = {"max_depth": tuning.Choice((1, 2)), "decoder_sticky_prior": tuning.Span(0.0, 0.3), "static_specialist_blend": tuning.Choice((0.3, 0.8))}
    fit, tune = rows.where("session < 4"), rows.where("session >= 4")

    def score(candidate):
        return tuning.evaluate(tuning.fit_bundle(fit, ["a", "b"], P | candidate | {"n_estimators": 1}, LABELS, ("sit/lay", "stand")), tune)

    trials = tuning.bayesian_search(space, score, 2)
    assert len(trials) == 2 and all(0.3 < s <= 1 for s, _ in trials)
    best = tuning.fit_bundle(fit, ["a", "b"], P | {"n_estimators": 1}, LABELS)
    assert 0.3 < tuning.evaluate(best, tune, "accuracy") <= 1
    with pytest.raises(ValueError):
        tuning.evaluate(best, tune, "loss")
