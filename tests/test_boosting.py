"""Boosted trees against a plain exact search, and what they reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideflow.operators import boosting, training

SMALL = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0, "max_bins": 250, "min_child_weight": 0.5}


def table(spark, n, seed, holes=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = np.where(x[:, 0] * x[:, 1] > 0.2, "run", np.where(x[:, 2] > 0.5, "walk", "stand"))
    x[rng.random(x.shape) < holes] = np.nan
    w = np.round(rng.uniform(0.5, 2, n), 1)
    rows = [(*[None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)], a, float(b)) for r, a, b in zip(x, y.tolist(), w, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, activity string, weight double"), x, y, w


def brute(x, y, w, labels, p):
    """Trees by trying every value of every feature in every node."""
    margins, trees = np.zeros((len(x), len(labels))), []
    score = lambda g, h: max(abs(g) - p["reg_alpha"], 0) ** 2 / (h + p["reg_lambda"])
    leaf = lambda g, h: -np.sign(g) * max(abs(g) - p["reg_alpha"], 0) / (h + p["reg_lambda"]) * p["learning_rate"]
    for _ in range(p["n_estimators"]):
        probs, new = boosting.softmax(margins), margins.copy()
        for k, name in enumerate(labels):
            g, h = (probs[:, k] - (y == name)) * w, np.maximum(2 * probs[:, k] * (1 - probs[:, k]), 1e-16) * w
            tree = {}

            def grow(rows, place, depth):
                G, H, best = g[rows].sum(), h[rows].sum(), None
                if depth < p["max_depth"]:
                    for f in range(x.shape[1]):
                        v = x[rows, f]
                        for cut in np.unique(v[~np.isnan(v)]):
                            for missing in (True, False):
                                left = np.where(np.isnan(v), missing, v <= cut)
                                gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                                gain = score(gl, hl) + score(G - gl, H - hl) - score(G, H)
                                if min(hl, H - hl) >= p["min_child_weight"] and gain > max(p["gamma"], 1e-9) and (best is None or gain > best[0] + 1e-6):
                                    best = (gain, f, cut, left)
                if best is None:
                    new[rows, k] += leaf(G, H)
                    tree[place] = leaf(G, H)
                    return
                tree[place] = best[1:3]
                grow(rows[best[3]], 2 * place + 1, depth + 1)
                grow(rows[~best[3]], 2 * place + 2, depth + 1)

            grow(np.arange(len(x)), 0, 0)
            trees.append(tree)
        margins = new
    return trees, margins


@pytest.mark.parametrize("more", [{}, {"gamma": 2.0, "reg_alpha": 0.5, "reg_lambda": 3.0}])
def test_every_split_against_brute_force(spark, more, monkeypatch):
    monkeypatch.setattr(boosting, "STORED", 2)
    p = boosting.BASE | SMALL | more
    rows, x, y, w = table(spark, 150, 1)
    model = boosting.fit(rows, ["a", "b", "c"], weight="weight", params=p)
    assert model.labels == ["run", "stand", "walk"]
    trees, margins = brute(x, y, w, model.labels, p)
    for t, tree in enumerate(trees):
        for place, want in tree.items():
            if isinstance(want, tuple):
                assert model.feature[t, place] == want[0]
                assert abs(model.threshold[t, place] - want[1]) < 1e-9
            else:
                assert model.feature[t, place] == -1 and abs(model.value[t, place] - want) < 1e-5
    assert np.allclose(model.margins(x), margins, atol=1e-4)


def test_partitions_change_nothing_and_rows_are_sampled(spark):
    rows, x, *_ = table(spark, 400, 2)
    p = SMALL | {"subsample": 0.7, "colsample_bytree": 0.67, "max_bins": 16}
    one, many = (boosting.fit(rows.coalesce(1), ["a", "b", "c"], params=p), boosting.fit(rows.coalesce(1), ["a", "b", "c"], params=p))
    assert np.array_equal(one.feature, many.feature) and np.array_equal(one.value, many.value)
    full = p | {"subsample": 1.0}
    one, many = (boosting.fit(r, ["a", "b", "c"], params=full) for r in (rows.coalesce(1), rows.repartition(7, "a")))
    assert np.array_equal(one.feature, many.feature) and np.allclose(one.value, many.value, atol=1e-9) and np.allclose(one.proba(x).sum(axis=1), 1)
    assert (one.feature >= 0).any()


def test_it_beats_the_forest_where_features_interact(spark):
    rows, *_ = table(spark, 3000, 3, holes=0.0)
    split = training.tuning_split(rows.withColumn("id", F.monotonically_increasing_id()), "id")
    fit, tune = split.where("part = 'fit'"), split.where("part = 'tune'")
    boosted = training.macro_f1(boosting.predict(boosting.fit(fit, ["a", "b", "c"], params={"n_estimators": 12, "max_depth": 4, "learning_rate": 0.3}), tune))
    forest = training.macro_f1(training.predict(training.fit_forest(fit, ["a", "b", "c"], params={"numTrees": 20, "maxDepth": 4}), tune))
    assert boosted >= forest and boosted > 0.9


def test_odd_rows(spark):
    schema = "a double, activity string, weight double"
    rows = spark.createDataFrame([(1.0, "x", 1.0), (None, "y", 1.0), (float("nan"), "y", 2.0), (2.0, None, 1.0), (3.0, "z", None), (1.0, "x", 1.0)], schema)
    model = boosting.fit(rows, ["a"], weight="weight", params=SMALL | {"min_child_weight": 0.1}, labels=["y", "x"])
    got = {r.a: r.predicted for r in boosting.predict(model, spark.createDataFrame([(1.0, 5), (None, 6)], "a double, n int")).collect()}
    assert got == {1.0: "x", None: "y"}
    with pytest.raises(ValueError):
        boosting.fit(rows.where("false"), ["a"])
    with pytest.raises(ValueError):
        boosting.fit(rows, ["a"], params={"trees": 3})
