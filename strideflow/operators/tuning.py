"""Parameter search by a tree-structured Parzen estimator, and the evaluation of a candidate as it would be used.

Trials are scored one after another; each score is a distributed fit. The estimator itself only sees the trials' parameters and
scores: a handful of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.operators import boosting, evaluation
from strideflow.operators.bundle import Bundle, infer
from strideflow.operators.training import macro_f1

STARTUP, PROPOSALS, SEED = 10, 24, 42


@dataclass(frozen=True)
class Choice:
    """One of these values, without an order."""

    values: tuple

    def draw(self, rng: np.random.Generator):
        return self.values[int(rng.integers(len(self.values)))]


@dataclass(frozen=True)
class Span:
    """A number between two others, whole in steps, or on a logarithmic scale."""

    low: float
    high: float
    step: float = 0.0
    log: bool = False

    def draw(self, rng: np.random.Generator):
        return self.value(rng.uniform(*self.ends()))

    def ends(self) -> tuple[float, float]:
        return (math.log(self.low), math.log(self.high)) if self.log else (self.low - self.step / 2, self.high + self.step / 2)

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else value

    def value(self, inner: float):
        x = math.exp(inner) if self.log else inner
        if self.step:
            x = self.low + round((x - self.low) / self.step) * self.step
        x = min(max(x, self.low), self.high)
        return int(x) if self.step and float(self.step).is_integer() and float(self.low).is_integer() else float(x)


#: The search spaces.
SMALL_SPACE = {
    "max_depth": Choice((4, 6, 8)), "min_child_weight": Choice((1, 3, 5)), "gamma": Choice((0.0, 0.25, 0.5, 1.0)), "reg_alpha": Choice((0.0, 0.1, 0.5, 1.0)), "reg_lambda": Choice((1.0, 2.0, 4.0, 8.0)),
    "subsample": Choice((0.8, 0.9, 1.0)), "colsample_bytree": Choice((0.7, 0.8, 0.9)), "decoder_sticky_prior": Choice((0.0, 0.1, 0.2, 0.3)), "decoder_cross_coarse_penalty": Choice((0.0, 0.1, 0.2, 0.3)),
    "static_specialist_threshold": Choice((0.2, 0.35, 0.5)), "static_specialist_blend": Choice((0.3, 0.6, 0.8)),
}
WIDE_SPACE = {
    "max_depth": Span(3, 10, 1), "min_child_weight": Span(1, 10, 1), "gamma": Span(0.0, 2.5), "reg_alpha": Span(0.0, 2.0), "reg_lambda": Span(0.5, 15.0), "subsample": Span(0.65, 1.0), "colsample_bytree": Span(0.55, 1.0),
    "learning_rate": Span(0.01, 0.2, log=True), "n_estimators": Span(250, 900, 25), "decoder_sticky_prior": Span(0.0, 0.35), "decoder_cross_coarse_penalty": Span(0.0, 0.35),
    "static_specialist_threshold": Span(0.15, 0.65), "static_specialist_blend": Span(0.2, 0.9),
}


class Parzen:
    """The density of a parameter's values: a mean of one bell for each, cut off at the ends, and a wide one over the whole span.

    A bell is as wide as the distance to its farther neighbour, within bounds. Of choices, counts plus one each.
    """

    def __init__(self, of: Choice | Span, values: Sequence):
        self.of = of
        if isinstance(of, Choice):
            counts = np.array([1.0 + sum(v == x for x in values) for v in of.values])
            self.shares = counts / counts.sum()
            return
        low, high = of.ends()
        seen = np.array([of.inner(v) for v in values], float)
        centre = np.concatenate([seen, [(low + high) / 2]])
        order = np.argsort(centre, kind="stable")
        ends = np.concatenate([[low], centre[order], [high]])
        width = np.empty(len(centre))
        width[order] = np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1])
        self.centre, self.width = centre, np.clip(width, (high - low) / min(100, 1 + len(centre)), high - low)
        self.width[-1] = high - low

    @staticmethod
    def _below(z: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))

    def log(self, value) -> float:
        """The logarithm of the density; of stepped values, of the mass of their step."""
        if isinstance(self.of, Choice):
            return math.log(self.shares[self.of.values.index(value)])
        low, high = self.of.ends()
        within = self._below((high - self.centre) / self.width) - self._below((low - self.centre) / self.width)
        x = self.of.inner(value)
        if self.of.step:
            half = self.of.step / 2
            parts = self._below((x + half - self.centre) / self.width) - self._below((x - half - self.centre) / self.width)
        else:
            parts = np.exp(-0.5 * ((x - self.centre) / self.width) ** 2) / (self.width * math.sqrt(2 * math.pi))
        return math.log(max(float(np.mean(parts / within)), 1e-300))

    def draw(self, rng: np.random.Generator):
        if isinstance(self.of, Choice):
            return self.of.values[int(rng.choice(len(self.shares), p=self.shares))]
        low, high = self.of.ends()
        k = int(rng.integers(len(self.centre)))
        while not low <= (x := rng.normal(self.centre[k], self.width[k])) <= high:
            pass
        return self.of.value(x)


def good_trials(trials: Sequence[tuple[float, dict]]) -> tuple[list[dict], list[dict]]:
    """The best tenth of the trials (one at least, 25 at most; of equals the earlier ones), and the others."""
    order = sorted(range(len(trials)), key=lambda k: (-trials[k][0], k))
    n = min(max(1, math.ceil(0.1 * len(trials))), 25)
    return [trials[k][1] for k in order[:n]], [trials[k][1] for k in order[n:]]


def propose(space: dict[str, Choice | Span], trials: Sequence[tuple[float, dict]], rng: np.random.Generator) -> dict:
    """Parameter by parameter, the draw from the good trials' density that is likeliest against the others'."""
    if len(trials) < STARTUP:
        return {name: of.draw(rng) for name, of in space.items()}
    good, bad = good_trials(trials)
    out = {}
    for name, of in space.items():
        one, two = (Parzen(of, [t[name] for t in part]) for part in (good, bad))
        drawn = [one.draw(rng) for _ in range(PROPOSALS)]
        out[name] = max(drawn, key=lambda v: one.log(v) - two.log(v))
    return out


def bayesian_search(space: dict[str, Choice | Span], score: Callable[[dict], float], n: int, seed: int = SEED) -> list[tuple[float, dict]]:
    """n trials in their order; the larger score is the better. The same seed and scores give the same trials."""
    rng, trials = np.random.default_rng(seed), []
    for _ in range(n):
        tried = propose(space, trials, rng)
        trials.append((float(score(tried)), tried))
    return trials


def best_trial(trials: Sequence[tuple[float, dict]]) -> tuple[float, dict]:
    return max(trials, key=lambda t: t[0])


def fit_bundle(rows: DataFrame, features: Sequence[str], candidate: dict, labels: Sequence[str], static_labels: Sequence[str] = (), coarse: dict[str, str] = evaluation.COARSE_JOINT, decoder: str = "causal-hmm", label: str = "activity", weight: str | None = None, key: str = "session") -> Bundle:
    """Base trees, a specialist of the static labels where two of them occur, and transitions of the rows' sessions, by a candidate."""
    own = {k: v for k, v in candidate.items() if k in boosting.BASE}
    base = boosting.fit(rows, features, label, weight, own, labels)
    static = None
    few = rows.where(F.col(label).isin(*static_labels)) if static_labels else None
    if few is not None and len(few.select(label).distinct().take(2)) == 2:
        static = boosting.fit(few, features, label, weight, own, list(static_labels))
    init, trans = [], []
    if decoder == "causal-hmm":
        init, trans = transition_stats(rows, labels, candidate.get("decoder_sticky_prior", 0.0), candidate.get("decoder_cross_coarse_penalty", 0.0), coarse, label, key)
    return Bundle(base, static, decoder, init, trans, candidate.get("static_specialist_threshold", 0.35), candidate.get("static_specialist_blend", 0.6))


def transition_stats(rows: DataFrame, labels: Sequence[str], sticky: float, penalty: float, coarse: dict[str, str], label: str = "activity", key: str = "session") -> tuple[list[float], list[list[float]]]:
    """First-label and transition probabilities of sessions in the labels' order; only these reach the driver.

    ``sticky`` pulls the diagonal towards mean run lengths, ``penalty`` damps moves between coarse groups.
    """
    place = {n: k for k, n in enumerate(labels)}
    names, known = rows.sparkSession.createDataFrame([(n,) for n in labels], f"{label} string"), rows.where(F.col(label).isin(*labels))
    probs = evaluation.transition_probs(known, names, label, key)
    if sticky > 0:
        probs = evaluation.sticky(probs, evaluation.run_lengths(known, label, key), sticky, label)
    if penalty > 0:
        probs = evaluation.cross_coarse(probs, penalty, coarse)
    trans = np.zeros((len(labels), len(labels)))
    for r in probs.collect():
        trans[place[r.source], place[r.target]] = r.p
    first = {r[0]: r.p for r in evaluation.initial_probs(known, names, label, key).collect()}
    return [first[n] for n in labels], trans.tolist()


def evaluate(bundle: Bundle, rows: DataFrame, metric: str = "macro_f1", label: str = "activity", key: str = "session") -> float:
    """Accuracy or macro-F1 of the bundle's decoded labels on rows with key, seq, t, features and label."""
    found = infer(bundle, rows, key).select(key, "seq", F.col("decoded").alias("predicted"))
    told = rows.select(key, "seq", label).join(found, [key, "seq"])
    if metric == "accuracy":
        return told.agg(F.avg((F.col(label) == F.col("predicted")).cast("double"))).first()[0] or 0.0
    if metric != "macro_f1":
        raise ValueError(f"no such metric: {metric}")
    return macro_f1(told, label)
