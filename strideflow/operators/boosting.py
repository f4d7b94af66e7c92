"""Boosted softmax trees on histograms.

Feature values are cut into bins once. A level of all classes' trees of a round is one pass over the rows: tasks add up
gradients and second derivatives by (class, node, feature, bin), Spark sums and cumulates them and finds each node's best
split, and only the splits, one row a node, reach the driver. The rows' margins are stored every ``STORED`` rounds, so a pass
computes few trees anew and its lineage stays short. Gradients are summed as whole numbers, so the order of rows and
partitions changes nothing, and reruns agree.

A row without a label, with a null weight or a label outside ``labels`` isn't learned from. A null or NaN feature takes the side
that gains more; where a node saw none, the right one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from strideflow.sources.shared import checkpointed

#: The base parameters.
BASE = {"n_estimators": 400, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.9, "colsample_bytree": 0.8, "min_child_weight": 1.0, "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "max_bins": 64, "seed": 42}
STORED, SCALE, MISSING = 10, 1 << 24, 255


@dataclass
class Boosted:
    """Trees as arrays (tree, place): a node's children stand at 2p+1 and 2p+2, a leaf has feature -1. Tree t belongs to class t mod K."""

    features: list[str]
    labels: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """One row a row of feature values, one column a label."""
        out, trees = np.zeros((len(x), len(self.labels))), np.arange(len(self.feature))
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        step = max(1, (1 << 20) // max(len(trees), 1))
        for start in range(0, len(x) if len(trees) else 0, step):
            part = x[start : start + step]
            place, row = np.zeros((len(part), len(trees)), np.int64), np.arange(len(part))[:, None]
            for _ in range(depth):
                feature = self.feature[trees, place]
                with np.errstate(invalid="ignore"):
                    seen = part[row, feature]
                    left = np.where(np.isnan(seen), self.missing_left[trees, place], seen <= self.threshold[trees, place])
                place = np.where(feature < 0, place, 2 * place + 2 - left)
            out[start : start + step] = self.value[trees, place].reshape(len(part), -1, len(self.labels)).sum(axis=1)
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(np.asarray(x, float)))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """Feature columns of a batch as doubles, null as NaN."""
    columns = [np.asarray(batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for f in features]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


# --- bins ------------------------------------------------------------------------------------------------


def bin_cuts(rows: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Per feature the values that end its bins; one pass."""
    if not 2 <= max_bins <= 250:
        raise ValueError("max_bins lies between 2 and 250")
    shares = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(f), shares, 100_000).alias(f"c{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array(c or [], float)) for c in found]


def _binned(cuts: list[np.ndarray], features: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, features)
            bins = np.stack([np.where(np.isnan(v), MISSING, np.searchsorted(c, v)) for v, c in zip(x.T, cuts, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), batch.column("weight"), pa.array([b.tobytes() for b in bins], pa.binary())], ["row", "label", "weight", "bins"])

    return run


# --- a pass over the rows --------------------------------------------------------------------------------------


@dataclass
class Round:
    """The trees of one round while they grow, one a class: features and bins instead of thresholds."""

    number: int
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    allowed: np.ndarray

    @classmethod
    def start(cls, number: int, labels: int, features: int, p: dict) -> Round:
        size, allowed = 2 ** (p["max_depth"] + 1) - 1, np.zeros((labels, features), bool)
        for k in range(labels):
            take = np.random.default_rng([p["seed"], number, k]).permutation(features)[: max(1, int(p["colsample_bytree"] * features))]
            allowed[k, take] = True
        return cls(number, np.full((labels, size), -1), np.zeros((labels, size), np.int64), np.zeros((labels, size), bool), np.zeros((labels, size)), allowed)

    def places(self, bins: np.ndarray, k: int, depth: int) -> np.ndarray:
        place, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            feature = self.feature[k, place]
            seen = bins[row, feature]
            left = np.where(seen == MISSING, self.missing_left[k, place], seen <= self.cut[k, place])
            place = np.where(feature < 0, place, 2 * place + 2 - left)
        return place

    def margins(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.stack([self.value[k, self.places(bins, k, depth)] for k in range(len(self.value))], axis=1)


def _sampled(row: np.ndarray, number: int, p: dict) -> np.ndarray:
    """Rows that a round learns from, by a hash of the row's number."""
    x = row.astype(np.int64).view(np.uint64) + np.uint64((p["seed"] * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2**53 < p["subsample"]


def _rows_of(batch: pa.RecordBatch, past: list[Round], depth: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    margins = np.array(batch.column("margins").to_pylist(), float)
    for old in past:
        margins += old.margins(bins, depth)
    return bins, margins


def _histograms(past: list[Round], now: Round, level: int, p: dict):
    """Sums of gradients and second derivatives by class, node of this level, feature and bin, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, features = now.allowed.shape
        nodes, first = 2**level, 2**level - 1
        sums = np.zeros((2, labels, nodes * features * 256))
        for batch in (b for b in batches if b.num_rows):
            bins, margins = _rows_of(batch, past, p["max_depth"])
            label, weight, keep = batch.column("label").to_numpy(), batch.column("weight").to_numpy(), _sampled(batch.column("row").to_numpy(), now.number, p)
            probs = softmax(margins)
            for k in range(labels):
                place = now.places(bins, k, level) - first
                at = np.flatnonzero(keep & (place >= 0))
                g = np.rint((probs[at, k] - (label[at] == k)) * weight[at] * SCALE)
                h = np.rint(np.maximum(2 * probs[at, k] * (1 - probs[at, k]), 1e-16) * weight[at] * SCALE)
                allowed = np.flatnonzero(now.allowed[k])
                cell = ((place[at, None] * features + allowed) * 256 + bins[np.ix_(at, allowed)]).ravel()
                for s, v in enumerate((g, h)):
                    sums[s, k] += np.bincount(cell, np.repeat(v, len(allowed)), minlength=sums.shape[2])
        k, cell = np.nonzero(sums.any(axis=0))
        node, feature, at = cell // (features * 256), cell // 256 % features, cell % 256
        where = [pa.array(c.astype(np.int32)) for c in (k, node + first, feature, np.where(at == MISSING, -1, at))]
        yield pa.RecordBatch.from_arrays([*where, *[pa.array(sums[s, k, cell].astype(np.int64)) for s in range(2)]], ["k", "node", "feature", "bin", "g", "h"])

    return run


def best_splits(cells: DataFrame, p: dict) -> DataFrame:
    """From sums by (k, node, feature, bin; -1 for missing values): one row a node with its best split, if any gains, and its sums.

    Of equal gains the first feature, then the lowest bin, then missing values to the left.
    """
    total = cells.groupBy("k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    group = Window.partitionBy("k", "node", "feature")
    so_far = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = {c: F.sum(c).over(group).alias(f"{c}_all") for c in ("g", "h")}
    missing = {c: F.sum(F.when(F.col("bin") < 0, F.col(c)).otherwise(0)).over(group).alias(f"{c}_none") for c in ("g", "h")}
    rows = total.select("k", "node", "feature", "bin", *[F.sum(c).over(so_far).alias(f"{c}_left") for c in ("g", "h")], *whole.values(), *missing.values())

    def score(g, h):
        shrunk = F.greatest(F.abs(g) / SCALE - p["reg_alpha"], F.lit(0.0))
        return shrunk * shrunk / (h / SCALE + p["reg_lambda"])

    g, h = F.col("g_all"), F.col("h_all")

    def candidate(missing_left: bool):
        gl = F.col("g_left") - (0 if missing_left else F.col("g_none"))
        hl = F.col("h_left") - (0 if missing_left else F.col("h_none"))
        least = int(max(p["min_child_weight"] * SCALE, 1))
        gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
        ok = (F.col("bin") >= 0) & (hl >= least) & (h - hl >= least) & (gain > max(p["gamma"], 1e-9))
        return F.struct(F.when(ok, gain).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), F.lit(missing_left).alias("missing_left"), gl.alias("gl"), hl.alias("hl"))

    one = rows.select("k", "node", "g_all", "h_all", F.greatest(candidate(True), candidate(False)).alias("s"))
    best = one.groupBy("k", "node").agg(F.max("s").alias("s"), F.first("g_all").alias("g"), F.first("h_all").alias("h"))
    return best.select("k", "node", "s.gain", (-F.col("s.feature")).alias("feature"), (-F.col("s.bin")).alias("bin"), "s.missing_left", "s.gl", "s.hl", "g", "h")


def _leaf(g: float, h: float, p: dict) -> float:
    g, h = g / SCALE, h / SCALE
    return float(-np.sign(g) * max(abs(g) - p["reg_alpha"], 0.0) / (h + p["reg_lambda"]) * p["learning_rate"])


def _grow(now: Round, level: int, splits: list, p: dict) -> bool:
    """Put a level's splits into the trees; whether any node was split."""
    split = False
    for s in splits:
        now.value[s.k, s.node] = _leaf(s.g, s.h, p)
        if s.gain is not None:
            now.feature[s.k, s.node], now.cut[s.k, s.node], now.missing_left[s.k, s.node] = s.feature, s.bin, s.missing_left
            for side, g, h in ((1, s.gl, s.hl), (2, s.g - s.gl, s.h - s.hl)):
                now.value[s.k, 2 * s.node + side] = _leaf(g, h, p)
            split = True
    return split


# --- fitting and predicting ------------------------------------------------------------------------------------


def fit(rows: DataFrame, features: Sequence[str], label: str = "activity", weight: str | None = None, params: dict | None = None, labels: Sequence[str] | None = None) -> Boosted:
    """Trees over feature columns. ``labels`` gives the labels and their order; by default those that occur, sorted."""
    p, features = BASE | (params or {}), list(features)
    if unknown := set(p) - set(BASE):
        raise ValueError(f"no such parameter: {sorted(unknown)}")
    labels = list(labels) if labels else sorted(r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().collect())
    number = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1 if labels else F.lit(-1)
    known = rows.select(*features, number.cast("int").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")).where("label >= 0 and weight is not null")
    known = known.withColumn("row", F.xxhash64(*features, "label", "weight", F.monotonically_increasing_id()))
    cuts = bin_cuts(known, features, p["max_bins"])
    stored = known.mapInArrow(_binned(cuts, features), "row long, label int, weight double, bins binary").withColumn("margins", F.array_repeat(F.lit(0.0), len(labels)))
    stored, rounds, past = checkpointed(stored), [], []
    if stored.isEmpty():
        raise ValueError("there are no labelled rows to fit on")
    for n in range(p["n_estimators"]):
        now = Round.start(n, len(labels), len(features), p)
        for level in range(p["max_depth"]):
            cells = stored.mapInArrow(_histograms(past, now, level, p), "k int, node int, feature int, bin int, g long, h long")
            if not _grow(now, level, best_splits(cells, p).collect(), p):  # one row a node
                break
        rounds.append(now)
        past.append(now)
        if len(past) == STORED and n + 1 < p["n_estimators"]:
            stored, past = checkpointed(stored.mapInArrow(_with_margins(past, p["max_depth"]), stored.schema)), []
    threshold = [np.array([[cuts[f][c] if f >= 0 and c < len(cuts[f]) else np.inf for f, c in zip(*x, strict=True)] for x in zip(r.feature, r.cut, strict=True)]) for r in rounds]
    size = 2 ** (p["max_depth"] + 1) - 1
    joined = lambda parts, kind: np.concatenate([np.zeros((0, size)), *parts]).astype(kind)
    return Boosted(features, labels, joined([r.feature for r in rounds], np.int32), joined(threshold, float), joined([r.missing_left for r in rounds], bool), joined([r.value for r in rounds], float))


def _with_margins(past: list[Round], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            _, margins = _rows_of(batch, past, depth)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "label", "weight", "bins")], pa.array(margins.tolist(), pa.list_(pa.float64()))], ["row", "label", "weight", "bins", "margins"])

    return run


def predict(model, rows: DataFrame) -> DataFrame:
    """The rows with ``predicted`` and ``probs`` (in the order of the model's labels) by anything with features, labels and proba."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probs = model.proba(matrix(batch, model.features))
            best = [model.labels[k] for k in probs.argmax(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(best, pa.string()), pa.array(probs.tolist(), pa.list_(pa.float64()))], [*names, "predicted", "probs"])

    return rows.mapInArrow(run, rows.select("*").schema.add("predicted", StringType()).add("probs", ArrayType(DoubleType())))
