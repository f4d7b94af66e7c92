"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are shapes and repetitions of its own text and of the lines beside it; a
2x2 matrix weighs neighbouring labels. Forward-backward marginals of "good", averaged by line length and calibrated,
are the document's score.

Training fits weights on at most ``max_train_docs`` labelled documents (those with the smallest hash of doc_id); line labels
are hidden, and the document's label is fitted through its lines' marginals. This bound and the model are all that reaches
the driver. Scoring reads whole texts.

Null or empty texts score 0; a text of blank lines is scored like others; repeated rows score alike; without usable
labels every text scores 0.5 and empty ones 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import LOWER, SPACES, buffer_of, slices, word_hashes, words_of

MAX_TRAIN_DOCS = 6000
THRESHOLD = 0.3
N_OWN = 18


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


UPPER, LOWERCASE, DIGIT, HIGH = _class((65, 90)), _class((97, 122)), _class((48, 57)), _class((128, 255))
LOUD = _class((33, 33), (63, 63))
PLAIN = _class((34, 34), (39, 41), (44, 46), (58, 59))
SYMBOL = ~(UPPER | LOWERCASE | DIGIT | HIGH | LOUD | PLAIN | SPACES)


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (its own, the previous and the next line's, a constant), line lengths, each row's bounds in the lines."""
    if not len(data):
        return np.zeros((0, 3 * N_OWN + 3)), np.zeros(0), np.zeros(len(bounds), np.int64)
    ends_here = data == 10
    full = np.diff(bounds) > 0
    ends_here[bounds[1:][full] - 1] = True
    stops = np.flatnonzero(ends_here) + 1
    starts = np.concatenate([[0], stops[:-1]])
    rows = np.searchsorted(starts, bounds)
    length = (stops - starts).astype(float)
    share = lambda table: np.add.reduceat(table[data].astype(np.int32), starts) / length

    first, last, _ = words_of(data, bounds, SPACES)
    hashes = word_hashes(LOWER[data], first, last)
    of = np.searchsorted(starts, first, "right") - 1
    n_words = np.bincount(of, minlength=len(starts)).astype(float)
    some = np.maximum(n_words, 1)
    letters = np.bincount(of, (last - first).astype(float), minlength=len(starts))
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=len(starts))
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(len(starts))
    np.maximum.at(top, of[order][new], size)
    again = np.zeros(len(of))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    twice = np.bincount(of, again, minlength=len(starts)) / some  # words that repeat the word before
    # lines that stand elsewhere in the text
    line_hash = np.zeros(len(starts), np.uint64)
    np.add.at(line_hash, of, hashes * (2 * (np.arange(len(of)) - np.searchsorted(of, of)) + 1).astype(np.uint64))
    row = np.searchsorted(bounds, starts, "right") - 1
    by = np.lexsort((line_hash, row))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (line_hash[by][1:] != line_hash[by][:-1]) | (row[by][1:] != row[by][:-1])
    group = np.cumsum(fresh) - 1
    copies = np.empty(len(by))
    copies[by] = np.bincount(group)[group]
    copies[n_words == 0] = 1
    tail = data[np.maximum(starts, stops - 2)]
    tail = np.where(data[stops - 1] == 10, tail, data[stops - 1])
    head = data[starts]
    up, low, high = share(UPPER), share(LOWERCASE), share(HIGH)
    own = np.stack([
        np.log1p(length) / 5, np.log1p(n_words) / 4, letters / some / 8, up, low, high, share(DIGIT), share(LOUD) * 4, share(SYMBOL) * 4, share(PLAIN) * 4,
        distinct / some, top / some, np.minimum(copies - 1, 3), np.isin(tail, [33, 46, 63]).astype(float), UPPER[head].astype(float),
        up / (up + low + high + 1e-9), (n_words == 0).astype(float), twice * 4,
    ], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    begins, finishes = rows[:-1][full], rows[1:][full] - 1
    before[begins], after[finishes] = 0, 0
    edge = np.zeros((len(own), 3))
    edge[:, 0] = 1
    edge[begins, 1] = 1
    edge[finishes, 2] = 1
    return np.concatenate([own, before, after, edge], axis=1), length, rows


def _steps(rows: np.ndarray, backward: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Line and neighbour for all texts at once: second lines, third lines, and so on from the front or the back."""
    begin, count = rows[:-1], np.diff(rows)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    for k in range(1, int(count.max(initial=0))):
        live = int(np.searchsorted(-count, -k, "left"))
        at = begin[:live] + (count[:live] - 1 - k if backward else k)
        yield at, at + (1 if backward else -1)


def messages(unary: np.ndarray, pair: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (with the line's own weight) and backward log-odds of good over bad."""
    forward, back = unary.copy(), np.zeros_like(unary)
    for at, prev in _steps(rows, backward=False):
        x = forward[prev]
        forward[at] += np.logaddexp(x + pair[1, 1], pair[0, 1]) - np.logaddexp(x + pair[1, 0], pair[0, 0])
    for at, nxt in _steps(rows, backward=True):
        x = unary[nxt] + back[nxt]
        back[at] = np.logaddexp(x + pair[1, 1], pair[1, 0]) - np.logaddexp(x + pair[0, 1], pair[0, 0])
    return forward, back


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class LineCRF:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    trained: bool = True

    def marginals(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        forward, back = messages(((x - self.mean) / self.scale) @ self.weights, self.pair, rows)
        return _sigmoid(forward + back)

    def raw(self, x: np.ndarray, length: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each text; texts without lines: -inf."""
        sums = np.concatenate([[0.0], np.cumsum(self.marginals(x, rows) * length)])
        sizes = np.concatenate([[0.0], np.cumsum(length)])
        total = sizes[rows[1:]] - sizes[rows[:-1]]
        mean = np.clip((sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(total, 1), 1e-6, 1 - 1e-6)
        return np.where(total > 0, np.log(mean / (1 - mean)), -np.inf)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x, length, rows = line_features(data, bounds)
        if not self.trained:
            return np.where(np.diff(rows) > 0, 0.5, 0.0)
        raw = self.raw(x, length, rows)
        return np.where(np.isfinite(raw), _sigmoid(self.slope * np.where(np.isfinite(raw), raw, 0) + self.offset), 0.0)


def _expected(unary: np.ndarray, pair: np.ndarray, rows: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good for every line, and for each inner line (with its predecessor) those of the four pairs of labels."""
    forward, back = messages(unary, pair, rows)
    left, right = forward[inner - 1], unary[inner] + back[inner]
    logits = np.stack([np.full_like(left, pair[0, 0]), pair[0, 1] + right, left + pair[1, 0], left + right + pair[1, 1]])
    joint = np.exp(logits - logits.max(0))
    return _sigmoid(forward + back), joint / joint.sum(0)


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-4, warm: float = 0.4, nudge: float = 1e-3) -> LineCRF:
    """Fit by Adam to documents' labels; then calibrate the documents' scores.

    Line labels are hidden. The share ``warm`` of the rounds begins with every line at its document's label, which tells the
    lines' features apart; then the document's label is fitted through the length-weighted mean of its lines' marginals, so
    lines may differ from their document. The gradient of that mean is a covariance with the model's features: the change of
    their expectations when the lines' weights are nudged, taken from two more forward-backward passes.
    """
    parts, counts, length = [], [], []
    for k in range(0, len(texts), 128):  # features of a few documents at a time, in half the width
        x, size, rows = line_features(*buffer_of(texts[k : k + 128]))
        parts.append(x.astype(np.float32))
        counts.append(np.diff(rows))
        length.append(size)
    width = 3 * N_OWN + 3
    lines = sum(len(p) for p in parts)
    if not lines or len(set(labels)) < 2:
        return LineCRF(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), trained=False)
    z, at = np.empty((lines, width), np.float32), 0
    for k, p in enumerate(parts):
        z[at : at + len(p)], parts[k] = p, None
        at += len(p)
    length, counts = np.concatenate(length), np.concatenate(counts)
    rows = np.concatenate([[0], np.cumsum(counts)])
    of = np.repeat(np.arange(len(counts)), counts)
    y = labels[of].astype(float)
    mean, scale = z.mean(0, dtype=float), np.sqrt(np.maximum(z.var(0, dtype=float), 0))
    mean[scale < 1e-9], scale[scale < 1e-9] = 0, 1
    z -= mean.astype(np.float32)
    z /= scale.astype(np.float32)
    inner = np.ones(lines, bool)
    inner[rows[:-1][counts > 0]] = False
    here = np.flatnonzero(inner)
    total = np.bincount(of, length, minlength=len(counts))
    weight = length / np.maximum(total, 1)[of]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here - 1].astype(int), y[here].astype(int)), 1)
    theta, first, second = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, rounds + 1):
        pair = theta[width:].reshape(2, 2)
        unary = (z @ theta[:width].astype(np.float32)).astype(float)
        good, joint = _expected(unary, pair, rows, here)
        if step <= warm * rounds:
            slope = np.concatenate([(y - good).astype(np.float32) @ z, (seen - joint.sum(1).reshape(2, 2)).ravel()]) / lines
        else:
            m = np.clip(np.bincount(of, weight * good, minlength=len(counts)), 1e-4, 1 - 1e-4)
            push = ((labels - m) / (m * (1 - m)))[of] * weight  # the slope of the documents' log-likelihood by each line's marginal
            size = nudge / max(1e-9, np.abs(push).max())
            (up, joint_up), (down, joint_down) = (_expected(unary + sign * size * push, pair, rows, here) for sign in (1, -1))
            slope = np.concatenate([((up - down) / (2 * size)).astype(np.float32) @ z, (joint_up - joint_down).sum(1) / (2 * size)]) / len(counts)
        slope = slope - ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = LineCRF(mean, scale, theta[:width], theta[width:].reshape(2, 2))
    good, _ = _expected((z @ theta[:width].astype(np.float32)).astype(float), model.pair, rows, here)
    ok = total > 0
    m = np.clip(np.bincount(of, weight * good, minlength=len(counts)), 1e-6, 1 - 1e-6)[ok]
    raw, target = np.log(m / (1 - m)), labels[ok].astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve through the scores
        p = _sigmoid(a * raw + b)
        g = np.array([((target - p) * raw).sum() - 1e-3 * a, (target - p).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    model.slope, model.offset = float(max(a, 1e-3)), float(b)
    return model


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, folds: int = 5) -> LineCRF:
    """Fit on labelled documents outside the held-out fold (crc32 of doc_id as text, modulo ``folds``, is 0)."""
    usable = labels.where(labels["quality"].isin(0, 1) & labels["doc_id"].isNotNull() & (remainder(labels["doc_id"], folds) != 0))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)  # at most max_train_docs short rows
    rows = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(some), "doc_id").where("length(text) > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    found = rows.limit(max_train_docs).select("text", "quality").toArrow()
    texts, quality = found.column("text").combine_chunks(), found.column("quality").to_numpy().astype(int)
    del found
    model = fit(texts, quality)
    del texts
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # the C library keeps what the fit took, beside what Spark's driver needs
        ctypes.CDLL(None).malloc_trim(0)
    return model


def _scored(docs: DataFrame, model: LineCRF, carry: tuple[str, ...]) -> DataFrame:
    """``_carry`` (the columns named, whatever their names) and ``_score`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = model.scores(*buffer_of(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_carry"), pa.array(found, pa.float64())], ["_carry", "_score"])

    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("_carry"), docs["text"].alias("_text"))
    return rows.mapInArrow(run, rows.select("_carry").schema.add("_score", "double"))


def score(docs: DataFrame, model: LineCRF, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of each row and its ``score``."""
    return _scored(docs, model, carry).select("_carry.*", F.col("_score").alias("score"))


def good_documents(docs: DataFrame, model: LineCRF, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns and no other."""
    return _scored(docs, model, tuple(docs.columns)).where(F.col("_score") >= threshold).select("_carry.*")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
