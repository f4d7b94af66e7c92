"""Language identification by interpolated Kneser-Ney character models.

One model of orders 1 to 4 per language. All languages share sorted arrays of n-gram hashes with one column of
log-probabilities per language, so a character costs one binary search. The language with the lowest cross-entropy per
character wins; its margin, on a scale fitted on documents kept apart, is the score. A text whose cross-entropy lies
above what that language's own documents reach is marked rejected.

Learns from at most about ``max_docs`` documents per language, chosen by a hash of doc_id; n-grams are counted by Spark
and the counts of this bounded sample reach the driver. Scoring reads whole texts.

Null texts and texts without a letter are ``und`` with score 0; without training rows every text is; repeated rows get
equal results; an empty table gives no rows; columns beside doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import slices
from strideflow.llm.line_crf import remainder

ORDER, DISCOUNT, MAX_DOCS, START = 4, 0.75, 1500, 2
LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def _is_letter(raw: np.ndarray) -> np.ndarray:
    """Letters of all planes; the few distinct characters beyond the first plane are looked up one by one."""
    letter = LETTER[np.minimum(raw, 0xFFFF)]
    wide = np.flatnonzero(raw > 0xFFFF)
    if len(wide):
        found, of = np.unique(raw[wide], return_inverse=True)
        letter[wide] = np.array([chr(c).isalpha() for c in found.tolist()])[of]
    return letter


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit character codes of lower-cased texts end to end, non-letters as single spaces, three start marks before each; the rows' bounds."""
    raw = np.frombuffer("".join("\x02\x02\x02" + (t or "").lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = [3 + len((t or "").lower()) for t in texts]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    out = np.where(raw < 0x10000, raw, 0x8000 | (raw & 0x7FFF)).astype(np.uint16)
    mark = np.zeros(len(out), bool)
    for k in range(3):
        mark[begins[:-1] + k] = True
    out[~_is_letter(raw)] = 32
    out[mark] = START
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    bounds = np.concatenate([[0], np.cumsum(keep)])[begins]
    return out[keep], bounds


def grams(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character that is no start mark, and those places."""
    at = np.flatnonzero(code != START)
    wide = code.astype(np.uint64)
    key = wide[at]
    for k in range(1, n):
        key = key | (wide[at - k] << np.uint64(16 * k))
    return key, at


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return place, (table[place] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Model:
    langs: list[str]
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)
    sharpness: float = 50.0
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_prob(self, key: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log-probability of each n-gram's last character after the others, one column per language."""
        if n == 0:
            return np.tile(self.floor, (len(key), 1)).astype(np.float32)
        place, hit = _find(self.keys[n], key)
        out = self.logs[n][place]
        miss = np.flatnonzero(~hit)
        if len(miss):
            lower = self.log_prob(key[miss] & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
            where, known = _find(self.contexts[n], key[miss] >> np.uint64(16))
            out[miss] = lower + np.where(known[:, None], self.back[n][where], 0)
        return out

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy per character of each text and language; texts without a letter: nan."""
        code, bounds = codes(texts)
        key, at = grams(code, ORDER)
        rows = np.searchsorted(at, bounds)
        sums = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(key), 1 << 16):
            part = self.log_prob(key[a : a + (1 << 16)]).astype(np.float64)
            total = np.concatenate([np.zeros((1, part.shape[1])), np.cumsum(part, axis=0)])
            low, high = np.clip(rows[:-1] - a, 0, len(part)), np.clip(rows[1:] - a, 0, len(part))
            sums += total[high] - total[low]
        letter = np.concatenate([[0], np.cumsum((code != START) & (code != 32))])
        some = letter[bounds[1:]] > letter[bounds[:-1]]
        return np.where(some[:, None], -sums / np.maximum(np.diff(rows), 1)[:, None], np.nan)


def estimate(langs: list[str], lang: np.ndarray, order: np.ndarray, key: np.ndarray, count: np.ndarray, discount: float = DISCOUNT) -> Model:
    """Interpolated Kneser-Ney: raw counts at the top order, counts of distinct left neighbours below."""
    model, top = Model(langs), {}
    for n in range(1, ORDER + 1):
        for x in range(len(langs)):
            own = (lang == x) & (order == n)
            by = np.argsort(key[own], kind="stable")
            top[n, x] = key[own][by], count[own][by].astype(float)
    for n in range(ORDER - 1, 0, -1):
        for x in range(len(langs)):
            suffix, lefts = np.unique(top[n + 1, x][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
            top[n, x] = suffix, lefts.astype(float)
    alphabet = len(np.unique(np.concatenate([top[1, x][0] for x in range(len(langs))])))
    model.floor = np.full(len(langs), -np.log(alphabet + 1.0))
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([top[n, x][0] for x in range(len(langs))]))
        contexts = np.unique(keys >> np.uint64(16)) if n > 1 else np.zeros(1, np.uint64)
        back, seen, total = np.zeros((len(contexts), len(langs))), np.zeros((len(keys), len(langs))), np.zeros((len(contexts), len(langs)))
        of = np.searchsorted(contexts, keys >> np.uint64(16)) if n > 1 else np.zeros(len(keys), np.int64)
        for x in range(len(langs)):
            seen[np.searchsorted(keys, top[n, x][0]), x] = top[n, x][1]
            total[:, x] = np.bincount(of, seen[:, x], minlength=len(contexts))
            kinds = np.bincount(of, seen[:, x] > 0, minlength=len(contexts))
            back[:, x] = np.where(total[:, x] > 0, discount * kinds / np.maximum(total[:, x], 1), 1)
        lower = np.exp(model.log_prob(keys & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)) if n > 1 else np.exp(model.floor)[None, :]
        prob = np.maximum(seen - discount, 0) / np.maximum(total[of], 1) + back[of] * lower
        model.keys[n], model.logs[n] = keys, np.log(prob).astype(np.float32)
        model.contexts[n], model.back[n] = contexts, np.log(back).astype(np.float32)
    model.limits = np.full(len(langs), np.inf)
    return model


def calibrate(model: Model, texts: list[str], lang: np.ndarray, tail: float = 0.999) -> Model:
    """Fit the score's sharpness and each language's rejection limit on labelled texts that were not counted."""
    h = model.entropies(texts)
    ok = ~np.isnan(h[:, 0]) if len(texts) else np.zeros(0, bool)
    h, lang = h[ok], lang[ok]
    if len(h):
        gaps = h - h.min(axis=1, keepdims=True)
        loss = lambda s: np.mean(np.log(np.exp(-s * gaps).sum(1)) + s * gaps[np.arange(len(h)), lang])
        model.sharpness = min((float(s) for s in np.geomspace(0.5, 200, 40)), key=loss)
        for x in range(len(model.langs)):
            own = h[(lang == x) & (h.argmin(1) == x), x]
            if len(own):
                model.limits[x] = np.quantile(own, tail) + 0.5 * np.std(own) + 0.05
    return model


def _count(langs: list[str]):
    index = {name: k for k, name in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            lang = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()])
            texts = batch.column("text").to_pylist()
            for x in np.unique(lang[lang >= 0]):
                key, _ = grams(codes([t for t, y in zip(texts, lang, strict=True) if y == x])[0], ORDER)
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), x, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


def train(docs: DataFrame, max_docs: int = MAX_DOCS, folds: int = 4, held: int = 2) -> Model:
    """Learn from rows outside the held-out fold (crc32 of doc_id as text, modulo ``folds``, is ``held``)."""
    rows = docs.select(docs["doc_id"], docs["text"], docs["lang"])
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & (remainder(F.col("doc_id"), folds) != held))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(have)
    if not langs:
        return Model([])
    parts = 1_000_000
    limit = F.create_map(*[F.lit(v) for x in langs for v in (x, int(min(1.0, max_docs / have[x]) * parts))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(parts))
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0
    some = rows.where(draw < limit[F.col("lang")])
    counted = some.where(~apart).mapInArrow(_count(langs), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (counted.column(c).to_numpy() for c in ("lang", "gram", "n"))
    model = estimate(langs, lang, np.full(len(lang), ORDER), gram.view(np.uint64), n) if len(lang) else Model([])
    if not model.langs:
        return model
    kept = some.where(apart).select("text", "lang").limit(max_docs * len(langs)).toArrow()
    for_lang = np.array([langs.index(x) for x in kept.column("lang").to_pylist()], np.int64)
    texts = kept.column("text").to_pylist()
    return calibrate(model, texts, for_lang)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            if not model.langs:
                names, scores, rejected, least = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts), [None] * len(texts)
            else:
                h = model.entropies(texts)
                none = np.isnan(h[:, 0])
                h = np.where(none[:, None], 0, h)
                best = h.argmin(axis=1)
                least = h[np.arange(len(h)), best]
                prob = 1 / np.exp(-model.sharpness * (h - least[:, None])).sum(axis=1)
                names = ["und" if no else model.langs[b] for no, b in zip(none, best, strict=True)]
                scores, rejected = np.where(none, 0.0, prob), none | (least > model.limits[best])
                least = [None if no else float(x) for no, x in zip(none, least, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(least, pa.float64())], ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])

    rows = docs.select(docs["doc_id"], docs["text"])
    schema = rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean").add("cross_entropy", "double")
    out = rows.mapInArrow(run, schema)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def language(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
