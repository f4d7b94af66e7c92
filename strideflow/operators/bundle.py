"""A fitted model as a versioned bundle: saved, loaded, and scored alike in batches and in keyed stream state.

A bundle is two small Parquet tables: the trees, one row a tree, and one row that describes them (names, decoder, checksum), which
is written last. A folder without it is half-written and doesn't load, nor does one whose checksum, version or names differ.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.operators import boosting, decode
from strideflow.operators.boosting import Boosted

VERSION = 1
_PARTS = (("feature", np.int32), ("threshold", np.float64), ("missing_left", np.bool_), ("value", np.float64))


@dataclass
class Bundle:
    """The base model, a specialist of some labels (its own ``labels``) or none, and the decoder with its probabilities."""

    base: Boosted
    static: Boosted | None = None
    decoder: str = "none"
    init: list[float] = field(default_factory=list)
    trans: list[list[float]] = field(default_factory=list)
    gate: float = 0.35
    blend: float = 0.6

    @property
    def features(self) -> list[str]:
        return self.base.features

    @property
    def labels(self) -> list[str]:
        return self.base.labels

    def proba(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the base model, those of the specialist's labels refined where they hold enough mass."""
        probs = self.base.proba(x)
        if self.static is None or not len(x):
            return probs
        at = [self.labels.index(n) for n in self.static.labels]
        mass = probs[:, at].sum(axis=1, keepdims=True)
        mixed = (1 - self.blend) * probs[:, at] + self.blend * mass * self.static.proba(x)
        probs[:, at] = np.where(mass >= self.gate, mixed, probs[:, at])
        return probs / probs.sum(axis=1, keepdims=True)

    def emission(self) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
        """For a live scorer: features by name, one entry a window, to one row of probabilities a window."""

        def emit(found: dict[str, np.ndarray]) -> np.ndarray:
            # as the batch form stores them
            return self.proba(np.stack([np.asarray(found[n], np.float32).astype(float) for n in self.features], axis=-1))

        return emit


def _checksum(trees: list[tuple]) -> str:
    return hashlib.sha256(json.dumps(sorted(trees)).encode()).hexdigest()


def _rows(bundle: Bundle) -> list[tuple]:
    models = {"base": bundle.base} | ({"static": bundle.static} if bundle.static else {})
    return [(name, t, *[getattr(m, part)[t].tolist() for part, _ in _PARTS]) for name, m in models.items() for t in range(len(m.feature))]


def save(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Write the bundle to a new folder. The number of trees is a parameter of the fit, so both tables are small."""
    trees = _rows(bundle)
    schema = "model string, tree int, feature array<int>, threshold array<double>, missing_left array<boolean>, value array<double>"
    spark.createDataFrame(trees, schema).coalesce(1).write.parquet(f"{path}/trees")
    about = {
        "version": VERSION, "features": bundle.features, "labels": bundle.labels, "static_labels": bundle.static.labels if bundle.static else None, "decoder": bundle.decoder,
        "init": bundle.init, "trans": bundle.trans, "gate": bundle.gate, "blend": bundle.blend, "trees": len(trees), "checksum": _checksum(trees),
    }
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Bundle:
    """Read a bundle; ``features``, if given, must be those that it was fitted on, in their order.

    No bundle at the path, or a half-written one: FileNotFoundError. Another version, checksum or other names: ValueError.
    """
    try:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    except (AnalysisException, TypeError) as e:
        raise FileNotFoundError(f"there is no whole model bundle at {path}") from e
    if about["version"] != VERSION:
        raise ValueError(f"bundle version {about['version']}, not {VERSION}")
    if features is not None and list(features) != about["features"]:
        raise ValueError(f"the bundle was fitted on other features: {sorted(set(features) ^ set(about['features'])) or 'another order'}")
    try:
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/trees").orderBy("model", "tree").collect()]
    except AnalysisException as e:
        raise FileNotFoundError(f"the bundle at {path} has no trees") from e
    if len(rows) != about["trees"] or _checksum(rows) != about["checksum"]:
        raise ValueError(f"the trees at {path} are not those that were saved")

    def model(name: str, labels: list[str]) -> Boosted:
        own = [r for r in rows if r[0] == name]
        return Boosted(about["features"], labels, *[np.array([r[2 + k] for r in own], kind) for k, (_, kind) in enumerate(_PARTS)])

    static = model("static", about["static_labels"]) if about["static_labels"] else None
    return Bundle(model("base", about["labels"]), static, about["decoder"], about["init"], about["trans"], about["gate"], about["blend"])


def infer(bundle: Bundle, windows: DataFrame, key: str = "session") -> DataFrame:
    """key, seq, raw (the likeliest label of a window alone), decoded (by the bundle's decoder), probs (refined).

    Windows need key, seq, t and the features. Null features count as missing; a decoder that isn't known raises.
    """
    scored = boosting.predict(bundle, windows.select(key, "seq", "t", *bundle.features)).select(key, "seq", "t", "predicted", "probs")
    if bundle.decoder == "none":
        return scored.select(key, "seq", F.col("predicted").alias("raw"), F.col("predicted").alias("decoded"), "probs")
    if bundle.decoder != "causal-hmm":
        raise ValueError(f"no such decoder: {bundle.decoder}")
    names = F.array(*map(F.lit, bundle.labels))
    found = decode.decode(scored, list(bundle.init), [list(r) for r in bundle.trans], "probs", key).select(key, "seq", "label_index")
    return scored.join(found, [key, "seq"]).select(key, "seq", F.col("predicted").alias("raw"), F.element_at(names, F.col("label_index") + 1).alias("decoded"), "probs")
