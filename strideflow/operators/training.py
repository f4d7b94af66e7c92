"""Training and tuning: splits by hash, candidates, weighted forests, a refit on misses, run history."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.operators import decode, evaluation

#: The forest's base parameters.
BASE = {"numTrees": 400, "maxDepth": 6, "subsamplingRate": 0.9, "seed": 42}
SMALL_GRID = {"numTrees": (200, 400, 600), "maxDepth": (4, 6, 8), "subsamplingRate": (0.8, 0.9, 1.0), "minInstancesPerNode": (1, 3, 5)}
WIDE_GRID = {"numTrees": tuple(range(100, 901, 100)), "maxDepth": tuple(range(3, 13)), "subsamplingRate": (0.6, 0.7, 0.8, 0.9, 1.0), "minInstancesPerNode": (1, 2, 4, 8, 16)}


def collect_examples(windows: DataFrame, datasets: Sequence[str], placements: Sequence[str], labels: Sequence[str], merged: dict[str, str] | None = None, train_only: bool = True) -> DataFrame:
    """Windows to learn from and to test on, routed by ``part`` (train or test), with their sequence and subject groups.

    Needs dataset_id, placement_label, activity_label, split, global_subject_id, stream_id. Labels are merged first; windows of other
    datasets, placements, labels or splits are left out (``train_only`` windows count as train, or not at all). Test windows whose label
    never occurs in training are left out too. The labels of both parts are a handful of rows.
    """
    label = F.col("activity_label")
    for old, new in (merged or {}).items():
        label = F.when(F.col("activity_label") == old, new).otherwise(label)
    part = F.when(F.col("split") == "test", "test").when((F.col("split") == "train") | (F.lit(train_only) & (F.col("split") == "train_only")), "train")
    rows = windows.withColumns({"activity_label": label, "part": part}).where(F.col("dataset_id").isin(*datasets) & F.col("placement_label").isin(*placements) & F.col("activity_label").isin(*labels) & F.col("part").isNotNull())
    rows = rows.withColumns({"sequence_group": F.concat_ws("|", "dataset_id", "global_subject_id", "stream_id"), "subject_group": F.concat_ws("|", "dataset_id", "global_subject_id")})
    learned = rows.where("part = 'train'").select("activity_label").distinct().withColumnRenamed("activity_label", "_label")
    return rows.join(F.broadcast(learned), F.col("activity_label") == F.col("_label"), "left_semi")  # at most len(labels) rows


def decode_predictions(rows: DataFrame, decoder: str, init: Sequence[float], trans: Sequence[Sequence[float]], key: str = "session", probs: str = "probs") -> DataFrame:
    """key, seq, label_index by a decoder's name: none (the likeliest label of each row) or causal-hmm; others raise."""
    if decoder == "none":
        best = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
        return rows.select(key, "seq", best.alias("label_index"))
    if decoder == "causal-hmm":
        return decode.decode(rows, list(init), [list(r) for r in trans], probs, key).select(key, "seq", "label_index")
    raise ValueError(f"no such decoder: {decoder}")


def tuning_split(rows: DataFrame, group: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """``part``: tune or fit. All rows of a group go to one part by a hash of the group, so there is no shuffle.

    With a window id as the group, each label is split in proportion.
    """
    prefix = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))), 1, 8)
    return rows.withColumn("part", F.when(prefix < f"{int(share * 2**32):08x}", "tune").otherwise("fit"))


def split_or_fall_back(rows: DataFrame, groups: Sequence[str], label: str = "activity", share: float = 0.15, seed: int = 42) -> DataFrame:
    """The split by the first group that leaves rows to tune on and two labels to fit on; the last group is taken in any case."""
    for group in groups[:-1]:
        split = tuning_split(rows, group, share, seed)
        tune, low, high = split.agg(F.count_if(F.col("part") == "tune"), F.min(F.when(F.col("part") == "fit", F.col(label))), F.max(F.when(F.col("part") == "fit", F.col(label)))).first()
        if tune and low != high:
            return split
    return tuning_split(rows, groups[-1], share, seed)


def candidates(n: int, grid: dict[str, Sequence] = SMALL_GRID, seed: int = 42) -> list[dict]:
    """Up to n different parameter sets of the grid, drawn at random."""
    rng, found = random.Random(seed), {}
    while len(found) < min(n, math.prod(len(v) for v in grid.values())):
        drawn = {k: rng.choice(v) for k, v in grid.items()}
        found[tuple(drawn.values())] = drawn
    return list(found.values())


def label_order(rows: DataFrame, targets: Sequence[str], label: str = "activity") -> list[str]:
    """The target labels that occur in the rows, in the targets' order. One row a label reaches the driver."""
    seen = {row[0] for row in rows.where(F.col(label).isin(*targets)).select(label).distinct().collect()}
    return [n for n in targets if n in seen]


def label_index(label: Column, order: Sequence[str]) -> Column:
    """A label's place in the order, from 0; null for labels outside it."""
    place = F.array_position(F.array(*[F.lit(n) for n in order]), label) if order else F.lit(0)
    return F.when(place > 0, place - 1).cast("int")


def fit_forest(rows: DataFrame, features: Sequence[str], label: str = "activity", weight: str | None = None, params: dict | None = None) -> PipelineModel:
    """A random forest over feature columns; rows without a label or with a null or NaN feature are left out."""
    names = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip")
    rows = rows.where(F.col(label).isNotNull())
    if rows.isEmpty():
        raise ValueError("there are no labelled rows to fit on")
    known = names.fit(rows)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", **(BASE | (params or {})))
    if weight:
        forest = forest.setWeightCol(weight)
    steps = [known, VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"), forest]
    return Pipeline(stages=[*steps, IndexToString(inputCol="_prediction", outputCol="predicted", labels=known.labels)]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with ``predicted`` and ``probs`` (in the order of ``labels_of``). The label column isn't needed."""
    scored = PipelineModel(model.stages[1:]).transform(rows)
    return scored.select(*rows.columns, "predicted", vector_to_array("_probability").alias("probs"))


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def fit_two_stage(rows: DataFrame, features: Sequence[str], groups: dict[str, list[str]], label: str = "activity", weight: str | None = None, params: dict | None = None) -> dict[str, PipelineModel]:
    """A forest over coarse groups (key ``""``) and one inside each group that has two labels to tell apart.

    ``weight`` serves the inner forests; the coarse one weighs its groups by class. Rows of labels outside all groups are left out.
    """
    coarse_of = {n: g for g, names in groups.items() for n in names}
    known = rows.where(F.col(label).isin(*coarse_of)).replace(coarse_of, subset=[label])
    weights = F.broadcast(evaluation.class_weights(known, label).select(label, F.col("weight").alias("_coarse_weight")))  # one row per group
    models = {"": fit_forest(known.join(weights, label), features, label, "_coarse_weight", params)}
    for group, names in groups.items():
        own = rows.where(F.col(label).isin(*names))
        low, high = own.agg(F.min(label), F.max(label)).first()
        if low != high:
            models[group] = fit_forest(own, features, label, weight, params)
    return models


def predict_two_stage(models: dict[str, PipelineModel], rows: DataFrame, groups: dict[str, list[str]], specialist: PipelineModel | None = None) -> DataFrame:
    """The rows with ``predicted`` and ``probs`` in the order of the groups' labels: coarse mass times the inner forest's share.

    ``specialist`` (a forest over the static labels) then refines those. A label that a forest never saw gets 0 from it.
    """
    names = [n for own in groups.values() for n in own]
    views, out = models | ({"specialist of static labels": specialist} if specialist else {}), rows
    for k, model in enumerate(views.values()):
        out = predict(model, out).drop("predicted").withColumnRenamed("probs", f"_p{k}")
    views = {view: (f"_p{k}", labels_of(model)) for k, (view, model) in enumerate(views.items())}

    def share(view: str, name: str) -> Column:
        column, seen = views[view]
        return F.col(column)[seen.index(name)] if name in seen else F.lit(0.0)

    fine = {g: {n: share(g, n) for n in own} for g, own in groups.items() if g in models}
    probs = decode.hierarchical({g: share("", g) for g in groups}, fine, groups)
    out = out.withColumns({f"_q{k}": probs[n] for k, n in enumerate(names)})
    probs = {n: F.col(f"_q{k}") for k, n in enumerate(names)}
    if specialist:
        probs = decode.refine_static(probs, {n: share("specialist of static labels", n) for n in labels_of(specialist)})
    out = out.withColumn("probs", F.array(*probs.values()))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("probs", F.array_max("probs")).cast("int"))
    return out.select(*rows.columns, best.alias("predicted"), "probs")


def refit_on_misses(rows: DataFrame, features: Sequence[str], label: str = "activity", weight: str = "weight", factor: float = 1.75, params: dict | None = None) -> PipelineModel:
    """Fit, multiply the weights of the rows that it misses, and fit once more."""
    first = predict(fit_forest(rows, features, label, weight, params), rows)
    return fit_forest(evaluation.hard_negative_weights(first, weight, label, "predicted", factor), features, label, weight, params)


def macro_f1(rows: DataFrame, label: str = "activity") -> float:
    return evaluation.class_metrics(rows, label).agg(F.avg("f1")).first()[0] or 0.0


def search(rows: DataFrame, features: Sequence[str], tried: Sequence[dict], label: str = "activity", weight: str | None = None, score: Callable[[DataFrame, str], float] = macro_f1) -> list[tuple[float, dict]]:
    """Scores of the candidates on the rows of ``part`` tune, the best first; of equals the earlier. Each fit is a distributed job."""
    fit, tune = rows.where("part = 'fit'"), rows.where("part = 'tune'")
    found = [(score(predict(fit_forest(fit, features, label, weight, params), tune), label), params) for params in tried]
    return sorted(found, key=lambda x: -x[0])


def evolve(history: DataFrame, record: DataFrame) -> DataFrame:
    """Run history with new records added: all rows on the new records' fields; older rows lack what they never had."""
    return history.unionByName(record, allowMissingColumns=True).select(*record.columns)


def confusion_table(rows: DataFrame, labels: Sequence[str], label: str = "activity", predicted: str = "predicted") -> DataFrame:
    """One row per true label (``true_label``), one column per predicted label."""
    cells = evaluation.confusion(rows, label, predicted)
    return cells.groupBy(F.col(label).alias("true_label")).pivot(predicted, list(labels)).agg(F.sum("n")).fillna(0, list(labels))


def metric_rows(wide: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """``key, metric, value``: each metric column of a report as a row of its own."""
    return wide.unpivot([key], list(metrics), "metric", "value")


def upsert(held: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """A keyed table after changes: of each key the highest version stands, a change wins a tie, and ``deleted`` rows go.

    ``held`` has the columns of ``changes`` but for ``deleted``. Versions are compared before the shuffle.
    """
    both = held.withColumns({"deleted": F.lit(False), "_new": F.lit(0)}).unionByName(changes.withColumn("_new", F.lit(1)))
    row = F.struct(*held.columns, "deleted")
    newest = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(version, "_new")).alias("r"))
    return newest.where("not r.deleted").select("r.*").drop("deleted")
