"""Weights, transition statistics and evaluation: grouped built-ins; K x K results stay tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coarse groups of labels.
COARSE = {"walk": "locomotion", "run": "locomotion", "stairs": "locomotion", "sit": "static", "lay": "static", "stand": "static", "transitions": "transition", "locomotion-other": "other"}
COARSE_JOINT = COARSE | {"sit/lay": "static"}


def coarse(label: Column, groups: dict[str, str] = COARSE) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for pair in groups.items() for v in pair])[label], F.lit("other"))


def class_weights(rows: DataFrame, label: str = "activity") -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (F.greatest(F.lit(1), F.col("n")) * F.count("*").over(Window.partitionBy())))


def dataset_weights(rows: DataFrame, group: str, strength: float = 1.0, root: bool = False) -> DataFrame:
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    ratio = F.avg("n").over(Window.partitionBy()) / F.col("n")
    return counts.withColumn("weight", F.pow(F.sqrt(ratio) if root else ratio, F.lit(min(1.0, max(0.0, strength)))))


def sample_weights(rows: DataFrame, label: str, group: str) -> DataFrame:
    by_class, by_group = class_weights(rows, label), dataset_weights(rows, group)
    both = rows.join(by_class.select(label, F.col("weight").alias("_c")), label).join(by_group.select(group, F.col("weight").alias("_g")), group)
    return both.withColumn("weight", F.col("_c") * F.col("_g")).drop("_c", "_g")


def hard_negative_weights(rows: DataFrame, weight: str, label: str, predicted: str, factor: float = 1.75) -> DataFrame:
    return rows.withColumn(weight, F.when(F.col(label) != F.col(predicted), F.col(weight) * factor).otherwise(F.col(weight)))


def transitions(rows: DataFrame, label: str = "activity", key: str = "session") -> DataFrame:
    """source, target, n of neighbouring rows; counts are added before the shuffle."""
    order = Window.partitionBy(key).orderBy("t", "seq")
    pairs = rows.select(F.lag(label).over(order).alias("source"), F.col(label).alias("target"))
    return pairs.where("source is not null and target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))


def initial_probs(rows: DataFrame, labels: DataFrame, label: str = "activity", key: str = "session") -> DataFrame:
    """label, p: how often a series begins with each label, one added to each (``labels``: a handful of rows)."""
    first = rows.where(F.col(label).isNotNull()).groupBy(key).agg(F.min_by(label, F.struct("t", "seq")).alias(label)).groupBy(label).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)) + 1
    return labels.select(label).where(F.col(label).isNotNull()).distinct().join(first, label, "left").select(label, (n / F.sum(n).over(Window.partitionBy())).alias("p"))


def log_form(probs: DataFrame, column: str = "p") -> DataFrame:
    """Probabilities as logarithms, none below that of 1e-12."""
    return probs.withColumn(column, F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.col(column)))))


def coverage(rows: DataFrame, datasets: tuple[str, ...], placements: tuple[str, ...], labels: tuple[str, ...], remap: dict[str, str] | None = None) -> DataFrame:
    """metric, value: windows of each label in order of its name (0 where there is none), the total, and what was left out by
    dataset, placement or label, each counted at the first of these; then the number of labels without a window.

    Needs dataset_id, placement_label, activity_label. One pass; the counts are a handful of rows.
    """
    label = F.col("activity_label")
    for old, new in (remap or {}).items():
        label = F.when(F.col("activity_label") == old, new).otherwise(label)
    why = (
        F.when(~F.coalesce(F.lower("dataset_id").isin(*datasets), F.lit(False)), "excluded_dataset").when(~F.coalesce(F.col("placement_label").isin(*placements), F.lit(False)), "excluded_placement")
        .when(~F.coalesce(label.isin(*labels), F.lit(False)), "excluded_activity").otherwise(F.concat(F.lit("label:"), label))
    )
    found = rows.groupBy(why.alias("metric")).agg(F.count("*").alias("n"))
    names = [*(f"label:{n}" for n in sorted(labels)), "excluded_dataset", "excluded_placement", "excluded_activity"]
    wanted = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("metric"))
    told = wanted.join(found, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("value"))
    own = F.col("metric").startswith("label:")
    sums = told.agg(F.sum(F.when(own, F.col("value")).otherwise(0)).alias("total_windows"), F.count_if(own & (F.col("value") == 0)).alias("missing_labels"))
    return told.unionByName(sums.select(F.explode(F.create_map(F.lit("total_windows"), "total_windows", F.lit("missing_labels"), "missing_labels")).alias("metric", "value")))


def run_lengths(rows: DataFrame, label: str = "activity", key: str = "session") -> DataFrame:
    """Mean run length of each label with one run of one row added."""
    from strideflow.operators.timeseries import label_runs

    runs = label_runs(rows, label, key).groupBy(key, "run", label).agg(F.count("*").alias("size"))
    return runs.groupBy(label).agg(F.count("*").alias("runs"), ((F.sum("size") + 1) / (F.count("*") + 1)).alias("mean_run"))


def transition_probs(rows: DataFrame, labels: DataFrame, label: str = "activity", key: str = "session") -> DataFrame:
    """Row-normalised counts with one added for every pair of labels (``labels``: a handful of rows)."""
    names = labels.select(F.col(label).alias("source")).distinct()
    both = names.join(F.broadcast(names.withColumnRenamed("source", "target")), F.lit(True))  # labels only
    n = F.coalesce("n", F.lit(0)) + 1
    return both.join(transitions(rows, label, key), ["source", "target"], "left").select("source", "target", (n / F.sum(n).over(Window.partitionBy("source"))).alias("p"))


def sticky(probs: DataFrame, lengths: DataFrame, strength: float = 0.5, label: str = "activity") -> DataFrame:
    """Pull the diagonal towards what mean run lengths imply; scale the rest of each row to sum to 1."""
    runs = lengths.select(F.col(label).alias("source"), "mean_run")
    both = probs.join(runs, "source", "left")
    implied = F.greatest(F.lit(0.1), F.least(F.lit(0.995), (F.col("mean_run") - 1) / F.col("mean_run")))
    own = F.max(F.when(F.col("source") == F.col("target"), F.col("p"))).over(Window.partitionBy("source"))
    stay = (1 - strength) * own + strength * F.coalesce(implied, own)
    return both.select("source", "target", F.when(F.col("source") == F.col("target"), stay).otherwise(F.try_divide(F.col("p") * (1 - stay), 1 - own)).alias("p"))


def cross_coarse(probs: DataFrame, penalty: float = 1.0, groups: dict[str, str] = COARSE) -> DataFrame:
    """Damp moves between coarse groups, except to or from transitions; rows sum to 1 again."""
    a, b = coarse(F.col("source"), groups), coarse(F.col("target"), groups)
    damp = (a != b) & (a != "transition") & (b != "transition")
    p = F.when(damp, F.col("p") * F.exp(F.lit(-penalty))).otherwise(F.col("p"))
    return probs.select("source", "target", (p / F.sum(p).over(Window.partitionBy("source"))).alias("p"))


def confusion(rows: DataFrame, label: str = "activity", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, label: str = "activity", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1, support of each label; 0 where a denominator is."""
    cells = confusion(rows, label, predicted)
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    true = cells.groupBy(F.col(label).alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    said = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    both = true.join(said, "label", "full").fillna(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = both.select("label", "support", ratio(F.col("hits"), F.col("said")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"))
    return both.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(rows: DataFrame, *groups: str, label: str = "activity", predicted: str = "predicted") -> DataFrame:
    right = (F.col(label) == F.col(predicted)).cast("double")
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))
