"""Temporal decoding of label probabilities by a causal hidden Markov model: one pass over each session in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from strideflow.operators.ordered import in_order


def _normal(p: np.ndarray) -> np.ndarray:
    """Values from 1e-12 to 1 that sum to 1; missing ones count as 1."""
    clipped = np.where(np.isnan(p), 1.0, np.clip(p, 1e-12, 1.0))
    return clipped / clipped.sum()


def decode(rows: DataFrame, init: list[float], trans: list[list[float]], probs: str = "probs", key: str = "session") -> DataFrame:
    """session, seq, posterior, label_index: forward filtering in order of (t, seq); ties go to the first label.

    A session is read as a stream that carries one posterior. After null probabilities its posteriors are null.
    """
    start, matrix = np.array(init, float), np.array(trans, float)

    def run(_: object, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = start
        for piece in pieces:
            posteriors, labels = [], []
            for p in piece.column("_p").to_pylist():
                new = None if prior is None or p is None else _normal(prior * _normal(np.array(p, float)))
                posteriors.append(None if new is None else new.tolist())
                labels.append(None if new is None else int(new.argmax()))
                prior = None if new is None else new @ matrix
            yield pa.RecordBatch.from_arrays([piece.column(key), piece.column("seq"), pa.array(posteriors, pa.list_(pa.float64())), pa.array(labels, pa.int32())], [key, "seq", "posterior", "label_index"])

    rows = rows.select(key, "t", F.col("seq").cast("bigint").alias("seq"), F.col(probs).cast("array<double>").alias("_p"))
    schema = rows.select(key, "seq").schema.add("posterior", ArrayType(DoubleType())).add("label_index", IntegerType())
    return in_order(rows, ("t", "seq", "_p"), run, schema, key)


def reset_runs(rows: DataFrame, mode: str = "session", gap: float = 0.0, key: str = "session", start: str = "start", end: str = "end") -> DataFrame:
    """``gap_ms`` (a positive gap to the window before, else null) and ``run``, a number that grows where the decoder starts anew.

    Modes: per-window, per-gap (a gap over ``gap`` seconds; none where that is 0) and session; unknown ones count as session.
    Decode by (key, run). Windows are taken in order of (start, seq).
    """
    mode = mode.strip().lower()
    order = Window.partitionBy(key).orderBy(start, "seq")
    space = F.col(start) - F.lag(end).over(order)
    rows = rows.withColumn("gap_ms", F.when(space > 0, space * 1000))
    anew = F.lit(mode == "per-window") | (F.coalesce(F.col("gap_ms") > gap * 1000, F.lit(False)) & F.lit(mode == "per-gap" and gap > 0))
    first = F.row_number().over(order) == 1
    return rows.withColumn("_new", (anew & ~first).cast("long")).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def top_k(probs: dict[str, Column], k: int = 3) -> Column:
    """The k likeliest labels with their probabilities; equals by the later label first."""
    pairs = F.array(*[F.struct(c.alias("p"), F.lit(i).alias("i"), F.lit(n).alias("label")) for i, (n, c) in enumerate(probs.items())])
    return F.slice(F.sort_array(pairs, asc=False), 1, k)


def refine_static(probs: dict[str, Column], specialist: dict[str, Column], gate: float = 0.35, blend: float = 0.6) -> dict[str, Column]:
    """Blend a specialist's view into the static labels where they hold enough mass; that mass is kept."""
    mass = sum((probs[n] for n in specialist), F.lit(0.0))
    out = {n: F.when(mass >= gate, (1 - blend) * probs[n] + blend * mass * specialist[n]).otherwise(probs[n]) if n in specialist else c for n, c in probs.items()}
    whole = sum(out.values(), F.lit(0.0))
    return {n: c / whole for n, c in out.items()}


def hierarchical(coarse: dict[str, Column], fine: dict[str, dict[str, Column]], groups: dict[str, list[str]]) -> dict[str, Column]:
    """Coarse mass times the group's fine probabilities; a group without a fine model shares evenly. Rows sum to 1."""
    out = {n: coarse[g] * (fine[g][n] if g in fine else F.lit(1.0 / len(names))) for g, names in groups.items() for n in names}
    whole = sum(out.values(), F.lit(0.0))
    return {n: F.try_divide(c, whole) for n, c in out.items()}
