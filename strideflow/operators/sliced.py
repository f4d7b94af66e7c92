"""Ordered work over sessions too long for one task: slices of a session are worked on side by side, what passes from one
to the next is carried over in a table with one row a slice.

``add_slices`` cuts long sessions by time. ``previous`` and ``running_sum`` are a window's lag and cumulative sum over such rows;
label runs, gap segments and row numbers are made of them, here and in ``timeseries`` where rows have slices. ``file_rows`` numbers rows in
the order of their files, whose slices are ranges of row numbers, whatever the splits are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from strideflow.operators import decode
from strideflow.operators.ordered import in_order
from strideflow.sources.shared import checkpointed

SLICE, SIZE, CUTS = "_slice", 1_000_000, 256


def add_slices(rows: DataFrame, key: str = "session", by: str = "t", size: int = SIZE, cuts: int = CUTS) -> DataFrame:
    """``_slice``: 0 for sessions of at most ``size`` rows; others are cut at quantiles of ``by`` into at most ``cuts`` + 1 slices.

    Equal times stay in one slice; null times come first. There are fewer long sessions than rows / size: their cuts are sent to all tasks.
    """
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    long = rows.join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    shares = F.array(*[F.lit(k / (cuts + 1)) for k in range(1, cuts + 1)])
    borders = long.groupBy(F.col(key).alias("_key"), F.lit(True).alias("_long")).agg(F.percentile_approx(by, shares, 10_000).alias("_cuts"))
    place = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(by)))
    joined = rows.join(F.broadcast(borders), F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(SLICE, F.when(F.col("_long") & F.col(by).isNotNull(), place).otherwise(0).cast("int")).drop("_key", "_long", "_cuts")


def _windows(key: Sequence[str], order_by: Sequence[str]):
    own = Window.partitionBy(*key, SLICE).orderBy(*order_by)
    return own, own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key).orderBy(SLICE)


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows joined to what is carried into their slice; null keys equal each other."""
    named = right.select(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate((*key, SLICE))], *[c for c in right.columns if c not in (*key, SLICE)])
    on = [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate((*key, SLICE))]
    both = on[0]
    for c in on[1:]:
        both = both & c
    return left.join(named, both).drop(*[f"_of_{k}" for k in range(len(on))])


def previous(rows: DataFrame, columns: dict[str, str], key: Sequence[str] = ("session",), order_by: Sequence[str] = ("t", "seq")) -> DataFrame:
    """Columns (new name -> old) of the row before, null at a session's first row, and ``_first``: whether it is that."""
    own, _, slices = _windows(key, order_by)
    packed = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    rows = rows.withColumn("_n", F.row_number().over(own)).withColumn("_before", F.lag(packed).over(own))
    ends = rows.groupBy(*key, SLICE).agg(F.max_by(packed, "_n").alias("_end"))
    carried = ends.select(*key, SLICE, F.lag("_end").over(slices).alias("_carried"), (F.row_number().over(slices) == 1).alias("_opens"))
    rows = _same(rows, carried, key)
    before = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return rows.withColumns({new: before[new] for new in columns} | {"_first": (F.col("_n") == 1) & F.col("_opens")}).drop("_n", "_before", "_carried", "_opens")


def running_sum(rows: DataFrame, value: Column, name: str, key: Sequence[str] = ("session",), order_by: Sequence[str] = ("t", "seq")) -> DataFrame:
    """The sum of a value over a session's rows up to each row."""
    _, so_far, slices = _windows(key, order_by)
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*key, SLICE).agg(F.sum("_value").alias("_sum"))
    carried = sums.select(*key, SLICE, (F.sum("_sum").over(slices.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_base"))
    return _same(rows, carried, key).withColumn(name, F.col("_base") + F.sum("_value").over(so_far)).drop("_value", "_base")


def runs(rows: DataFrame, value: str, name: str = "run", key: Sequence[str] = ("session",), order_by: Sequence[str] = ("t", "seq")) -> DataFrame:
    """``run``: number of the contiguous run of equal values, from 1; nulls equal each other."""
    rows = previous(rows, {"_was": value}, key, order_by)
    new = (F.col("_first") | ~F.col(value).eqNullSafe(F.col("_was"))).cast("long")
    return running_sum(rows, new, name, key, order_by).drop("_was", "_first")


def segments(rows: DataFrame, max_gap: float, key: Sequence[str] = ("session",)) -> DataFrame:
    """``segment`` (from 0): a new one after a gap of more than ``max_gap``; ``t_segment``: times from 0 in each.

    A segment's own start is carried as its smallest time, added up before the shuffle.
    """
    if max_gap <= 0:
        raise ValueError("max_gap must be positive")
    rows = previous(rows, {"_was": "t"}, key).withColumn("_cut", F.coalesce((F.col("t") - F.col("_was") > max_gap).cast("long"), F.lit(0)))
    rows = running_sum(rows, F.col("_cut"), "segment", key).drop("_was", "_cut", "_first")
    own = Window.partitionBy(*key, SLICE, "segment")
    starts = rows.groupBy(*key, SLICE, "segment").agg(F.min("t").alias("_low"))
    over = starts.select(*key, SLICE, "segment", F.min("_low").over(Window.partitionBy(*key, "segment")).alias("_start"))
    first = over.groupBy(*key, SLICE).agg(F.min_by("_start", "segment").alias("_start"), F.min("segment").alias("_open"))
    rows = _same(rows, first, key)
    start = F.when(F.col("segment") == F.col("_open"), F.col("_start")).otherwise(F.min("t").over(own))
    return rows.withColumn("t_segment", F.col("t") - start).drop("_start", "_open")


# --- rows in the order of their files -----------------------------------------------------------------------------


def file_rows(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """The rows of Parquet files with ``path``, ``row`` (the place in the file) and slices of ``size`` rows."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")).withColumn(SLICE, F.floor(F.col("row") / size).cast("int"))


def contiguous_sessions(rows: DataFrame, ident: str) -> DataFrame:
    """``run``: rows of one id that follow one another in a file are a session; an id that comes again begins another."""
    return runs(rows, ident, "run", ("path",), ("row",))


def whole_windows(rows: DataFrame, size: int = 128, axes: Sequence[str] = ("acc_x", "acc_y", "acc_z"), ident: str = "global_window_id", keep: Sequence[str] = ()) -> DataFrame:
    """Contract windows from rows in file order: runs of one window id with exactly ``size`` rows, as arrays in file order.

    An id that comes again in a file, or stands in two files, is a window of its own each time.
    """
    grouped = contiguous_sessions(rows, ident).groupBy("path", "run", ident, *keep).agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("row", *axes))).alias("_s"))
    return grouped.where(F.col("_n") == size).select("path", "run", ident, *keep, *[F.col(f"_s.{a}").alias(a) for a in axes])


# --- decoding ---------------------------------------------------------------------------------------------------------


def decode_slices(rows: DataFrame, init: list[float], trans: list[list[float]], probs: str = "probs", key: str = "session") -> DataFrame:
    """What ``decode.decode`` gives, for rows with slices: session, seq, posterior, label_index.

    A slice's effect on what comes in is linear up to scale: a matrix, the product of its emissions and transitions. These are
    made for all slices side by side, carried through each session's slices in order, and every slice is decoded from its own
    start. Needs positive transitions; clipping at 1e-12 within a matrix is left out, which moves starts by that order.
    """
    matrix, k = np.array(trans, float), len(init)
    if matrix.min() <= 0:
        raise ValueError("decoding by slices needs positive transitions")
    rows = rows.select(F.col(key), "t", F.col("seq").cast("long").alias("seq"), SLICE, F.col(probs).cast("array<double>").alias("_p"))
    schema = rows.select(key, SLICE).schema
    part = F.struct(key, SLICE).alias("_part")

    def products(_: object, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last = np.eye(k), None
        for piece in pieces:
            last = piece
            for p in piece.column("_p").to_pylist():
                if made is not None:
                    made = None if p is None else (made * decode._normal(np.array(p, float))) @ matrix
                    made = None if made is None else made / made.max()
        flat = pa.array([None if made is None else made.ravel().tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([last.column(key).slice(0, 1), last.column(SLICE).slice(0, 1), flat], [key, SLICE, "_m"])

    many = rows.select(key, SLICE).distinct().groupBy(F.col(key).alias("_key")).agg(F.max(SLICE).alias("_last")).where("_last > 0")
    cut = rows.join(F.broadcast(many), F.col(key).eqNullSafe(F.col("_key")), "left_semi")  # fewer long sessions than rows / size
    effects = in_order(cut.withColumn("_part", part), ("t", "seq", "_p"), products, schema.add("_m", ArrayType(DoubleType())), "_part")

    def starts(_: object, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = np.array(init, float)
        for piece in pieces:
            out = []
            for m in piece.column("_m").to_pylist():
                out.append(None if now is None else now.tolist())
                now = None if now is None or m is None else decode._normal(now @ np.array(m, float).reshape(k, k))
            yield pa.RecordBatch.from_arrays([piece.column(key), piece.column(SLICE), pa.array(out, pa.list_(pa.float64()))], [key, SLICE, "_start"])

    begin = checkpointed(in_order(checkpointed(effects), (SLICE,), starts, rows.select(key, SLICE).schema.add("_start", ArrayType(DoubleType())), key))
    begin = begin.withColumn("_known", F.lit(True)).select(F.col(key).alias("_key"), F.col(SLICE).alias("_of"), "_start", "_known")
    ready = rows.join(F.broadcast(begin), F.col(key).eqNullSafe(F.col("_key")) & (F.col(SLICE) == F.col("_of")), "left").drop("_key", "_of").withColumn("_part", part)

    def run(_: object, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, begun = np.array(init, float), False
        for piece in pieces:
            if not begun and piece.column("_known")[0].as_py():
                start = piece.column("_start")[0].as_py()
                prior = None if start is None else np.array(start, float)
            begun, posteriors, labels = True, [], []
            for p in piece.column("_p").to_pylist():
                new = None if prior is None or p is None else decode._normal(prior * decode._normal(np.array(p, float)))
                posteriors.append(None if new is None else new.tolist())
                labels.append(None if new is None else int(new.argmax()))
                prior = None if new is None else new @ matrix
            yield pa.RecordBatch.from_arrays([piece.column(key), piece.column("seq"), pa.array(posteriors, pa.list_(pa.float64())), pa.array(labels, pa.int32())], [key, "seq", "posterior", "label_index"])

    schema = rows.select(key, "seq").schema.add("posterior", ArrayType(DoubleType())).add("label_index", IntegerType())
    return in_order(ready, ("t", "seq", "_p"), run, schema, "_part")
