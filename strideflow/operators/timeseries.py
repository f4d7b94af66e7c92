"""Time-series operators over long rows ``session, seq, t, x, y, z``: built-in windows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def sanitize(rows: DataFrame, key: str = "session", axes: Sequence[str] = AXES) -> DataFrame:
    """Finite rows, the first by arrival of each time, times from 0 in each series."""
    first = F.row_number().over(Window.partitionBy(key, "t").orderBy("seq"))
    rows = rows.where(finite("t", *axes)).withColumn("_n", first).where("_n = 1").drop("_n")
    return rows.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy(key)))


def gap_segments(rows: DataFrame, max_gap: float, key: str = "session") -> DataFrame:
    """A new segment after a gap of more than ``max_gap``; times start anew in each."""
    if max_gap <= 0:
        raise ValueError("max_gap must be positive")
    order = Window.partitionBy(key).orderBy("t", "seq")
    cut = F.coalesce((F.col("t") - F.lag("t").over(order) > max_gap).cast("int"), F.lit(0))
    rows = rows.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
    return rows.withColumn("t_segment", F.col("t") - F.min("t").over(Window.partitionBy(key, "segment")))


def label_runs(rows: DataFrame, label: str = "activity", key: str = "session", order_by: Sequence[str] = ("t", "seq")) -> DataFrame:
    """``run``: number of the contiguous run of equal labels, from 1; null labels equal each other."""
    order = Window.partitionBy(key).orderBy(*order_by)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(order)) | (F.row_number().over(order) == 1)).cast("int")
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def resample(rows: DataFrame, step: float, key: str = "session", axes: Sequence[str] = AXES) -> DataFrame:
    """Linear interpolation onto 0, step, 2 step, ... up to the last time and half a step; ends are held.

    Each sample makes the grid points up to the next sample, so there is no join and no explosion beyond the grid.
    """
    order = Window.partitionBy(key).orderBy("t", "seq")
    ahead = rows.select(key, "t", *axes, F.lead("t").over(order).alias("t1"), *[F.lead(a).over(order).alias(f"{a}1") for a in axes], F.max("t").over(Window.partitionBy(key)).alias("_last"))
    low = F.ceil(F.col("t") / step)
    high = F.when(F.col("t1").isNull(), F.ceil((F.col("_last") + step / 2) / step) - 1).otherwise(F.ceil(F.col("t1") / step) - 1)
    grid = ahead.where(high >= low).withColumn("i", F.explode(F.sequence(low, high)))
    share = F.when(F.col("t1").isNull(), F.lit(0.0)).otherwise((F.col("i") * step - F.col("t")) / (F.col("t1") - F.col("t")))
    return grid.select(key, "i", *[(F.col(a) + share * (F.coalesce(f"{a}1", a) - F.col(a))).alias(a) for a in axes])


def sliding_windows(rows: DataFrame, size: int, hop: int, key: str = "session") -> DataFrame:
    """Rows repeated for each full count window that covers them: ``window_index``, ``sample_index``; a partial tail is dropped."""
    order = Window.partitionBy(key).orderBy("t", "seq")
    rows = rows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / hop))
    high = F.least(F.floor(F.col("_i") / hop), F.floor((F.col("_n") - size) / hop))
    rows = rows.where((F.col("_n") >= size) & (high >= low)).withColumn("window_index", F.explode(F.sequence(low, high)))
    return rows.withColumn("sample_index", F.col("_i") - F.col("window_index") * hop).drop("_i", "_n")


def rolling_latest(rows: DataFrame, width: float, min_share: float = 0.8, min_rows: int = 2, key: str = "session") -> DataFrame:
    """For each row the closed window of ``width`` seconds that ends there: rows, span, and whether it is ready or why not."""
    micros = F.round(F.col("t") * 1e6).cast("long")  # a range frame needs whole numbers
    frame = Window.partitionBy(key).orderBy(micros).rangeBetween(-round(width * 1e6), 0)
    n, span = F.count("*").over(frame), F.col("t") - F.min("t").over(frame)
    status = F.when(n < min_rows, "insufficient-samples").when(span < min_share * width, "insufficient-time-span").otherwise("ready")
    return rows.select(key, "seq", n.alias("n"), span.alias("span"), status.alias("status"))


def durations(rows: DataFrame, low: float = 0.35, high: float = 2.0, default: float = 0.7, key: str = "session") -> DataFrame:
    """Time to the next row where positive, else the session's median step; both clamped."""
    order = Window.partitionBy(key).orderBy("t", "seq")
    rows = rows.withColumn("_d", F.lead("t").over(order) - F.col("t"))
    step = F.percentile(F.when(F.col("_d") > 0, F.col("_d")), F.lit(0.5)).over(Window.partitionBy(key))
    clamp = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    hop = clamp(F.coalesce(step, F.lit(default)))
    return rows.withColumn("duration", clamp(F.when(F.col("_d") > 0, F.col("_d")).otherwise(hop))).drop("_d")


def median_of(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2


def history_z(rows: DataFrame, metric: str, keep: int = 90, least: int = 20, key: str = "session") -> DataFrame:
    """Robust z of a metric against the ``keep`` rows before it, clipped to 4; 0 under ``least`` rows."""
    before = Window.partitionBy(key).orderBy("t", "seq").rowsBetween(-keep, -1)
    rows = rows.withColumn("_h", F.collect_list(metric).over(before))
    centre = median_of(F.col("_h"))
    rows = rows.withColumn("_c", F.when(F.size("_h") >= least, centre))
    spread = F.greatest(F.lit(1e-3), 1.4826 * median_of(F.transform("_h", lambda v: F.abs(v - F.col("_c")))))
    z = F.when(F.col("_c").isNull(), 0.0).otherwise(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col(metric) - F.col("_c")) / spread)))
    return rows.withColumn("z", z).drop("_h", "_c")


def edge_trim(rows: DataFrame, head: float = 5.0, tail: float = 15.0, least: int = 128, key: str = "session") -> DataFrame:
    """Drop the first ``head`` and last ``tail`` seconds where enough rows remain; times start anew."""
    whole = Window.partitionBy(key)
    inside = (F.col("t") >= head) & (F.col("t") <= F.max("t").over(whole) - tail)
    rows = rows.withColumn("_in", inside).withColumn("_n", F.count_if("_in").over(whole)).where((F.col("_n") < least) | F.col("_in")).drop("_in", "_n")
    return rows.withColumn("t", F.col("t") - F.min("t").over(whole))


def out_of_order(rows: DataFrame, number: str = "message_id", key: str = "session", arrival: str = "seq") -> DataFrame:
    """``out_of_order``: whether a message's number isn't above that of the message that arrived before it; such messages stay."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(arrival))
    return rows.withColumn("out_of_order", F.coalesce(F.col(number) <= before, F.lit(False)))


def tail_rows(rows: DataFrame, limit: int, key: str = "session") -> DataFrame:
    """The last ``limit`` rows of each series by arrival; all where limit is not positive."""
    if limit <= 0:
        return rows
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return rows.withColumn("_n", back).where(F.col("_n") <= limit).drop("_n")
