"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

1. Targets: sources share all words by weight; a target stops at ``most_passes`` times its source's size, and the
   excess goes to the others by weight. That fixed point is one water level, found by sorting sources by
   size/weight, so no loop is needed.
2. Every source is a stream of its documents in hash order, walked again and again until its target is met. A
   document's pass is taken where the middle of its words lies before the target, so documents stay whole.
3. A source's weight schedule is piecewise linear over training time 0..1. Its integral, scaled to the target, is the
   source's cumulative demand; the inverse at a pass's first word is that pass's training position.

Prefix sums run in two levels (4096 hash buckets in each source), so a source with a third of all rows is spread over
many tasks. Null texts have no words, null sources form the last source, repeated rows are taken like others, an empty
table gives no rows, and columns of other names are kept out of ``mix`` and carried through ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.llm.common import word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: (time, relative weight) knots; repeat over the sources as the weights do.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_passes: float = 3.0) -> DataFrame:
    """From ``source, source_size``: source, source_rank, source_size, target. One row per source throughout."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", rank.alias("source_rank"), weight.alias("weight"))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(most_passes)))
    full = Window.orderBy(F.col("most") / F.col("weight"), "source_rank")
    up_to = full.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("most").over(up_to), F.lit(0.0))) / (
        F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    # from the first source on whose level lies under its stop, every source gets level * weight
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    water = F.first(fits, ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(water * F.col("weight"), F.col("most")))
    return rows.withColumn("target", target).select("source", "source_rank", "source_size", "target")


def position(fraction: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a piecewise-linear weight schedule has spent ``fraction`` of its integral."""
    area, pieces = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((area, t0, t1, w0, w1))
        area += (t1 - t0) * (w0 + w1) / 2
    out = F.lit(None).cast("double")
    for before, t0, t1, w0, w1 in pieces:  # later pieces win
        rest, slope = fraction * area - before, (w1 - w0) / (t1 - t0)
        here = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)) - w0) / slope
        out = F.when(rest >= 0, t0 + here).otherwise(out)
    return out


def passes(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most_passes: float = 3.0, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, first position and the columns ``keep``."""
    kept = F.struct(*[docs[c] for c in keep]) if keep else F.lit(None)
    key = F.md5(F.coalesce(docs["doc_id"].cast("string"), docs["text"], F.lit("")))  # rows without an id are spread too
    rows = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), key.alias("_key"), kept.alias("_kept"))
    rows = rows.withColumn("_bucket", F.substring("_key", 1, 3))
    slim = docs.select(docs["source"], word_count(docs["text"]).alias("size"), F.substring(key, 1, 3).alias("_bucket"))
    buckets = slim.groupBy("source", "_bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    aimed = targets(sizes, weights, most_passes)
    same = lambda a, b, *names: F.lit(True) if not names else a[names[0]].eqNullSafe(b[names[0]]) & same(a, b, *names[1:])
    aimed = buckets.join(aimed, same(buckets, aimed, "source")).drop(aimed["source"])
    own = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(aimed.select(F.col("source").alias("_source"), F.col("_bucket").alias("_of"), "bucket_start", "source_size", "target", "source_rank"),
                     F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_of")))
    start = (F.col("bucket_start") + F.col("_before")).cast("double")
    copies = F.floor((F.col("target") - start - F.col("size") / 2.0) / F.col("source_size")) + 1
    copies = F.when(F.col("size") == 0, 1).otherwise(F.greatest(copies, F.lit(0))).cast("int")
    rows = rows.withColumn("_start", start).withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    return rows


def at(rows: DataFrame, nth: Column, schedules=SCHEDULES) -> Column:
    """Training position of a document's nth pass, from 0."""
    spent = F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("_start") + nth * F.col("source_size")) / F.col("target"))).otherwise(0.0)
    out = None
    for k, knots in enumerate(schedules):
        here = position(spent, knots)
        out = F.when(F.col("source_rank") % len(schedules) == k, here) if out is None else out.when(F.col("source_rank") % len(schedules) == k, here)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most_passes: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first pass; null where nothing is taken), range-sorted by position."""
    rows = passes(docs, weights, schedules, most_passes)
    first = F.when(F.col("taken") > 0, at(rows, F.lit(0), schedules))
    return rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy("position", "doc_id", "size")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most_passes: float = 3.0) -> DataFrame:
    """The documents of the mix in training order: each as often as it is taken, with all its columns."""
    rows = passes(docs, weights, schedules, most_passes, keep=docs.columns)
    rows = rows.where("copies > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.select(at(rows, F.col("_pass"), schedules).alias("_at"), "_kept")  # names of kept columns can't clash
    return rows.orderBy("_at", "_kept.doc_id").select("_kept.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (CAST(SUM(source_size) OVER () AS DOUBLE)
        - COALESCE(SUM(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT *, LEAST(most, COALESCE((SELECT min_by(level, (most / weight, r)) FROM l WHERE level * weight <= most) * weight, most)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
        CAST(COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start,
        r FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size = 0 THEN 1 ELSE GREATEST(0, floor((target - start - size / 2.0::DOUBLE) / source_size) + 1) END AS copies FROM p),
q AS (SELECT *, CAST(size * copies AS BIGINT) AS taken, LEAST(1.0::DOUBLE, start / target) AS f FROM c)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE r % 3
    WHEN 0 THEN 0.0::DOUBLE + (sqrt(GREATEST(0.0::DOUBLE, 1.5::DOUBLE * 1.5 + 2 * -1.0 * (f * 1.0 - 0.0))) - 1.5) / -1.0
    WHEN 1 THEN 0.0::DOUBLE + (f * 1.0 - 0.0) / 1.0
    ELSE CASE WHEN f * 1.0 - 0.25 >= 0 THEN 0.5::DOUBLE + (sqrt(GREATEST(0.0::DOUBLE, 0.25::DOUBLE + 2 * 4.0 * (f * 1.0 - 0.25))) - 0.5) / 4.0
              ELSE 0.0::DOUBLE + (f * 1.0 - 0.0) / 0.5 END END END AS position
FROM q
"""
