"""Session recaps: bouts of equal activity, iterative denoising, additive summaries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideflow.functions import insights
from strideflow.operators.ordered import in_order
from strideflow.operators.timeseries import durations, label_runs

#: Bouts shorter than this many seconds are noise candidates; other labels 1.2.
NOISE_SECONDS = {"run": 4.0, "stairs": 4.0, "walk": 2.5, "locomotion-other": 2.5, "transitions": 1.4}
MOVING, STILL = ("walk", "run", "stairs"), ("sit/lay", "stand")
SUMS = ("duration", "confidence_s", "quality_s", "cadence_s", "cadence_d", "postures", "folded", "windows")
COUNTS = ("postures", "folded", "windows")
STRIDE_METRES = 0.7
#: Notes of the summary.
NOTE_SPIKES = "Short locomotion spikes inside longer stationary periods were suppressed when they were not sustained."
NOTE_BLIPS = "Brief locomotion label blips, including short run or stairs segments inside or at the edges of a longer walk pattern, were merged when too short to be meaningful."


def history(rows: DataFrame) -> DataFrame:
    """Valid successful entries with a duration each. Needs session, seq, t, activity, confidence, quality, cadence (Hz).

    A column ``status`` other than success drops a row; null numbers count as 0.
    """
    valid = rows.where(F.col("activity").isNotNull() & ~F.col("activity").isin("no-data", "no-features", "unknown", "?"))
    if "status" in rows.columns:
        valid = valid.where("status = 'success'")
    return durations(valid.fillna(0.0, ["confidence", "quality", "cadence"]))


def bouts(entries: DataFrame) -> DataFrame:
    """One row per contiguous run of an activity: additive measures only, so bouts can be merged."""
    runs = label_runs(entries)
    d, steps = F.col("duration"), F.col("cadence") > 0
    posture = F.count_if("posture_change") if "posture_change" in entries.columns else F.lit(0)
    return runs.groupBy("session", "run").agg(
        F.first("activity").alias("activity"), F.sum("duration").alias("duration"), F.sum(F.col("confidence") * d).alias("confidence_s"), F.sum(F.col("quality") * d).alias("quality_s"),
        F.sum(F.when(steps, F.col("cadence") * d).otherwise(0.0)).alias("cadence_s"), F.sum(F.when(steps, d).otherwise(0.0)).alias("cadence_d"), posture.cast("long").alias("postures"), F.lit(0).cast("long").alias("folded"), F.count("*").alias("windows"),
    )


def _target(b: list[dict], k: int) -> str | None:
    """What a short bout folds into, if anything."""
    here, left, right = b[k], b[k - 1] if k else None, b[k + 1] if k + 1 < len(b) else None
    if here["duration"] > NOISE_SECONDS.get(here["activity"], 1.2):
        return None
    before, after = left and left["activity"], right and right["activity"]
    if before and before == after:
        return before
    if here["activity"] in ("run", "stairs") and {before, after} == {"walk", None}:  # at an end of the session
        return "walk"
    shaky = here["confidence_s"] / max(here["duration"], 1e-9) < 0.7 or here["quality_s"] / max(here["duration"], 1e-9) < 70
    if here["activity"] in MOVING and here["duration"] <= 2.1 and before in STILL and after in STILL and shaky:
        return before if left["duration"] >= right["duration"] else after
    return None


def _fold(bout: dict, target: str) -> None:
    bout["activity"] = target
    bout["folded"] += 1


def _merged(b: list[dict]) -> list[dict]:
    """Neighbours of equal activity as one, summed from the left."""
    out: list[dict] = []
    for x in b:
        if out and out[-1]["activity"] == x["activity"]:
            for s in SUMS:
                out[-1][s] += x[s]
        else:
            out.append(x)
    return out


def denoise_list(b: list[dict]) -> list[dict]:
    """Fold one bout at a time (inner ones from the left, then the first, then the last), merge equals, start over."""
    b = [dict(x) for x in b]
    while len(b) > 1:
        order = [*(range(1, len(b) - 1) if len(b) > 2 else [1]), 0, len(b) - 1]
        hit = next(((k, t) for k in order if (t := _target(b, k)) and t != b[k]["activity"]), None)
        if hit is None:
            break
        _fold(b[hit[0]], hit[1])
        b = _merged(b)
    return b


def _long(bout: dict) -> bool:
    """Such a bout never folds, so what stands before it and has no fold gets none later."""
    return bout["duration"] > NOISE_SECONDS.get(bout["activity"], 1.2)


def denoise_stream(bouts_in_order: Iterator[dict]) -> Iterator[dict]:
    """What ``denoise_list`` gives for bouts of which neighbours differ, holding only those since the last long one.

    Inner bouts before place k have no fold. A fold changes what its neighbours see, so the scan goes back by one. The
    first bout is settled once the second one is, and the last one at the end.
    """
    b: list[dict] = []
    k, barrier, given = 1, 0, False
    for bout in bouts_in_order:
        b.append(dict(bout))
        while k + 1 < len(b):
            target = _target(b, k)
            if target and target != b[k]["activity"]:
                _fold(b[k], target)
                at = k - (b[k - 1]["activity"] == target)
                b[k - 1 : k + 2] = _merged(b[k - 1 : k + 2])
                k = max(1, at - 1)
            else:
                barrier = max(barrier, k) if _long(b[k]) else barrier
                k += 1
        if barrier > (0 if given else 1):
            if not given and (target := _target(b, 0)):
                _fold(b[0], target)
                before, b = len(b), _merged(b)
                barrier, given = barrier - (before - len(b)), True
            yield from b[:barrier]
            b, k, barrier, given = b[barrier:], max(1, len(b) - 1 - barrier), 0, True
    if not given:
        yield from denoise_list(b)
        return
    if len(b) > 1 and (target := _target(b, len(b) - 1)):
        _fold(b[-1], target)
    yield from _merged(b)


def denoise(rows: DataFrame) -> DataFrame:
    """Denoised bouts of each session, read as a stream; only bouts that may still change are held."""
    fields = {"session": pa.int64(), "run": pa.int64(), "activity": pa.string(), **dict.fromkeys(SUMS, pa.float64()), **dict.fromkeys(COUNTS, pa.int64())}

    def run(session: int, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = enumerate(denoise_stream(bout for piece in pieces for bout in piece.to_pylist()), 1)
        while part := [bout | {"session": session, "run": n} for n, bout in islice(found, 10_000)]:
            yield pa.RecordBatch.from_pylist(part, pa.schema(list(fields.items())))

    return in_order(rows.select(*fields), ("run",), run, "session long, run long, activity string, duration double, confidence_s double, quality_s double, cadence_s double, cadence_d double, postures long, folded long, windows long")


def by_activity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session", "activity").agg(F.sum("duration").alias("seconds"), F.count("*").alias("bouts"), F.max("duration").alias("longest"), F.min("run").alias("first_run"))


def dominant(rows: DataFrame) -> DataFrame:
    """The activity with most time; the earlier bout of equals."""
    return by_activity(rows).groupBy("session").agg(F.max_by("activity", F.struct("seconds", -F.col("first_run"))).alias("dominant"))


def summary(entries: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per session over its denoised bouts (``rows``; made from the entries if not given): times, steps, distance, cadences,
    dominant activity, folded bouts, notes and text; mean and minimum quality are plain ones over all entries.

    Steps and numbers in the text go to the even neighbour at halves.
    """
    rows = denoise(bouts(entries)) if rows is None else rows
    d, of = F.col("duration"), F.col("activity")
    walk = of.isin(*MOVING)
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    when = lambda c, v=d: F.sum(F.when(c, v).otherwise(0.0))
    out = rows.groupBy("session").agg(
        F.sum(d).alias("total_seconds"), F.count("*").alias("bouts"), when(walk).alias("locomotion_seconds"), when(of.isin(*STILL)).alias("stationary_seconds"), when(of == "walk").alias("walking_seconds"),
        F.bround(F.round(F.sum("cadence_s"), 9), 0).cast("long").alias("estimated_steps"), zero(60 * F.try_divide(when(walk, F.col("cadence_s")), when(walk, F.col("cadence_d"))), "average_cadence_spm"),
        zero(F.max(F.when(walk, 60 * F.try_divide(F.col("cadence_s"), F.col("cadence_d")))), "peak_cadence_spm"), zero(F.max(F.when(of == "walk", d)), "longest_walk_bout_seconds"),
        F.sum("postures").alias("posture_change_count"), F.sum("folded").alias("noise_bouts_folded"),
    )
    quality = entries.groupBy("session").agg(F.avg("quality").alias("signal_quality_mean"), F.min("quality").alias("signal_quality_min"))
    out = out.join(dominant(rows).withColumnRenamed("dominant", "dominant_activity"), "session").join(quality, "session")
    n, s = F.col("noise_bouts_folded"), insights.whole
    folded = F.concat(F.lit("Folded "), n.cast("string"), F.lit(" brief noisy activity bout"), F.when(n != 1, "s").otherwise(""), F.lit(" into neighboring activity."))
    notes = F.array(F.when(n > 0, folded), F.when((F.col("stationary_seconds") > 0) & (F.col("locomotion_seconds") > 0), NOTE_SPIKES), F.when(F.col("walking_seconds") > 0, NOTE_BLIPS))
    said = F.concat(F.lit("Mostly "), F.replace("dominant_activity", F.lit("-"), F.lit(" ")), F.lit(" over "), s(F.col("total_seconds")), F.lit("s. Walking "), s(F.col("walking_seconds")), F.lit("s, stationary "),
                    s(F.col("stationary_seconds")), F.lit("s, about "), F.col("estimated_steps").cast("string"), F.lit(" steps at "), s(F.col("average_cadence_spm")), F.lit(" SPM average."))
    return out.withColumns({"estimated_distance_m": F.col("estimated_steps") * STRIDE_METRES, "notes": F.filter(notes, lambda x: x.isNotNull()), "summary_text": said})


def session_recap(rows: DataFrame, hop: float = 1.28) -> DataFrame:
    """Rolling totals of a live session from its window insights (session, t, seq, activity and what ``insights.window_insights`` gives)."""
    if hop <= 0:
        raise ValueError("the hop must be positive")
    order = Window.partitionBy("session").orderBy("t", "seq")
    changed = lambda c: F.coalesce(F.lag(c).over(order) != F.col(c), F.lit(False))
    rows = rows.withColumns({"_levels": changed("intensity_level"), "_places": changed("phone_orientation"), "_group": insights.group_of(F.coalesce("activity", F.lit("unknown")))})
    time = lambda c: (F.count_if(c) * hop)
    level, group, walking = F.col("intensity_level"), F.col("_group"), F.col("cadence_spm") > 0
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.groupBy("session").agg(
        F.count("*").alias("windows"), time(level != "still").alias("active_seconds"), time(level == "still").alias("still_seconds"), time(level.isin("moderate", "high")).alias("moderate_or_higher_seconds"),
        time(level == "high").alias("high_seconds"), time(group == "locomotion").alias("locomotion_seconds"), time(group == "static").alias("static_seconds"), time(F.col("activity") == "walk").alias("_walk"),
        F.max("intensity_ratio").alias("peak_intensity_ratio"), F.max("cadence_spm").alias("peak_cadence_spm"), F.max("ground_impact_score").alias("peak_impact_score"),
        zero(F.avg(F.when(walking, F.col("cadence_spm")))).alias("cadence_mean_spm"), zero(F.avg(F.when(walking, F.col("cadence_consistency_pct")))).alias("cadence_consistency_mean_pct"),
        F.avg("smoothness_score").alias("smoothness_mean_score"), F.avg("signal_quality_score").alias("signal_quality_mean"), F.least(F.lit(100.0), F.min("signal_quality_score")).alias("signal_quality_min"),
        zero(F.avg(F.when(group == "static", F.col("posture_stability_score")))).alias("avg_posture_stability"), F.count_if("_levels").alias("transition_count"), F.count_if("_places").alias("phone_reposition_count"),
        F.count_if("burst_detected").alias("burst_count"), F.count_if("posture_change_detected").alias("posture_change_count"),
    )
    steps = F.when(F.col("_walk") > 0, F.bround(F.round(F.col("cadence_mean_spm") * F.col("locomotion_seconds") / 60, 9), 0)).otherwise(0).cast("long")
    out = out.withColumn("estimated_steps", steps).withColumn("estimated_distance_m", F.col("estimated_steps") * STRIDE_METRES).drop("_walk")
    counts = rows.groupBy("session", F.coalesce("activity", F.lit("unknown")).alias("activity")).agg(F.count("*").alias("n"), F.min(F.struct("t", "seq")).alias("first"))
    common = counts.groupBy("session").agg(F.max_by("activity", F.struct("n", -F.col("first.t"), -F.col("first.seq"))).alias("most_common_activity"))
    return out.join(common, "session")


def activity_log(rows: DataFrame) -> DataFrame:
    """session, window_index (from 1), from_activity, to_activity: where the activity differs from the window before."""
    order = Window.partitionBy("session").orderBy("t", "seq")
    told = rows.select("session", F.row_number().over(order).cast("long").alias("window_index"), F.lag("activity").over(order).alias("from_activity"), F.col("activity").alias("to_activity"))
    return told.where("from_activity <> to_activity")


def changes(rows: DataFrame, column: str = "activity") -> DataFrame:
    """How often a value differs from the row before, per session."""
    order = Window.partitionBy("session").orderBy("t", "seq")
    before = F.lag(column).over(order)
    return rows.withColumn("_c", (before.isNotNull() & (before != F.col(column))).cast("long")).groupBy("session").agg(F.sum("_c").alias("changes"), F.count("*").alias("windows"))
