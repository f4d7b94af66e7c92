"""The query catalogue: each query applies an operator to whole tables; its SQL, where SQL can express it, stands beside it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideflow.functions import guards, insights
from strideflow.functions import signal as S
from strideflow.operators import boosting, bundle, decode, evaluation, recap, sliced, timeseries, training, tuning
from strideflow.sources.recordings import synthetic_time
from strideflow.sources.shared import new_path
from strideflow.sources.views import ACTIVITIES, LABELS, SCORED_SQL, SENSOR_SQL, scored, sensor, signals, table
from strideflow.streaming import live, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR = 3600.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- time series -------------------------------------------------------------------------------

CLEAN_SQL = f"""WITH {SENSOR_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY session, t ORDER BY seq) AS n FROM sensor WHERE t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
clean AS (SELECT session, seq, t - min(t) OVER (PARTITION BY session) AS t, x, y, z, activity FROM first WHERE n = 1)"""


def clean(spark, sf):
    return timeseries.sanitize(sensor(spark, sf))


@query("sanitize_dedupe", CLEAN_SQL + " SELECT session, seq, round(t, 4) AS t, x, y, z FROM clean")
def _(spark, sf):
    return clean(spark, sf).select("session", "seq", r("t", 4).alias("t"), "x", "y", "z")


GAPS_SQL = CLEAN_SQL + """, cut AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t, seq) > 86400 THEN 1 ELSE 0 END AS c FROM clean),
seg AS (SELECT *, sum(c) OVER (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS segment FROM cut)"""


@query("gap_segments", GAPS_SQL + " SELECT session, CAST(segment AS BIGINT) AS segment, count(*) AS n, round(max(t) - min(t), 4) AS span FROM seg GROUP BY 1, 2")
def _(spark, sf):
    rows = timeseries.gap_segments(clean(spark, sf), 24 * HOUR)
    return rows.groupBy("session", "segment").agg(F.count("*").alias("n"), r(F.max("t_segment"), 4).alias("span"))


RUNS_SQL = CLEAN_SQL + """, new AS (SELECT *, CASE WHEN activity IS DISTINCT FROM lag(activity) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM clean WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
runs AS (SELECT *, CAST(sum(c) OVER (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM new)"""


@query("label_runs", RUNS_SQL + " SELECT session, run, activity, count(*) AS n, min(seq) AS first_seq FROM runs GROUP BY 1, 2, 3")
def _(spark, sf):
    return timeseries.label_runs(clean(spark, sf)).groupBy("session", "run", "activity").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("resample_grid", CLEAN_SQL + """, a AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1, max(t) OVER (PARTITION BY session) AS last FROM clean WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
g AS (SELECT session, unnest(range(0, CAST(ceil((max(t) + 21600) / 43200) AS BIGINT))) AS i FROM clean GROUP BY session)
SELECT g.session, g.i, round(CASE WHEN t1 IS NULL THEN x ELSE x + (g.i * 43200.0::DOUBLE - t) / (t1 - t) * (x1 - x) END, 4) AS x
FROM g JOIN a ON g.session = a.session AND g.i * 43200 >= t AND (t1 IS NULL OR g.i * 43200 < t1)""")
def _(spark, sf):
    return timeseries.resample(clean(spark, sf), 12 * HOUR, axes=("x",)).select("session", "i", r("x", 4).alias("x"))


@query("sliding_windows", CLEAN_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM clean),
w AS (SELECT session, x, i, unnest(range(CAST(greatest(0, ceil((i - 31) / 16.0)) AS BIGINT), CAST(least(i // 16, (n - 32) // 16) AS BIGINT) + 1)) AS window_index FROM n WHERE n >= 32)
SELECT session, window_index, count(*) AS n, round(avg(x), 8) AS mean_x, round(sum((i - window_index * 16) * x), 3) AS weighted FROM w GROUP BY 1, 2""")
def _(spark, sf):
    rows = timeseries.sliding_windows(clean(spark, sf), 32, 16)
    return rows.groupBy("session", "window_index").agg(F.count("*").alias("n"), r(F.avg("x"), 8).alias("mean_x"), r(F.sum(F.col("sample_index") * F.col("x")), 3).alias("weighted"))


@query("rolling_latest", CLEAN_SQL + """, w AS (SELECT session, seq, count(*) OVER f AS n, t - min(t) OVER f AS span FROM clean WINDOW f AS (PARTITION BY session ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
SELECT session, seq, n, round(span, 4) AS span, CASE WHEN n < 2 THEN 'insufficient-samples' WHEN span < 0.8 * 86400 THEN 'insufficient-time-span' ELSE 'ready' END AS status FROM w""")
def _(spark, sf):
    return timeseries.rolling_latest(clean(spark, sf), 24 * HOUR).withColumn("span", r("span", 4))


DUR_SQL = CLEAN_SQL + """, d AS (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t, seq) - t AS d FROM clean),
dur AS (SELECT *, greatest(600, least(36000, CASE WHEN d > 0 THEN d ELSE greatest(600, least(36000, coalesce(quantile_cont(CASE WHEN d > 0 THEN d END, 0.5) OVER (PARTITION BY session), 700))) END)) AS duration FROM d)"""


@query("interarrival_duration", DUR_SQL + " SELECT session, seq, round(duration, 4) AS duration FROM dur")
def _(spark, sf):
    return timeseries.durations(clean(spark, sf), 600.0, 36000.0, 700.0).select("session", "seq", r("duration", 4).alias("duration"))


@query("metric_history_z", CLEAN_SQL + """, h AS (SELECT *, list(x) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS h FROM clean),
c AS (SELECT *, CASE WHEN len(h) >= 20 THEN list_median(h) END AS c FROM h)
SELECT session, seq, round(CASE WHEN c IS NULL THEN 0 ELSE greatest(-4, least(4, (x - c) / greatest(1e-3, 1.4826 * list_median(list_transform(h, lambda v: abs(v - c)))))) END, 4) AS z FROM c""")
def _(spark, sf):
    return timeseries.history_z(clean(spark, sf), "x").select("session", "seq", r("z", 4).alias("z"))


@query("edge_trim", CLEAN_SQL + """, i AS (SELECT *, t >= 86400 AND t <= max(t) OVER (PARTITION BY session) - 172800 AS ins FROM clean),
k AS (SELECT *, count(*) FILTER (WHERE ins) OVER (PARTITION BY session) AS n FROM i)
SELECT session, count(*) AS n, round(max(t) - min(t), 3) AS span FROM k WHERE n < 32 OR ins GROUP BY 1""")
def _(spark, sf):
    return timeseries.edge_trim(clean(spark, sf), 24 * HOUR, 48 * HOUR, 32).groupBy("session").agg(F.count("*").alias("n"), r(F.max("t"), 3).alias("span"))


@query("raw_point_tail", f"WITH {SENSOR_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM sensor) SELECT session, seq, x FROM n WHERE n <= 10")
def _(spark, sf):
    return timeseries.tail_rows(sensor(spark, sf), 10).select("session", "seq", "x")


# --- bouts and recaps --------------------------------------------------------------------------

ENTRY_SQL = CLEAN_SQL.replace("clean AS (SELECT", "clean0 AS (SELECT") + """, clean AS (SELECT *, (seq % 10) / 10.0::DOUBLE AS confidence, y AS quality, CASE WHEN activity IN ('walk', 'run') THEN z / 4 ELSE 0 END AS cadence FROM clean0 WHERE activity IS NOT NULL),
d AS (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY t, seq) - t AS d FROM clean),
dur AS (SELECT *, greatest(0.35, least(2, CASE WHEN d > 0 THEN d ELSE greatest(0.35, least(2, coalesce(quantile_cont(CASE WHEN d > 0 THEN d END, 0.5) OVER (PARTITION BY session), 0.7))) END)) AS duration FROM d),
new AS (SELECT *, CASE WHEN activity IS DISTINCT FROM lag(activity) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM dur WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
runs AS (SELECT *, CAST(sum(c) OVER (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM new),
bouts AS (SELECT session, run, activity, sum(duration) AS duration, sum(confidence * duration) AS confidence_s, sum(quality * duration) AS quality_s, sum(cadence * duration) AS cadence_s, count(*) AS windows FROM runs GROUP BY 1, 2, 3)"""


def entries(spark, sf):
    cadence = F.when(F.col("activity").isin("walk", "run"), F.col("z") / 4).otherwise(0.0)
    return recap.history(clean(spark, sf).withColumn("confidence", F.col("seq") % 10 / F.lit(10.0)).withColumn("quality", F.col("y")).withColumn("cadence", cadence))


@query("bout_summary", ENTRY_SQL + " SELECT session, run, activity, round(duration, 4) AS duration, round(confidence_s, 4) AS confidence_s, round(quality_s, 3) AS quality_s, round(cadence_s, 4) AS cadence_s, windows FROM bouts")
def _(spark, sf):
    return recap.bouts(entries(spark, sf)).select("session", "run", "activity", r("duration", 4).alias("duration"), r("confidence_s", 4).alias("confidence_s"), r("quality_s", 3).alias("quality_s"), r("cadence_s", 4).alias("cadence_s"), "windows")


@query("time_by_activity", ENTRY_SQL + " SELECT session, activity, round(sum(duration), 4) AS seconds, count(*) AS bouts, round(max(duration), 4) AS longest, min(run) AS first_run FROM bouts GROUP BY 1, 2")
def _(spark, sf):
    return recap.by_activity(recap.bouts(entries(spark, sf))).withColumn("seconds", r("seconds", 4)).withColumn("longest", r("longest", 4))


def told(rows: DataFrame) -> DataFrame:
    """A summary's columns, rounded."""
    seconds = ("total_seconds", "locomotion_seconds", "stationary_seconds", "walking_seconds", "longest_walk_bout_seconds")
    means = ("average_cadence_spm", "peak_cadence_spm", "signal_quality_mean", "signal_quality_min")
    return rows.select("session", "bouts", "estimated_steps", r("estimated_distance_m", 3).alias("estimated_distance_m"), *[r(c, 3).alias(c) for c in seconds], *[r(c, 8).alias(c) for c in means], "noise_bouts_folded", "dominant_activity", "notes", "summary_text")


@query("session_summary")
def _(spark, sf):
    """Summaries of denoised sessions; ``raw_bout_summary`` holds the same sums against SQL without the denoising."""
    own = told(recap.summary(entries(spark, sf)))
    return own.withColumn("notes", F.concat_ws(" ", "notes"))


@query("raw_bout_summary", ENTRY_SQL + """, q AS (SELECT session, avg(quality) AS qm, min(quality) AS ql FROM dur GROUP BY 1),
cad AS (SELECT session, run, activity, duration, cadence_s, (SELECT coalesce(sum(duration) FILTER (WHERE cadence > 0), 0) FROM runs r WHERE r.session = b.session AND r.run = b.run) AS cadence_d FROM bouts b),
a AS (SELECT session, count(*) AS bouts, CAST(round_even(round(sum(cadence_s), 9), 0) AS BIGINT) AS steps, sum(duration) AS total, sum(duration) FILTER (WHERE activity IN ('walk', 'run', 'stairs')) AS moving, sum(duration) FILTER (WHERE activity IN ('sit/lay', 'stand')) AS still,
  sum(duration) FILTER (WHERE activity = 'walk') AS walking, max(duration) FILTER (WHERE activity = 'walk') AS longest, sum(cadence_s) FILTER (WHERE activity IN ('walk', 'run', 'stairs')) AS cs, sum(cadence_d) FILTER (WHERE activity IN ('walk', 'run', 'stairs')) AS cd,
  max(CASE WHEN cadence_d > 0 THEN 60 * cadence_s / cadence_d END) FILTER (WHERE activity IN ('walk', 'run', 'stairs')) AS peak FROM cad GROUP BY 1),
m AS (SELECT session, arg_max(activity, (s, -f)) AS dominant FROM (SELECT session, activity, sum(duration) AS s, min(run) AS f FROM bouts GROUP BY 1, 2) GROUP BY 1)
SELECT session, bouts, steps AS estimated_steps, round(steps * 0.7::DOUBLE, 3) AS estimated_distance_m, round(total, 3) AS total_seconds, round(coalesce(moving, 0), 3) AS locomotion_seconds, round(coalesce(still, 0), 3) AS stationary_seconds, round(coalesce(walking, 0), 3) AS walking_seconds,
round(coalesce(longest, 0), 3) AS longest_walk_bout_seconds, round(coalesce(CASE WHEN cd > 0 THEN 60 * cs / cd END, 0), 8) AS average_cadence_spm, round(coalesce(peak, 0), 8) AS peak_cadence_spm, round(qm, 8) AS signal_quality_mean, round(ql, 8) AS signal_quality_min, dominant AS dominant_activity
FROM a JOIN q USING (session) JOIN m USING (session)""")
def _(spark, sf):
    rows = entries(spark, sf)
    return told(recap.summary(rows, recap.bouts(rows))).drop("noise_bouts_folded", "notes", "summary_text")


@query("dominant_activity")
def _(spark, sf):
    return recap.dominant(recap.denoise(recap.bouts(entries(spark, sf))))


@query("denoise_bouts")
def _(spark, sf):
    return recap.denoise(recap.bouts(entries(spark, sf)))


@query("activity_changes", CLEAN_SQL + ", l AS (SELECT session, activity, lag(activity) OVER (PARTITION BY session ORDER BY t, seq) AS b FROM clean) SELECT session, CAST(sum(CASE WHEN b IS NOT NULL AND b <> activity THEN 1 ELSE 0 END) AS BIGINT) AS changes, count(*) AS windows FROM l GROUP BY 1")
def _(spark, sf):
    return recap.changes(clean(spark, sf))


@query("recap_aggregates", CLEAN_SQL + """ SELECT session, count(*) AS windows, round(1.28 * sum(CASE WHEN activity IN ('walk', 'run') THEN 1 ELSE 0 END), 4) AS moving_s, round(max(x), 4) AS peak, round(least(100, min(y)), 4) AS low_quality,
round(avg(CASE WHEN z > 0 THEN z END), 8) AS mean_cadence, CAST(count(CASE WHEN x > 15 THEN 1 END) AS BIGINT) AS bursts FROM clean GROUP BY 1""")
def _(spark, sf):
    moving = F.col("activity").isin("walk", "run")
    return clean(spark, sf).groupBy("session").agg(
        F.count("*").alias("windows"), r(1.28 * F.sum(F.when(moving, 1).otherwise(0)), 4).alias("moving_s"), r(F.max("x"), 4).alias("peak"), r(F.least(F.lit(100.0), F.min("y")), 4).alias("low_quality"),
        r(F.avg(F.when(F.col("z") > 0, F.col("z"))), 8).alias("mean_cadence"), F.count_if(F.col("x") > 15).alias("bursts"),
    )


# --- transition statistics, weights, evaluation -------------------------------------------------

TRANS_SQL = CLEAN_SQL + """, p AS (SELECT lag(activity) OVER (PARTITION BY session ORDER BY t, seq) AS source, activity AS target FROM clean),
trans AS (SELECT source, target, count(*) AS n FROM p WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2),
names AS (SELECT DISTINCT activity AS a FROM clean),
probs AS (SELECT s.a AS source, g.a AS target, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY s.a)::DOUBLE AS p FROM names s CROSS JOIN names g LEFT JOIN trans ON source = s.a AND target = g.a),
new AS (SELECT *, CASE WHEN activity IS DISTINCT FROM lag(activity) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM clean WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
runs AS (SELECT *, sum(c) OVER (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS run FROM new),
rl AS (SELECT activity, count(*) AS runs, (sum(k) + 1) / (count(*) + 1.0::DOUBLE) AS mean_run FROM (SELECT session, run, activity, count(*) AS k FROM runs GROUP BY 1, 2, 3) GROUP BY 1),
own AS (SELECT probs.*, max(CASE WHEN source = target THEN p END) OVER (PARTITION BY source) AS own, 0.5 * max(CASE WHEN source = target THEN p END) OVER (PARTITION BY source) + 0.5 * greatest(0.1, least(0.995, (mean_run - 1) / mean_run)) AS stay FROM probs JOIN rl ON rl.activity = source),
sticky AS (SELECT source, target, CASE WHEN source = target THEN stay ELSE p * (1 - stay) / (1 - own) END AS p FROM own),
grp AS (SELECT *, CASE WHEN source IN ('walk', 'run', 'stairs') THEN 'l' WHEN source IN ('sit', 'lay', 'stand') THEN 's' WHEN source = 'transitions' THEN 't' ELSE 'o' END AS a,
  CASE WHEN target IN ('walk', 'run', 'stairs') THEN 'l' WHEN target IN ('sit', 'lay', 'stand') THEN 's' WHEN target = 'transitions' THEN 't' ELSE 'o' END AS b FROM sticky),
damp AS (SELECT source, target, CASE WHEN a <> b AND a <> 't' AND b <> 't' THEN p * exp(-1.0) ELSE p END AS p FROM grp)"""


@query("transition_counts", TRANS_SQL + " SELECT * FROM trans")
def _(spark, sf):
    return evaluation.transitions(clean(spark, sf))


@query("run_lengths", TRANS_SQL + " SELECT activity, runs, round(mean_run, 6) AS mean_run FROM rl")
def _(spark, sf):
    return evaluation.run_lengths(clean(spark, sf)).withColumn("mean_run", r("mean_run"))


def _probs(spark, sf):
    rows = clean(spark, sf)
    return evaluation.transition_probs(rows, rows.select("activity").distinct())


@query("transition_probs", TRANS_SQL + " SELECT source, target, round(p, 6) AS p FROM probs")
def _(spark, sf):
    return _probs(spark, sf).withColumn("p", r("p"))


@query("sticky_probs", TRANS_SQL + " SELECT source, target, round(p, 6) AS p FROM sticky")
def _(spark, sf):
    return evaluation.sticky(_probs(spark, sf), evaluation.run_lengths(clean(spark, sf))).withColumn("p", r("p"))


@query("cross_coarse_probs", TRANS_SQL + " SELECT source, target, round(p / sum(p) OVER (PARTITION BY source), 6) AS p FROM damp")
def _(spark, sf):
    return evaluation.cross_coarse(evaluation.sticky(_probs(spark, sf), evaluation.run_lengths(clean(spark, sf)))).withColumn("p", r("p"))


PRED_SQL = f"WITH {SENSOR_SQL}, pred AS (SELECT *, CASE WHEN x > 12 THEN 'run' WHEN x > 8 THEN 'walk' WHEN x > 4 THEN 'stand' ELSE 'sit/lay' END AS predicted, CAST(session % 7 AS BIGINT) AS dataset FROM sensor)"


def predicted(spark, sf):
    said = F.when(F.col("x") > 12, "run").when(F.col("x") > 8, "walk").when(F.col("x") > 4, "stand").otherwise("sit/lay")
    return sensor(spark, sf).withColumn("predicted", said).withColumn("dataset", F.col("session") % 7)


CW = PRED_SQL + """, cw AS (SELECT activity, n, sum(n) OVER () / (n * count(*) OVER ())::DOUBLE AS weight FROM (SELECT activity, count(*) AS n FROM pred GROUP BY 1)),
dw AS (SELECT dataset, n, sqrt(avg(n) OVER () / n) AS weight FROM (SELECT dataset, count(*) AS n FROM pred GROUP BY 1)),
sw AS (SELECT seq, p.activity, p.predicted, cw.weight * dw.weight AS weight FROM pred p JOIN cw USING (activity) JOIN dw USING (dataset))"""


@query("class_weights", CW + " SELECT activity, n, round(weight, 6) AS weight FROM cw")
def _(spark, sf):
    return evaluation.class_weights(predicted(spark, sf)).withColumn("weight", r("weight"))


@query("dataset_weights", CW + " SELECT dataset, n, round(weight, 6) AS weight FROM dw")
def _(spark, sf):
    return evaluation.dataset_weights(predicted(spark, sf), "dataset", root=True).withColumn("weight", r("weight"))


def _weighted(spark, sf):
    rows = predicted(spark, sf)
    group = evaluation.dataset_weights(rows, "dataset", root=True).select("dataset", F.col("weight").alias("_g"))
    label = evaluation.class_weights(rows).select("activity", F.col("weight").alias("_c"))
    return rows.join(label, "activity").join(group, "dataset").withColumn("weight", F.col("_c") * F.col("_g"))


@query("sample_weights", CW + " SELECT seq, round(weight, 6) AS weight FROM sw")
def _(spark, sf):
    return _weighted(spark, sf).select("seq", r("weight").alias("weight"))


@query("hard_negative_weights", CW + " SELECT seq, round(CASE WHEN activity <> predicted THEN weight * 1.75 ELSE weight END, 6) AS weight FROM sw")
def _(spark, sf):
    return evaluation.hard_negative_weights(_weighted(spark, sf), "weight", "activity", "predicted").select("seq", r("weight").alias("weight"))


@query("confusion", PRED_SQL + " SELECT activity, predicted, count(*) AS n FROM pred GROUP BY 1, 2")
def _(spark, sf):
    return evaluation.confusion(predicted(spark, sf))


CM = PRED_SQL + """, t AS (SELECT activity AS label, count(*) AS support, count(CASE WHEN activity = predicted THEN 1 END) AS hits FROM pred GROUP BY 1), s AS (SELECT predicted AS label, count(*) AS said FROM pred GROUP BY 1),
m AS (SELECT label, coalesce(support, 0) AS support, CASE WHEN coalesce(said, 0) = 0 THEN 0 ELSE coalesce(hits, 0) / said::DOUBLE END AS precision, CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE coalesce(hits, 0) / support::DOUBLE END AS recall FROM t FULL JOIN s USING (label)),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)"""


@query("class_metrics", CM + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(spark, sf):
    return evaluation.class_metrics(predicted(spark, sf)).select("label", "support", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1", CM + " SELECT round(avg(f1), 6) AS macro_f1 FROM f")
def _(spark, sf):
    return evaluation.class_metrics(predicted(spark, sf)).agg(r(F.avg("f1")).alias("macro_f1"))


@query("group_accuracy", PRED_SQL + " SELECT dataset, count(*) AS n, round(avg(CASE WHEN activity = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(1 - avg(CASE WHEN activity = predicted THEN 1.0 ELSE 0.0 END), 6) AS miss_rate FROM pred GROUP BY 1")
def _(spark, sf):
    rows = evaluation.accuracy(predicted(spark, sf), "dataset")
    return rows.select("dataset", "n", r("accuracy").alias("accuracy"), r(1 - F.col("accuracy")).alias("miss_rate"))


# --- coverage, joins, ingest --------------------------------------------------------------------


@query("coverage_report", PRED_SQL + " SELECT activity, count(*) AS n_rows, count(DISTINCT session) AS sessions, count(CASE WHEN dataset = 0 THEN 1 END) AS excluded_dataset, count(CASE WHEN dataset <> 0 AND predicted = 'stand' THEN 1 END) AS excluded_placement FROM pred GROUP BY 1")
def _(spark, sf):
    return predicted(spark, sf).groupBy("activity").agg(F.count("*").alias("n_rows"), F.count_distinct("session").alias("sessions"), F.count_if(F.col("dataset") == 0).alias("excluded_dataset"), F.count_if((F.col("dataset") != 0) & (F.col("predicted") == "stand")).alias("excluded_placement"))


@query("holdout_split", f"WITH {SENSOR_SQL}, z AS (SELECT min(session) AS m FROM sensor) SELECT session, CASE WHEN (CASE WHEN m = 0 THEN session + 1 ELSE session END) % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM sensor, z GROUP BY 1, 2")
def _(spark, sf):
    from strideflow.sources.files import holdout

    rows = sensor(spark, sf)
    return rows.join(holdout(rows, "every-fifth", column="session"), "session").groupBy("session", "split").agg(F.count("*").alias("n"))


@query("activity_map_join", "SELECT n_name AS nation, r_name AS region, count(*) AS n, round(sum(c_acctbal * 9.81), 2) AS scaled FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1, 2")
def _(spark, sf):
    c, n, g = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey).where("r_name <> 'ASIA'")
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"), r(F.sum(F.col("c_acctbal").cast("double") * 9.81), 2).alias("scaled"))


JSON_SQL = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id // 2 END AS message_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS session_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 1 + event_id % 600 ELSE 1 + event_id % 5 END AS size FROM events"""


def batches(spark, sf) -> DataFrame:
    """Ingest messages as JSON text, one per event."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    sample = F.struct((n * 20.0).alias("timestampMs"), F.struct(F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(9.8).alias("z")).alias("acc"))
    samples = F.when(n % 17 != 0, F.array_repeat(sample, F.when(n % 50 == 0, 1 + n % 600).otherwise(1 + n % 5).cast("int")))
    body = F.struct(F.when(n % 11 != 0, F.floor(n / 2)).alias("messageId"), F.when(n % 13 == 0, "").otherwise(F.col("user_id").cast("string")).alias("sessionId"), F.lit("d").alias("deviceId"), samples.alias("samples"))
    return e.select("event_id", F.to_json(body).alias("value"))


@query("ingest_parse", f"""WITH b AS ({JSON_SQL}) SELECT event_id, CASE WHEN message_id IS NULL THEN 'messageId' WHEN session_id = '' THEN 'sessionId' WHEN size IS NULL THEN 'samples' WHEN size > 512 THEN 'too-many-samples' END AS error_reason,
CAST(coalesce(size, 0) AS BIGINT) AS n_samples FROM b""")
def _(spark, sf):
    return live.parse(batches(spark, sf)).select("event_id", "error_reason", F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("n_samples")).withColumn("n_samples", F.greatest("n_samples", F.lit(0)))


@query("ingest_dedupe", f"WITH b AS ({JSON_SQL}) SELECT session_id, message_id FROM b WHERE message_id IS NOT NULL AND session_id <> '' AND size <= 512 GROUP BY 1, 2")
def _(spark, sf):
    rows = live.deduplicate(live.parse(batches(spark, sf)).where("error_reason is null"))
    return rows.select(F.col("sessionId").alias("session_id"), F.col("messageId").alias("message_id"))


@query("out_of_order", f"WITH {SENSOR_SQL}, m AS (SELECT session, seq, CAST((seq * 7919) % 1000 AS BIGINT) AS message_id FROM sensor) SELECT session, seq, coalesce(message_id <= lag(message_id) OVER (PARTITION BY session ORDER BY seq), false) AS out_of_order FROM m")
def _(spark, sf):
    rows = sensor(spark, sf).withColumn("message_id", F.col("seq") * 7919 % 1000)
    return timeseries.out_of_order(rows).select("session", "seq", "out_of_order")


@query("scope_check", "SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'invalid-token' WHEN c_acctbal <= value * 100 THEN 'expired' WHEN c_nationkey <> user_id % 25 THEN 'session-mismatch' END AS error_reason FROM events LEFT JOIN customer ON c_custkey = user_id * 3")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") * 3).alias("write_token"), (F.col("value") * 100).alias("received_ns"), (F.col("user_id") % 25).cast("string").alias("sessionId"), F.lit("d").alias("deviceId"), F.lit(None).cast("string").alias("error_reason"))
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("write_token"), F.col("c_nationkey").cast("string").alias("session_id"), F.lit("d").alias("device_id"), F.col("c_acctbal").alias("expires_ns"))
    return live.scope(e, s).select("event_id", "error_reason")


@query("latest_snapshot", f"WITH {SENSOR_SQL} SELECT session, max(seq) AS message_id, arg_max(x, seq) AS x, arg_max(activity, seq) AS activity FROM sensor GROUP BY 1")
def _(spark, sf):
    return live.latest(sensor(spark, sf).select("session", F.col("seq").alias("message_id"), "x", "activity"))


# --- signal features ----------------------------------------------------------------------------

SIG = "WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM s), q AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM l)"


@query("feat_moments", SIG + ", m AS (SELECT vec_id, avg(x) AS mean, sqrt(avg(c * c)) AS std, sqrt(avg(x * x)) AS rms, avg(abs(c)) AS mad, min(x) AS low, max(x) AS high, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM q GROUP BY 1) SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round(rms, 6) AS rms, round(mad, 6) AS mad, round(low, 6) AS low, round(high, 6) AS high, round(CASE WHEN std < 1e-8 THEN 0 ELSE m3 / (std * std * std) END, 5) AS skew, round(CASE WHEN std < 1e-8 THEN 0 ELSE m4 / (std * std * std * std) - 3 END, 5) AS kurt FROM m")
def _(spark, sf):
    v, mean = F.col("v"), F.col("mean")
    rows = signals(spark, sf).where("size(v) > 0").withColumn("mean", S.mean(v)).withColumn("c", F.transform(v, lambda x: x - mean))
    rows = rows.withColumns({"rms": F.sqrt(S.mean(F.transform("v", lambda x: x * x))), "std": F.sqrt(S.mean(F.transform("c", lambda x: x * x))), "mad": S.mean(F.transform("c", F.abs)),
                             "m3": S.mean(F.transform("c", lambda x: x * x * x)), "m4": S.mean(F.transform("c", lambda x: x * x * x * x))})
    std = F.col("std")
    gate = lambda c: F.when(std < 1e-8, 0.0).otherwise(c)
    return rows.select("vec_id", *[r(c).alias(c) for c in ("mean", "std", "rms", "mad")], r(F.array_min("v")).alias("low"), r(F.array_max("v")).alias("high"),
                       r(gate(F.col("m3") / (std * std * std)), 5).alias("skew"), r(gate(F.col("m4") / (std * std * std * std) - 3), 5).alias("kurt"))


@query("feat_percentiles", SIG + " SELECT vec_id, " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM l GROUP BY 1")
def _(spark, sf):
    x = signals(spark, sf).select("vec_id", F.explode("v").alias("x"))
    return x.groupBy("vec_id").agg(*[r(F.percentile("x", F.lit(p / 100))).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


@query("feat_zcr_jerk", SIG + ", d AS (SELECT vec_id, x, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS b FROM l) SELECT vec_id, round(avg(CASE WHEN (x < 0) <> (b < 0) THEN 1.0 ELSE 0.0 END), 6) AS zcr, round(sqrt(avg((x - b) * 50 * (x - b) * 50)), 4) AS jerk_rms FROM d WHERE b IS NOT NULL GROUP BY 1")
def _(spark, sf):
    v, n = F.col("v"), F.size("v") - 1
    step = F.zip_with(F.slice(v, F.lit(2), n), F.slice(v, F.lit(1), n), lambda a, b: F.struct((a - b).alias("d"), ((a < 0) != (b < 0)).cast("double").alias("s")))
    rows = signals(spark, sf).select("vec_id", step.alias("e"))
    return rows.select("vec_id", r(F.aggregate("e", F.lit(0.0), lambda a, e: a + e["s"]) / F.size("e")).alias("zcr"), r(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, e: a + e["d"] * 50 * e["d"] * 50) / F.size("e")), 4).alias("jerk_rms"))


@query("feat_trend_halves", SIG + """, n AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM l), h AS (SELECT *, i < n // 2 AS one FROM n)
SELECT vec_id, round(regr_slope(x, i / 50.0::DOUBLE), 5) AS trend, round(avg(CASE WHEN one THEN x END), 6) AS first_half, round(avg(CASE WHEN NOT one THEN x END), 6) AS second_half,
round(avg(CASE WHEN NOT one THEN x * x END) / (avg(CASE WHEN one THEN x * x END) + 1e-8), 4) AS energy_ratio FROM h GROUP BY 1""")
def _(spark, sf):
    x = signals(spark, sf).select("vec_id", F.floor(F.size("v") / 2).alias("half"), F.posexplode("v").alias("i", "x"))
    one, two = F.when(F.col("i") < F.col("half"), F.col("x")), F.when(F.col("i") >= F.col("half"), F.col("x"))
    return x.groupBy("vec_id").agg(r(F.regr_slope("x", F.col("i") / 50.0), 5).alias("trend"), r(F.avg(one)).alias("first_half"), r(F.avg(two)).alias("second_half"), r(F.avg(two * two) / (F.avg(one * one) + 1e-8), 4).alias("energy_ratio"))


POWER = SIG + """, w AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM q),
b AS (SELECT vec_id, n, k, sum(c * cos(2 * pi() * k * i / n)) AS re, sum(c * sin(2 * pi() * k * i / n)) AS im FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM w) GROUP BY 1, 2, 3),
p AS (SELECT vec_id, k, k * 50 / n::DOUBLE AS f, re * re + im * im AS p FROM b), t AS (SELECT vec_id, sum(p) AS total, sum(p * f) / sum(p) AS centroid FROM p GROUP BY 1)"""


def power(spark, sf) -> DataFrame:
    """vec_id, k, p, f: the power of each bin up to half the rate, whatever the signals' lengths."""
    rows = signals(spark, sf).select("vec_id", F.size("v").alias("n"), F.posexplode("v").alias("i", "x"))
    sizes = [row["n"] for row in signals(spark, sf).select(F.size("v").alias("n")).distinct().limit(1024).collect()]  # lengths, not signals
    if len(sizes) == 1:  # one length: waves are literals, and the sums stay in generated code
        n = sizes[0]
        waves = [F.array(*[F.lit(float(f(2 * np.pi * j / n))) for j in range(n)]) for f in (np.cos, np.sin)]
        # over whole periods the mean adds nothing to any bin but the first, which holds the mean alone and is 0
        sums = [F.sum(F.col("x") * w[(F.col("i") * k) % n]).alias(f"{c}{k}") for k in range(1, n // 2 + 1) for c, w in zip("cs", waves, strict=True)]
        bins = F.array(F.lit(0.0), *[F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}") for k in range(1, n // 2 + 1)])
        return rows.groupBy("vec_id", "n").agg(*sums).select("vec_id", "n", F.posexplode(bins).alias("k", "p")).withColumn("f", F.col("k") * 50 / F.col("n"))
    angle = 2 * np.pi * F.col("k") * F.col("i") / F.col("n")
    wide = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    sums = wide.groupBy("vec_id", "n", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("c"), F.sum(F.col("x") * F.sin(angle)).alias("s")).select("vec_id", "n", "k", (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("p"))
    first = rows.select("vec_id", "n", F.lit(0).alias("k"), F.lit(0.0).alias("p")).distinct()
    return sums.unionByName(first).withColumn("f", F.col("k") * 50 / F.col("n"))


@query("feat_bands", POWER + " SELECT vec_id, round(total, 4) AS total, " + ", ".join(f"round(sum(CASE WHEN f BETWEEN {a} AND {b} THEN p ELSE 0 END), 4) AS band_{n}" for n, a, b in (("05_4", 0.5, 4), ("4_8", 4, 8), ("8_20", 8, 20))) + ", round(centroid, 4) AS centroid FROM p JOIN t USING (vec_id) GROUP BY vec_id, total, centroid")
def _(spark, sf):
    bands = (("05_4", 0.5, 4), ("4_8", 4, 8), ("8_20", 8, 20))
    return power(spark, sf).groupBy("vec_id").agg(r(F.sum("p"), 4).alias("total"), *[r(F.sum(F.when(F.col("f").between(a, b), F.col("p")).otherwise(0.0)), 4).alias(f"band_{n}") for n, a, b in bands], r(F.sum(F.col("p") * F.col("f")) / F.sum("p"), 4).alias("centroid"))


@query("feat_spectral_shape", POWER + """, e AS (SELECT p.*, total, centroid, p / total AS w, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS cum FROM p JOIN t USING (vec_id))
SELECT vec_id, round(-sum(CASE WHEN w > 1e-25 THEN w * ln(w) ELSE 0 END) / ln(count(CASE WHEN w > 1e-25 THEN 1 END)), 5) AS entropy, round(sqrt(sum(w * (f - centroid) * (f - centroid))), 4) AS spread, min(CASE WHEN cum >= 0.85 * total THEN f END) AS rolloff, arg_max(f, CASE WHEN k > 0 THEN p ELSE -1 END) AS dom_freq FROM e GROUP BY 1""")
def _(spark, sf):
    whole = Window.partitionBy("vec_id")
    rows = power(spark, sf).withColumn("total", F.sum("p").over(whole)).withColumn("w", F.col("p") / F.col("total")).withColumn("centroid", F.sum(F.col("w") * F.col("f")).over(whole)).withColumn("cum", F.sum("p").over(whole.orderBy("k")))
    live_ = F.col("w") > 1e-25  # the mean was taken out, so bin 0 holds rounding only
    return rows.groupBy("vec_id").agg(
        r(-F.sum(F.when(live_, F.col("w") * F.ln("w")).otherwise(0.0)) / F.ln(F.count_if(live_)), 5).alias("entropy"), r(F.sqrt(F.sum(F.col("w") * F.pow(F.col("f") - F.col("centroid"), F.lit(2.0)))), 4).alias("spread"),
        F.min(F.when(F.col("cum") >= 0.85 * F.col("total"), F.col("f"))).alias("rolloff"), F.max_by("f", F.when(F.col("k") > 0, F.col("p")).otherwise(-1.0)).alias("dom_freq"))


@query("feat_autocorr", SIG + ", a AS (SELECT x.vec_id, y.i - x.i AS lag, sum(x.c * y.c) AS ac FROM q x JOIN q y ON x.vec_id = y.vec_id AND y.i >= x.i GROUP BY 1, 2), z AS (SELECT *, ac / (max(CASE WHEN lag = 0 THEN ac END) OVER (PARTITION BY vec_id) + 1e-8) AS r FROM a) SELECT vec_id, round(max(CASE WHEN lag BETWEEN 12 AND 100 THEN r END), 5) AS peak, round(arg_max(lag, CASE WHEN lag BETWEEN 12 AND 100 THEN r END) / 50.0, 4) AS lag_s FROM z GROUP BY 1")
def _(spark, sf):
    rows = signals(spark, sf).select("vec_id", S.centred(F.col("v")).alias("c"))
    dot = lambda k: F.aggregate(F.zip_with(F.slice("c", F.lit(1), F.size("c") - k), F.slice("c", k + 1, F.size("c") - k), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    lags = F.when(F.size("c") > 12, F.sequence(F.lit(12), F.least(F.size("c") - 1, F.lit(100))))  # shorter signals have none
    ac = F.transform(lags, lambda k: F.struct((dot(k) / (dot(F.lit(0)) + 1e-8)).alias("r"), (-k).alias("lag")))
    best = rows.select("vec_id", F.array_max(ac).alias("b"))
    return best.select("vec_id", r(F.col("b.r"), 5).alias("peak"), r(-F.col("b.lag") / 50.0, 4).alias("lag_s"))


@query("features_153")
def _(spark, sf):
    """All features of every sliding window of 32 sensor rows, the least that the short-time spectra need."""
    from strideflow.functions.features import window_features

    rows = timeseries.sliding_windows(clean(spark, sf), 32, 16)
    samples = F.array_sort(F.collect_list(F.struct("sample_index", "x", "y", "z")))
    windows = rows.groupBy("session", "window_index").agg(samples.alias("s"))
    return window_features(windows.select("session", "window_index", *[F.col("s")[a].alias(a) for a in "xyz"]), ("session", "window_index"))


# --- decoding, guards, insights -----------------------------------------------------------------


def probabilities() -> dict:
    return {n: F.col(f"p{k}") for k, n in enumerate(LABELS)}


def metrics() -> dict:
    return {k: F.col(k) for k in ("energy", "jerk", "dom", "artifact", "pocket")}


def guarded(spark, sf, guard):
    rows = seen(spark, sf)
    out = guard(probabilities(), metrics() | {"previous_stairs": F.col("previous_stairs")})
    return rows.select("session", "seq", *[r(c).alias(f"p{k}") for k, c in enumerate(out.values())])


#: Each guard's seven columns in SQL.
GUARD_SQL = {
    "low_motion": [f"CASE WHEN energy < 0.1 THEN {'0' if k in (0, 1, 2, 5, 6) else f'p{k} / (p3 + p4)'} ELSE p{k} END" for k in range(7)],
    "stairs_static": [f"CASE WHEN energy <= 0.35 AND jerk <= 0.9 AND dom <= 0.7 AND p2 > 0.03 THEN {'0.03' if k == 2 else f'p{k} * (1 + (p2 - 0.03) / (1 - p2))'} ELSE p{k} END" for k in range(7)],
    "stairs_moving": [f"CASE WHEN pocket AND energy >= 0.35 AND dom BETWEEN 1.2 AND 3.2 AND 0.6 * p2 + 0.4 * coalesce(previous_stairs, p2) >= 0.35 AND p0 + p1 >= 0.3 AND p2 > 0.15 THEN {'0.15' if k == 2 else f'p{k} * (1 + (p2 - 0.15) / (p0 + p1))' if k < 2 else f'p{k}'} ELSE p{k} END" for k in range(7)],
    "smooth_walk": [f"CASE WHEN pocket AND energy BETWEEN 0.3 AND 1.8 AND dom BETWEEN 1.35 AND 2.45 AND jerk <= 1.2 AND p0 >= 0.18 AND p1 <= 0.45 AND p2 <= 0.45 THEN {('p0 + p1 - least(p1, 0.22) + p2 - least(p2, 0.18)', 'least(p1, 0.22)', 'least(p2, 0.18)', 'p3', 'p4', 'p5', 'p6')[k]} ELSE p{k} END" for k in range(7)],
    "stairs_hallucination": [f"CASE WHEN pocket AND energy > 8 AND jerk > 40 AND p2 > 0.05 THEN {'0.05' if k == 2 else f'CASE WHEN p0 + p1 > 0 THEN p{k} * (1 + (p2 - 0.05) / (p0 + p1)) ELSE (p2 - 0.05) / 2 END' if k < 2 else f'p{k}'} ELSE p{k} END" for k in range(7)],
}
#: ``scored`` with the stairs of the row before, as a previous posterior.
SEEN_SQL = SCORED_SQL + ", seen AS (SELECT *, lag(p2) OVER (PARTITION BY session ORDER BY t, seq) AS previous_stairs FROM scored)"


def _sql(columns: list[str]) -> str:
    return f"WITH {SEEN_SQL} SELECT session, seq, " + ", ".join(f"round({c}, 6) AS p{k}" for k, c in enumerate(columns)) + " FROM seen"


def seen(spark, sf) -> DataFrame:
    return scored(spark, sf).withColumn("previous_stairs", F.lag("p2").over(Window.partitionBy("session").orderBy("t", "seq")))


@query("guard_low_motion", _sql(GUARD_SQL["low_motion"]))
def _(spark, sf):
    return guarded(spark, sf, guards.low_motion)


@query("guard_stairs_static", _sql(GUARD_SQL["stairs_static"]))
def _(spark, sf):
    return guarded(spark, sf, guards.stairs_static)


@query("guard_stairs_moving", _sql(GUARD_SQL["stairs_moving"]))
def _(spark, sf):
    return guarded(spark, sf, guards.stairs_moving)


@query("guard_smooth_walk", _sql(GUARD_SQL["smooth_walk"]))
def _(spark, sf):
    return guarded(spark, sf, guards.smooth_walk)


@query("guard_stairs_hallucination", _sql(GUARD_SQL["stairs_hallucination"]).replace("FROM seen", "FROM (SELECT * REPLACE (energy * 2 AS energy, jerk * 80 AS jerk) FROM seen)"))
def _(spark, sf):
    """On rows with twice the energy and 80 times the jerk, as the plain ones never reach the gates."""
    out = guards.stairs_hallucination(probabilities(), metrics() | {"energy": F.col("energy") * 2, "jerk": F.col("jerk") * 80})
    return scored(spark, sf).select("session", "seq", *[r(c).alias(f"p{k}") for k, c in enumerate(out.values())])


@query("guard_calibration", _sql([f"CASE WHEN pocket AND artifact > 1.5 THEN (1 - CASE WHEN artifact >= 2.2 THEN 0.5 ELSE 0.35 END) * p{k} + CASE WHEN artifact >= 2.2 THEN 0.5 ELSE 0.35 END / 7 ELSE p{k} END" for k in range(7)]))
def _(spark, sf):
    return guarded(spark, sf, guards.calibrate)


CHAIN_SQL = f"WITH {SEEN_SQL}"
for _n, (_name, _columns) in enumerate(GUARD_SQL.items()):
    CHAIN_SQL += f", g{_n} AS (SELECT session, seq, energy, jerk, dom, artifact, pocket, previous_stairs, " + ", ".join(f"{c} AS p{k}" for k, c in enumerate(_columns)) + f" FROM {f'g{_n - 1}' if _n else 'seen'})"


@query("guard_chain", CHAIN_SQL + " SELECT session, seq, " + ", ".join(f"round(p{k}, 6) AS p{k}" for k in range(7)) + " FROM g4")
def _(spark, sf):
    names = [f"p{k}" for k in range(len(LABELS))]
    rows = guards.apply_in_turn(seen(spark, sf), dict(zip(LABELS, names, strict=True)), metrics() | {"previous_stairs": F.col("previous_stairs")}, guards.PRE_DECODE)
    return rows.select("session", "seq", *[r(n).alias(n) for n in names])


DOUBT_SQL = f"""WITH {SCORED_SQL}, k AS (SELECT *, dom * 60 AS cadence, 2 * (p3 + p4) AS rhythm, artifact / 4 AS sure, greatest(p0, p1, p2, p3, p4, p5, p6) AS top FROM scored),
g AS (SELECT *, CASE WHEN p0 = top THEN 'walk' WHEN p1 = top THEN 'run' WHEN p2 = top THEN 'stairs' WHEN p3 = top THEN 'sit/lay' WHEN p4 = top THEN 'stand' WHEN p5 = top THEN 'transitions' END AS label FROM k),
d AS (SELECT *, CASE WHEN NOT pocket OR artifact <= 1.5 THEN 'none'
  WHEN label = 'run' AND (cadence < 95 OR cadence < 130 AND rhythm < 0.75) THEN 'run-to-walk-low-cadence-artifact'
  WHEN label = 'stairs' AND (cadence > 0 AND cadence < 85 OR rhythm < 0.45) THEN 'stairs-to-walk-low-periodicity-artifact'
  WHEN label = 'stairs' AND cadence BETWEEN 90 AND 130 AND rhythm >= 0.55 THEN 'stairs-to-walk-walking-cadence'
  WHEN label = 'transitions' AND activity IN ('walk', 'run', 'stairs') AND sure >= 0.4 AND cadence >= 120 AND rhythm >= 0.25 THEN 'transitions-to-' || activity || '-locomotion-burst' ELSE 'none' END AS reason FROM g),
t AS (SELECT *, least(0.8 * top, 0.35) AS moved, CASE WHEN reason = 'none' THEN '' WHEN label = 'transitions' THEN activity ELSE 'walk' END AS taker, CASE WHEN reason = 'none' THEN '' ELSE label END AS giver FROM d)
SELECT session, seq, reason, """ + ", ".join(f"round(p{k} - CASE WHEN giver = '{n}' THEN moved ELSE 0 END + CASE WHEN taker = '{n}' THEN moved ELSE 0 END, 6) AS p{k}" for k, n in enumerate(LABELS)) + " FROM t"


@query("guard_pocket_sanity", DOUBT_SQL)
def _(spark, sf):
    m = metrics() | {"cadence": F.col("dom") * 60, "periodicity": 2 * (F.col("p3") + F.col("p4"))}
    names = {n: f"p{k}" for k, n in enumerate(LABELS)}
    rows = guards.apply_pocket_sanity(scored(spark, sf), names, F.col("activity"), F.col("artifact") / 4, m)
    return rows.select("session", "seq", "reason", *[r(n).alias(n) for n in names.values()])


#: Window features from the scored rows, in the same words for both engines.
FEATURES = {
    "jerk_mag_p90": "jerk * 4", "body_mag_energy_8_20_hz": "energy", "body_mag_energy_0p5_4_hz": "dom + 0.5", "body_mag_spectral_entropy": "3 + p0 * 8", "gravity_angle_stability_std": "p1", "stft_dom_freq_std": "p2", "body_mag_autocorr_periodicity_ratio": "1 + p3 * 4",
    "body_mag_energy": "energy", "body_mag_dom_freq_hz": "dom * 2", "body_mag_autocorr_peak_freq_hz": "dom", "body_mag_interpeak_interval_cv": "p4", "jerk_mag_std": "jerk * 2", "dwt_high_low_ratio": "p5 * 8", "gravity_tilt_start_end_delta": "p6 * 2 - 0.3",
    "body_vertical_energy": "energy / 2", "gravity_tilt_abs_z_std": "p0 / 4", "body_mag_coeff_var": "p1 * 4", "gravity_x_mean": "p2 * 20", "gravity_y_mean": "(p3 - 0.15) * 60", "gravity_z_mean": "(p4 - 0.15) * 60",
}
FEATURE_SQL = SCORED_SQL + ", f AS (SELECT session, seq, t, activity, p0 + p1 + p2 + 0.2 AS confidence, artifact, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATURES.items()) + " FROM scored)"


def featured(spark, sf) -> DataFrame:
    rows = scored(spark, sf)
    return rows.select("session", "seq", "t", "activity", F.expr("p0 + p1 + p2 + 0.2").alias("confidence"), "artifact", *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in FEATURES.items()])


ARTIFACT_SQL = FEATURE_SQL + ", m AS (SELECT *, abs(jerk_mag_p90) AS jerk, greatest(body_mag_energy_8_20_hz, 0) / greatest(greatest(body_mag_energy_0p5_4_hz, 0), 1e-8) AS hf, abs(body_mag_spectral_entropy) AS entropy, abs(gravity_angle_stability_std) AS gravity, abs(stft_dom_freq_std) AS jitter, abs(body_mag_autocorr_periodicity_ratio) AS periodicity FROM f), base AS (SELECT *, greatest(0, 0.30 * greatest(0, least(2.5, (jerk - 1.5) / 2)) + 0.30 * greatest(0, least(2.5, (hf - 0.35) / 0.4)) + 0.15 * greatest(0, least(2.5, (entropy - 3.2) / 1.2)) + 0.15 * greatest(0, least(2.5, (gravity - 0.1) / 0.2)) + 0.10 * greatest(0, least(2.5, (jitter - 0.18) / 0.22)) - 0.35 * greatest(0, least(2.5, periodicity - 1.3))) AS base FROM m)"


@query("artifact_score", "WITH " + ARTIFACT_SQL + " SELECT session, seq, round(base, 6) AS score FROM base")
def _(spark, sf):
    rows = featured(spark, sf)
    return rows.select("session", "seq", r(guards.artifact_score(guards.artifact_metrics({n: F.col(n) for n in FEATURES}))).alias("score"))


_METRICS = tuple(guards.ARTIFACT)
ADAPTIVE_SQL = "WITH " + ARTIFACT_SQL + ", h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, seq) - 1 AS held, " + ", ".join(f"list({n}) OVER (PARTITION BY session ORDER BY t, seq ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS h_{n}" for n in _METRICS) + " FROM base), z AS (SELECT session, seq, base, held, " + ", ".join(f"CASE WHEN len(h_{n}) >= 20 THEN greatest(-4, least(4, ({n} - list_median(h_{n})) / greatest(1e-3, 1.4826 * list_median(list_transform(h_{n}, lambda v: abs(v - list_median(h_{n}))))))) ELSE 0 END AS z_{n}" for n in _METRICS) + " FROM h) SELECT session, seq, round(CASE WHEN held >= 20 THEN 0.35 * base + 0.65 * greatest(0, " + " + ".join(f"({w}) * greatest(0, z_{n})" for n, (w, _, _) in guards.ARTIFACT.items()) + ") ELSE base END, 8) AS score FROM z"


@query("adaptive_artifact", ADAPTIVE_SQL)
def _(spark, sf):
    found = guards.artifact_metrics({n: F.col(n) for n in FEATURES})
    rows = featured(spark, sf).select("session", "seq", "t", *[c.alias(n) for n, c in found.items()])
    rows = rows.withColumn("base", guards.artifact_score({n: F.col(n) for n in _METRICS})).withColumn("held", F.row_number().over(Window.partitionBy("session").orderBy("t", "seq")) - 1)
    for n in _METRICS:
        rows = timeseries.history_z(rows, n).withColumnRenamed("z", f"z_{n}")
    return rows.select("session", "seq", r(guards.adaptive_score(F.col("base"), {n: F.col(f"z_{n}") for n in _METRICS}, F.col("held") >= 20), 8).alias("score"))


@query("decoder_resets", CLEAN_SQL + """, g AS (SELECT session, seq, t, t - lag(t + 3600) OVER w AS space, row_number() OVER w AS n FROM clean WINDOW w AS (PARTITION BY session ORDER BY t, seq))
SELECT session, seq, round(CASE WHEN space > 0 THEN space * 1000 END, 3) AS gap_ms, CAST(sum(CASE WHEN n > 1 AND space > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g""")
def _(spark, sf):
    rows = clean(spark, sf).select("session", "seq", F.col("t").alias("start"), (F.col("t") + HOUR).alias("end"))
    return decode.reset_runs(rows, "per-gap", 12 * HOUR).select("session", "seq", r("gap_ms", 3).alias("gap_ms"), "run")


@query("top3", f"WITH {SCORED_SQL}, u AS (" + " UNION ALL ".join(f"SELECT session, seq, {k} AS i, '{n}' AS label, p{k} AS p FROM scored" for k, n in enumerate(LABELS)) + "), n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY p DESC, i DESC) AS rank FROM u) SELECT session, seq, rank, label, round(p, 6) AS p FROM n WHERE rank <= 3")
def _(spark, sf):
    rows = scored(spark, sf).select("session", "seq", F.posexplode(decode.top_k(probabilities())).alias("rank", "s"))
    return rows.select("session", "seq", (F.col("rank") + 1).cast("long").alias("rank"), "s.label", r("s.p").alias("p"))


#: With equal chances to leave a label, the prior is 0.03 of all and 0.79 more of the label's own.
HMM_SQL = "WITH RECURSIVE " + SCORED_SQL + """, o AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY t, seq) AS n, list_transform([p0, p1, p2, p3, p4, p5, p6], lambda x: greatest(1e-12, least(1.0, x))) AS e FROM scored),
e AS (SELECT session, seq, n, list_transform(e, lambda x: x / list_sum(e)) AS e FROM o),
r AS (SELECT session, seq, n, list_transform(e, lambda x: x / list_sum(e)) AS post FROM e WHERE n = 1
UNION ALL SELECT session, seq, n, list_transform(q, lambda x: x / list_sum(q)) FROM (SELECT e.session, e.seq, e.n, list_transform([1, 2, 3, 4, 5, 6, 7], lambda b: greatest(1e-12, least(1.0, (0.03 * list_sum(post) + 0.79 * post[b]) * e.e[b]))) AS q FROM r JOIN e ON e.session = r.session AND e.n = r.n + 1))
SELECT session, seq, CAST(list_position(post, list_max(post)) - 1 AS INTEGER) AS label_index, """ + ", ".join(f"round(post[{k + 1}], 6) AS p{k}" for k in range(7)) + " FROM r"


@query("hmm_decode", HMM_SQL)
def _(spark, sf):
    k = len(LABELS)
    trans = [[0.82 if a == b else 0.03 for b in range(k)] for a in range(k)]
    rows = scored(spark, sf).select("session", "t", "seq", F.array(*probabilities().values()).alias("probs"))
    return decode.decode(rows, [1 / k] * k, trans).select("session", "seq", "label_index", *[r(F.col("posterior")[b]).alias(f"p{b}") for b in range(k)])


@query("insight_scores", f"""WITH {SCORED_SQL}, b AS (SELECT *, sqrt(energy / 0.123) AS ratio, CASE WHEN dom BETWEEN 0.5 AND 4 THEN dom ELSE 0 END AS cadence FROM scored)
SELECT session, seq, round(ratio, 5) AS ratio, CASE WHEN ratio < 1.2 THEN 'still' WHEN ratio < 1.8 THEN 'light' WHEN ratio < 2.8 THEN 'moderate' ELSE 'high' END AS level, cadence,
round(100 * (0.5 * greatest(0, least(1, jerk / 4)) + 0.3 * greatest(0, least(1, jerk / 2.5)) + 0.2 * greatest(0, least(1, energy / 6))), 4) AS impact,
round(100 * (0.4 * greatest(0, least(1, 1 - energy / 0.5)) + 0.35 * greatest(0, least(1, 1 - sqrt(energy) / 0.3)) + 0.25 * greatest(0, least(1, 1 - artifact / 0.2))), 4) AS stability,
CASE WHEN p0 >= 0.8 AND artifact < 1.5 THEN 'high' WHEN p0 >= 0.5 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN activity IN ('walk', 'run', 'stairs') THEN 'locomotion' WHEN activity IN ('sit/lay', 'stand') THEN 'static' WHEN activity = 'transitions' THEN 'transition' ELSE 'other' END AS grp FROM b""")
def _(spark, sf):
    e, j, a = F.col("energy"), F.col("jerk"), F.col("artifact")
    ratio = insights.intensity_ratio(e)
    return scored(spark, sf).select("session", "seq", r(ratio, 5).alias("ratio"), insights.intensity_level(ratio).alias("level"), insights.cadence(F.col("dom"), F.lit(0.0)).alias("cadence"), r(insights.ground_impact(j, j, e), 4).alias("impact"),
                                    r(insights.posture_stability(e, a), 4).alias("stability"), insights.confidence_tier(F.col("p0"), a).alias("tier"), insights.group_of(F.col("activity")).alias("grp"))


_C = lambda x, a=0, b=1: f"greatest({a}, least({b}, {x}))"
INSIGHT_SQL = "WITH " + FEATURE_SQL + f""", i AS (SELECT *, coalesce(activity, 'unknown') AS said, sqrt(body_mag_energy / 0.123) AS intensity_ratio, abs(gravity_tilt_start_end_delta) * 180 / pi() AS orientation_change_deg,
CASE WHEN abs(gravity_z_mean) >= 8.5 AND abs(gravity_z_mean) >= greatest(abs(gravity_x_mean), abs(gravity_y_mean)) THEN 'flat' WHEN abs(gravity_y_mean) >= 8.5 AND abs(gravity_y_mean) >= greatest(abs(gravity_x_mean), abs(gravity_z_mean)) THEN CASE WHEN gravity_y_mean < 0 THEN 'upright' ELSE 'upside-down' END ELSE 'tilted' END AS phone_orientation,
100 * (0.5 * (1 - {_C('artifact')}) + 0.3 * (1 - {_C('(dwt_high_low_ratio - 0.5) / 2')}) + 0.2 * (1 - {_C('body_mag_coeff_var / 1.5')})) AS signal_quality_score,
CASE WHEN confidence >= 0.8 AND artifact < 1.5 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier,
60 * CASE WHEN body_mag_autocorr_peak_freq_hz BETWEEN 0.5 AND 4 THEN body_mag_autocorr_peak_freq_hz WHEN body_mag_dom_freq_hz BETWEEN 0.5 AND 4 THEN body_mag_dom_freq_hz ELSE 0 END AS cadence_spm,
100 * (0.45 * (1 - {_C('jerk_mag_std / 2.5')}) + 0.35 * (1 - {_C('jerk_mag_p90 / 4')}) + 0.2 * (1 - {_C('(dwt_high_low_ratio - 0.5) / 2')})) AS smoothness_score,
{_C('14 * sqrt(body_vertical_energy) + 20 * gravity_tilt_abs_z_std', 0, 80)} AS vertical_oscillation_mm, 100 * (0.5 * {_C('jerk_mag_p90 / 4')} + 0.3 * {_C('jerk_mag_std / 2.5')} + 0.2 * {_C('body_mag_energy / 6')}) AS ground_impact_score,
100 * (0.4 * (1 - {_C('body_mag_energy / 0.5')}) + 0.35 * (1 - {_C('sqrt(body_mag_energy) / 0.3')}) + 0.25 * (1 - {_C('gravity_angle_stability_std / 0.2')})) AS posture_stability_score, gravity_tilt_abs_z_std * 180 / pi() AS sway_amplitude_deg FROM f),
j AS (SELECT *, CASE WHEN intensity_ratio < 1.2 THEN 'still' WHEN intensity_ratio < 1.8 THEN 'light' WHEN intensity_ratio < 2.8 THEN 'moderate' ELSE 'high' END AS intensity_level, orientation_change_deg >= 15 AS posture_change_detected,
CASE WHEN cadence_spm > 0 THEN 100 * (0.5 * {_C('(body_mag_autocorr_periodicity_ratio - 1) / 2')} + 0.3 * (1 - {_C('body_mag_interpeak_interval_cv / 0.5')}) + 0.2 * (1 - {_C('stft_dom_freq_std / 0.75')})) ELSE 0 END AS regularity,
CASE WHEN said IN ('walk', 'run', 'stairs') THEN 'locomotion' WHEN said IN ('sit/lay', 'stand') THEN 'static' WHEN said = 'transitions' THEN 'transition' ELSE 'other' END AS grp,
said IN ('walk', 'run', 'stairs') AND jerk_mag_p90 >= 2.5 AND ground_impact_score >= 55 AND intensity_ratio >= 2 AS burst_detected FROM i),
k AS (SELECT *, ' at ' || CAST(CAST(round_even(cadence_spm, 0) AS BIGINT) AS VARCHAR) || ' SPM' AS spm, printf('%.1f', round_even(sway_amplitude_deg, 1)) || '\u00b0' AS sway FROM j)"""
NUMBERS = ("intensity_ratio", "orientation_change_deg", "signal_quality_score", "cadence_spm", "smoothness_score", "vertical_oscillation_mm", "ground_impact_score", "posture_stability_score", "sway_amplitude_deg")


@query("window_insights", INSIGHT_SQL + " SELECT session, seq, " + ", ".join(f"round({n}, 5) AS {n}" for n in NUMBERS) + """, round(regularity, 5) AS stride_regularity_score, intensity_level, burst_detected, posture_change_detected, phone_orientation, tier AS prediction_confidence_tier,
CAST(9 + CASE grp WHEN 'locomotion' THEN 6 WHEN 'static' THEN 2 WHEN 'transition' THEN 1 ELSE 0 END AS INTEGER) AS n_applicable, CASE WHEN tier = 'low' THEN 'Uncertain \u2014 try adjusting phone position'
WHEN said = 'walk' THEN CASE WHEN regularity >= 80 THEN 'Steady walking' WHEN ground_impact_score >= 60 THEN 'Walking with firm steps' ELSE 'Walking' END || spm
WHEN said = 'run' THEN CASE WHEN ground_impact_score >= 70 THEN 'High-impact running \u2014 consider softer landing' WHEN regularity >= 80 THEN 'Smooth running' || spm ELSE 'Running' || spm END WHEN said = 'stairs' THEN 'Climbing' || spm
WHEN said = 'sit/lay' THEN CASE WHEN posture_stability_score >= 80 THEN 'Stable seated posture' WHEN sway_amplitude_deg >= 5 THEN 'Slight sway while seated \u2014 ' || sway ELSE 'Relaxed seated posture' END
WHEN said = 'stand' THEN CASE WHEN posture_stability_score >= 80 THEN 'Standing still' WHEN sway_amplitude_deg >= 3 THEN 'Slight sway while standing \u2014 ' || sway ELSE 'Standing' END WHEN said = 'transitions' THEN 'Transitioning...' ELSE 'Activity detected' END AS activity_specific_insight FROM k""")
def _(spark, sf):
    rows = insights.window_insights(featured(spark, sf))
    return rows.select("session", "seq", *[r(n, 5).alias(n) for n in (*NUMBERS, "stride_regularity_score")], "intensity_level", "burst_detected", "posture_change_detected", "phone_orientation", "prediction_confidence_tier", F.size("applicable_insights").alias("n_applicable"), "activity_specific_insight")


@query("session_recap", INSIGHT_SQL + """, l AS (SELECT *, lag(intensity_level) OVER w AS before_level, lag(phone_orientation) OVER w AS before_place FROM k WINDOW w AS (PARTITION BY session ORDER BY t, seq)),
a AS (SELECT session, count(*) AS windows, 1.28 * count(*) FILTER (WHERE intensity_level <> 'still') AS active_seconds, 1.28 * count(*) FILTER (WHERE intensity_level IN ('moderate', 'high')) AS moderate_or_higher_seconds, 1.28 * count(*) FILTER (WHERE grp = 'locomotion') AS locomotion_seconds, 1.28 * count(*) FILTER (WHERE grp = 'static') AS static_seconds,
max(intensity_ratio) AS peak_intensity_ratio, max(cadence_spm) AS peak_cadence_spm, max(ground_impact_score) AS peak_impact_score, coalesce(avg(cadence_spm) FILTER (WHERE cadence_spm > 0), 0) AS cadence_mean_spm, coalesce(avg(regularity) FILTER (WHERE cadence_spm > 0), 0) AS cadence_consistency_mean_pct,
avg(smoothness_score) AS smoothness_mean_score, avg(signal_quality_score) AS signal_quality_mean, least(100, min(signal_quality_score)) AS signal_quality_min, coalesce(avg(posture_stability_score) FILTER (WHERE grp = 'static'), 0) AS avg_posture_stability, count(*) FILTER (WHERE before_level <> intensity_level) AS transition_count,
count(*) FILTER (WHERE before_place <> phone_orientation) AS phone_reposition_count, count(*) FILTER (WHERE burst_detected) AS burst_count, count(*) FILTER (WHERE posture_change_detected) AS posture_change_count, count(*) FILTER (WHERE said = 'walk') AS walks FROM l GROUP BY 1),
c AS (SELECT session, arg_max(said, (n, -t0, -s0)) AS most_common_activity FROM (SELECT session, said, count(*) AS n, min(t) AS t0, arg_min(seq, (t, seq)) AS s0 FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT session, windows, transition_count, phone_reposition_count, burst_count, posture_change_count, most_common_activity, CAST(CASE WHEN walks > 0 THEN round_even(round(cadence_mean_spm * locomotion_seconds / 60, 9), 0) ELSE 0 END AS BIGINT) AS estimated_steps, """ + ", ".join(f"round({n}, 4) AS {n}" for n in (
    "active_seconds", "moderate_or_higher_seconds", "locomotion_seconds", "static_seconds", "peak_intensity_ratio", "peak_cadence_spm", "peak_impact_score", "cadence_mean_spm", "cadence_consistency_mean_pct", "smoothness_mean_score", "signal_quality_mean", "signal_quality_min", "avg_posture_stability")) + " FROM a JOIN c USING (session)")
def _(spark, sf):
    rows = recap.session_recap(insights.window_insights(featured(spark, sf)))
    rounded = ("active_seconds", "moderate_or_higher_seconds", "locomotion_seconds", "static_seconds", "peak_intensity_ratio", "peak_cadence_spm", "peak_impact_score", "cadence_mean_spm", "cadence_consistency_mean_pct", "smoothness_mean_score", "signal_quality_mean", "signal_quality_min", "avg_posture_stability")
    return rows.select("session", "windows", "transition_count", "phone_reposition_count", "burst_count", "posture_change_count", "most_common_activity", "estimated_steps", *[r(n, 4).alias(n) for n in rounded])


@query("activity_log", CLEAN_SQL + ", l AS (SELECT session, row_number() OVER w AS window_index, lag(activity) OVER w AS from_activity, activity AS to_activity FROM clean WINDOW w AS (PARTITION BY session ORDER BY t, seq)) SELECT * FROM l WHERE from_activity <> to_activity")
def _(spark, sf):
    return recap.activity_log(clean(spark, sf))


@query("initial_probs", TRANS_SQL + ", i AS (SELECT session, arg_min(activity, (t, seq)) AS activity FROM clean WHERE activity IS NOT NULL GROUP BY 1), c AS (SELECT activity, count(*) AS n FROM i GROUP BY 1) SELECT a AS activity, round(ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0) + 1) OVER ())::DOUBLE), 6) AS p FROM names LEFT JOIN c ON c.activity = a WHERE a IS NOT NULL")
def _(spark, sf):
    rows = clean(spark, sf)
    return evaluation.log_form(evaluation.initial_probs(rows, rows)).select("activity", r("p").alias("p"))


@query("label_coverage", PRED_SQL + """, w AS (SELECT CASE WHEN dataset NOT IN (1, 2, 3, 4) THEN 'excluded_dataset' WHEN predicted NOT IN ('run', 'walk', 'sit/lay') THEN 'excluded_placement' WHEN label NOT IN ('lay', 'stairs', 'stand', 'walk') THEN 'excluded_activity' ELSE 'label:' || label END AS metric
FROM (SELECT *, CASE WHEN activity = 'sit/lay' THEN 'lay' ELSE activity END AS label FROM pred)), c AS (SELECT metric, count(*) AS n FROM w GROUP BY 1),
t AS (SELECT metric, coalesce(n, 0) AS value FROM (SELECT unnest(['label:lay', 'label:stairs', 'label:stand', 'label:walk', 'excluded_dataset', 'excluded_placement', 'excluded_activity']) AS metric) LEFT JOIN c USING (metric))
SELECT * FROM t UNION ALL SELECT 'total_windows', CAST(sum(value) FILTER (WHERE metric LIKE 'label:%') AS BIGINT) FROM t UNION ALL SELECT 'missing_labels', count(*) FILTER (WHERE metric LIKE 'label:%' AND value = 0) FROM t""")
def _(spark, sf):
    rows = predicted(spark, sf).select(F.col("dataset").cast("string").alias("dataset_id"), F.col("predicted").alias("placement_label"), F.col("activity").alias("activity_label"))
    return evaluation.coverage(rows, ("1", "2", "3", "4"), ("run", "walk", "sit/lay"), ("walk", "stand", "stairs", "lay"), {"sit/lay": "lay"})


FLUSH_SQL = f"""WITH {SENSOR_SQL}, named AS (SELECT session, seq, t, x * 9.81 AS x, y * 9.81 AS y, z * 9.81 AS z FROM sensor WHERE activity IN ('walk', 'run', 'stand', 'sit/lay')),
first AS (SELECT *, row_number() OVER (PARTITION BY session, t ORDER BY seq) AS n FROM named WHERE t IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL), clean AS (SELECT session, seq, t - min(t) OVER (PARTITION BY session) AS t, x FROM first WHERE n = 1),
cut AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t, seq) > 172800 THEN 1 ELSE 0 END AS c FROM clean), seg AS (SELECT *, sum(c) OVER (PARTITION BY session ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS segment FROM cut),
own AS (SELECT CASE WHEN max(segment) OVER (PARTITION BY session) > 0 THEN session || ':segment:' || CAST(segment AS BIGINT) ELSE CAST(session AS VARCHAR) END AS session, t - min(t) OVER (PARTITION BY session, segment) AS t, seq, x FROM seg),
a AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM own WINDOW w AS (PARTITION BY session ORDER BY t, seq)), g AS (SELECT session, unnest(range(0, CAST(ceil((max(t) + 7200) / 14400) AS BIGINT))) AS i FROM own GROUP BY session),
grid AS (SELECT g.session, g.i, CASE WHEN t1 IS NULL THEN x ELSE x + (g.i * 14400.0::DOUBLE - t) / (t1 - t) * (x1 - x) END AS x FROM g JOIN a ON g.session = a.session AND g.i * 14400 >= t AND (t1 IS NULL OR g.i * 14400 < t1)),
n AS (SELECT *, count(*) OVER (PARTITION BY session) AS n FROM grid), w AS (SELECT session, x, i, unnest(range(CAST(greatest(0, ceil((i - 15) / 8.0)) AS BIGINT), CAST(least(i // 8, (n - 16) // 8) AS BIGINT) + 1)) AS window_index FROM n WHERE n >= 16)
SELECT session, window_index, count(*) AS n, round(avg(x), 7) AS mean_x, round(sum((i - window_index * 8) * x), 3) AS weighted FROM w GROUP BY 1, 2"""


@query("session_flush", FLUSH_SQL)
def _(spark, sf):
    """Raw sensor rows to windows in one operator: labels, scale, gaps of two days, a grid of four hours, windows of 16 by 8."""
    from strideflow.sources.files import flush_sessions

    rows = sensor(spark, sf).withColumns({"raw": F.concat(F.lit(" "), F.upper("activity")), "subject": F.col("session"), "split": F.lit("train"), "placement": F.lit("pocket")}).drop("activity")
    names = {"walk": "walk", "run": "run", "stand": "stand", "sit/lay": "sit/lay", "transitions": None}
    windows = flush_sessions(rows, names, 9.81, 48 * HOUR, 4 * HOUR, 16, 8)
    return windows.groupBy("session", "window_index").agg(F.count("*").alias("n"), r(F.avg("x"), 7).alias("mean_x"), r(F.sum(F.col("sample_index") * F.col("x")), 3).alias("weighted"))


@query("example_routing", PRED_SQL + """, e AS (SELECT *, CASE WHEN activity = 'sit/lay' THEN 'stand' ELSE activity END AS label, CASE session % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'train_only' WHEN 2 THEN 'other' ELSE 'train' END AS split FROM pred),
p AS (SELECT *, CASE split WHEN 'test' THEN 'test' WHEN 'train' THEN 'train' END AS part FROM e WHERE dataset IN (1, 2, 3) AND predicted IN ('run', 'walk') AND label IN ('walk', 'stand', 'run') AND split IN ('test', 'train') AND NOT (label = 'run' AND split = 'train'))
SELECT part, dataset || '|' || session AS subject_group, label AS activity_label, count(*) AS n FROM p WHERE label IN (SELECT label FROM p WHERE part = 'train') GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Examples without train_only sessions; runs are kept from training, so the test's runs have no label to fit."""
    s = F.col("session") % 5
    split = F.when(s == 0, "test").when(s == 1, "train_only").when(s == 2, "other").otherwise("train")
    rows = predicted(spark, sf).select(F.col("dataset").cast("string").alias("dataset_id"), F.col("predicted").alias("placement_label"), F.col("activity").alias("activity_label"), split.alias("split"), F.col("session").cast("string").alias("global_subject_id"), F.lit("s").alias("stream_id"))
    rows = rows.where("not (activity_label = 'run' and split = 'train')")
    out = training.collect_examples(rows, ("1", "2", "3"), ("run", "walk"), ("walk", "stand", "run"), {"sit/lay": "stand"}, train_only=False)
    return out.groupBy("part", "subject_group", "activity_label").agg(F.count("*").alias("n"))


@query("live_snapshots")
def _(spark, sf):
    """Sessions of the sensor scored message by message (one message per event; hours stand for the 20 ms step)."""
    rows = sensor(spark, sf).select(F.col("session").cast("string").alias("session"), F.col("seq").alias("message_id"), F.lit(0).alias("seq"), (F.col("t") * 1e9 / 3.6e6).cast("bigint").alias("ns"), "x", "y", "z")
    return live.score_stream(rows, live.Scorer(("walk", "run", "stand"), live.energy_emission))


@query("tumbling", f"WITH {SENSOR_SQL} SELECT CAST(floor(t / 86400) AS BIGINT) AS day, activity, count(*) AS n, round(avg(x), 8) AS mean_x FROM sensor GROUP BY 1, 2")
def _(spark, sf):
    return sensor(spark, sf).groupBy(F.floor(F.col("t") / 86400).alias("day"), "activity").agg(F.count("*").alias("n"), r(F.avg("x"), 8).alias("mean_x"))


@query("rollup_activity", f"WITH {SENSOR_SQL} SELECT session, activity, count(*) AS n FROM sensor GROUP BY ROLLUP (session, activity)")
def _(spark, sf):
    return sensor(spark, sf).rollup("session", "activity").agg(F.count("*").alias("n"))


# --- training and reports -----------------------------------------------------------------------


@query("tuning_split", f"WITH {SENSOR_SQL} SELECT session, CASE WHEN substr(md5('42:' || session), 1, 8) < '26666666' THEN 'tune' ELSE 'fit' END AS part, count(*) AS n FROM sensor GROUP BY 1, 2")
def _(spark, sf):
    return training.tuning_split(sensor(spark, sf), "session").groupBy("session", "part").agg(F.count("*").alias("n"))


@query("confusion_table", PRED_SQL + " SELECT activity AS true_label, " + ", ".join(f"CAST(count(*) FILTER (WHERE predicted = '{n}') AS BIGINT) AS \"{n}\"" for n in ("run", "walk", "stand", "sit/lay")) + " FROM pred GROUP BY 1")
def _(spark, sf):
    return training.confusion_table(predicted(spark, sf), ("run", "walk", "stand", "sit/lay"))


@query("coverage_metrics", PRED_SQL + ", c AS (SELECT activity, count(*) AS n_rows, count(DISTINCT session) AS sessions FROM pred GROUP BY 1) SELECT activity, 'n_rows' AS metric, n_rows AS value FROM c UNION ALL SELECT activity, 'sessions', sessions FROM c")
def _(spark, sf):
    rows = predicted(spark, sf).groupBy("activity").agg(F.count("*").alias("n_rows"), F.count_distinct("session").alias("sessions"))
    return training.metric_rows(rows, "activity", ("n_rows", "sessions"))


@query("synthetic_time", RUNS_SQL + " SELECT session, run, seq, (row_number() OVER (PARTITION BY session, run ORDER BY seq) - 1) / 50.0::DOUBLE AS t FROM runs")
def _(spark, sf):
    return synthetic_time(timeseries.label_runs(clean(spark, sf)), key=("session", "run")).select("session", "run", "seq", "t")


@query("experiment_history", PRED_SQL + ", a AS (SELECT dataset, count(*) AS n, round(avg(CASE WHEN activity = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred GROUP BY 1) SELECT dataset, accuracy, CASE WHEN dataset >= 3 THEN n END AS n FROM a")
def _(spark, sf):
    rows = evaluation.accuracy(predicted(spark, sf), "dataset").select("dataset", r("accuracy").alias("accuracy"), "n")
    return training.evolve(rows.where("dataset < 3").drop("n"), rows.where("dataset >= 3"))


@query("keyed_upsert", """SELECT o_custkey AS session, arg_max(o_totalprice, (o_orderkey, n)) AS seconds, max(o_orderkey) AS version FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM orders)
GROUP BY 1 HAVING NOT (max(o_orderkey) % 3 = 0 AND max(o_orderkey) % 2 = 0)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), F.col("o_totalprice").alias("seconds"), F.col("o_orderkey").alias("version"))
    changed = F.col("version") % 3 == 0
    return training.upsert(o.where(~changed), o.where(changed).withColumn("deleted", F.col("version") % 2 == 0), "session", "version")


@query("forest_confusion")
def _(spark, sf):
    """A small weighted forest, refitted on its misses; its confusion over the sessions held out for tuning."""
    split = training.tuning_split(_weighted(spark, sf).drop("predicted").withColumn("hour", F.col("t") / HOUR % 24), "session")
    features = ("x", "y", "z", "hour")
    model = training.refit_on_misses(split.where("part = 'fit'"), features, params={"numTrees": 10, "maxDepth": 4})
    return evaluation.confusion(training.predict(model, split.where("part = 'tune'")))


@query("label_indexes", f"WITH {SENSOR_SQL} SELECT session, seq, CAST(dense_rank() OVER (ORDER BY list_position({list(LABELS)}, activity)) - 1 AS INTEGER) AS label_index FROM sensor WHERE activity IS NOT NULL")
def _(spark, sf):
    """Labels as numbers: their place among the target labels that occur."""
    rows = sensor(spark, sf).where("activity is not null")
    return rows.select("session", "seq", training.label_index(F.col("activity"), training.label_order(rows, LABELS)).alias("label_index"))


BOOSTED = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "max_bins": 32}
HOURLY = ("x", "y", "z", "hour")


def _hourly(spark, sf):
    return sensor(spark, sf).where("activity is not null").withColumn("hour", F.col("t") / HOUR % 24)


@query("boosted_confusion")
def _(spark, sf):
    """A few boosted trees (``boosting.BASE`` holds the full parameters); their confusion over the sessions held out for tuning."""
    split = training.tuning_split(_weighted(spark, sf).drop("predicted").withColumn("hour", F.col("t") / HOUR % 24), "session")
    model = boosting.fit(split.where("part = 'fit'"), HOURLY, weight="weight", params=BOOSTED)
    return evaluation.confusion(boosting.predict(model, split.where("part = 'tune'")))


@query("bundle_scores")
def _(spark, sf):
    """A bundle fitted, saved and loaded again; all sensor rows scored by it: the likeliest label alone and decoded."""
    rows, path = _hourly(spark, sf), new_path(spark, "bundle")
    candidate = BOOSTED | {"n_estimators": 2, "decoder_sticky_prior": 0.2, "decoder_cross_coarse_penalty": 0.2}
    labels = [n for n in LABELS if n in ACTIVITIES.values()]
    bundle.save(spark, tuning.fit_bundle(rows, HOURLY, candidate, labels, ("sit/lay", "stand")), path)
    found = bundle.infer(bundle.load(spark, path, HOURLY), rows)
    return found.select("session", "seq", "raw", "decoded", r(F.array_max("probs"), 6).alias("p"))


@query("contiguous_sessions", """WITH new AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) OR row_number() OVER (ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS c FROM events),
runs AS (SELECT *, CAST(sum(c) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM new) SELECT run, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM runs GROUP BY 1, 2""")
def _(spark, sf):
    """Runs of one event type in the order of the file; in the given tables event_id numbers that order."""
    runs = sliced.contiguous_sessions(sliced.file_rows(spark, f"{sf}/events.parquet", 2000), "event_type")
    return runs.groupBy("run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("sliced_segments", f"""WITH {SENSOR_SQL}, cut AS (SELECT *, CASE WHEN t - lag(t) OVER w > 60 THEN 1 ELSE 0 END AS c, CASE WHEN activity IS DISTINCT FROM lag(activity) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS r FROM sensor WINDOW w AS (ORDER BY t, seq)),
seg AS (SELECT *, CAST(sum(c) OVER w AS BIGINT) AS segment, CAST(sum(r) OVER w AS BIGINT) AS run, row_number() OVER (ORDER BY t, seq) AS n FROM cut WINDOW w AS (ORDER BY t, seq ROWS UNBOUNDED PRECEDING))
SELECT seq, n, segment, run, round(t - min(t) OVER (PARTITION BY segment), 4) AS t_segment FROM seg""")
def _(spark, sf):
    """All sensor rows as one long session: gap segments, label runs and row numbers by slices."""
    rows = sliced.add_slices(sensor(spark, sf).withColumn("session", F.lit("all")), size=1000, cuts=32)
    rows = sliced.runs(sliced.segments(rows, 60.0), "activity")
    return sliced.running_sum(rows, F.lit(1), "n").select("seq", "n", "segment", "run", r("t_segment", 4).alias("t_segment"))


@query("hot_session_decode")
def _(spark, sf):
    """All scored rows decoded as one long session by slices; a test holds it against ``decode.decode``."""
    k = len(LABELS)
    trans = [[0.9 if i == j else 0.1 / (k - 1) for j in range(k)] for i in range(k)]
    rows = scored(spark, sf).select(F.lit("all").alias("session"), "t", "seq", F.array(*[f"p{i}" for i in range(k)]).alias("probs"))
    found = sliced.decode_slices(sliced.add_slices(rows, size=1000, cuts=63), [1 / k] * k, trans)
    return found.select("seq", "label_index", r(F.array_max("posterior"), 6).alias("p"))


@query("finalised_sessions")
def _(spark, sf):
    """Every session of the sensor rows summarised once: of its history, else (each fifth) its latest row, else (each tenth) not at all."""
    rows = entries(spark, sf)
    newest = rows.groupBy("session").agg(F.max_by(F.struct(*sinks.HISTORY[1:]), F.struct("t", "seq")).alias("r")).select("session", "r.*")
    found = sinks.finalise(sensor(spark, sf), rows.where("session % 5 <> 0"), newest.where("session % 10 <> 0"))
    return found.withColumns({"notes": F.concat_ws(" ", "notes"), "activity_bouts": F.to_json("activity_bouts"), "time_by_activity": F.to_json("time_by_activity")})
